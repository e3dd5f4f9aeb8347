"""The nearest records are found however far they are."""

import random

from reconcord.operators import matching


def plain(credits, inflows, keep):
    out = []
    for c, a in credits:
        near = sorted(inflows, key=lambda i: (abs(i[1] - a) > i[2], abs(i[1] - a), i[0]))[:keep]
        out += [(c, i[0], abs(i[1] - a), k) for k, i in enumerate(near, 1)]
    return sorted(out)


def found(spark, credits, inflows):
    c = spark.createDataFrame(credits, "idempotency_key string, amount_kobo long")
    i = spark.createDataFrame(inflows, "inflow_key string, expected_net_kobo long, allowance_kobo long")
    return sorted(tuple(r) for r in matching.nearest_candidates(c, i, 4).collect())


def test_far_inflows_are_listed(spark):
    inflows = [("i1", 100, 10), ("i2", 9_000_000, 10), ("i3", 50_000_000, 10)]
    assert found(spark, [("c", 1_000_000)], inflows) == plain([("c", 1_000_000)], inflows, 4)


def test_nearest_with_ties_parts_and_allowances(spark):
    rnd = random.Random(5)
    for spread, allowances in ((30, (3,)), (10**9, (10,)), (2_000, (0, 40, 500))):
        inflows = [(f"i{k}", rnd.randrange(spread), rnd.choice(allowances)) for k in range(120)] + [(f"h{k}", spread // 2, allowances[0]) for k in range(9)]
        credits = [(f"c{k}", rnd.randrange(spread)) for k in range(60)] + [("low", -spread), ("high", 3 * spread), ("hot", spread // 2)]
        assert found(spark, credits, inflows) == plain(credits, inflows, 4)
