"""The ordered matchers against plain versions and stated outcomes."""

import random
from datetime import datetime, timedelta
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reconcord.operators import matching, reserves, sequential


def plain_subset(values, target):
    if target <= 0:
        return "none", []
    own = [i for i, v in enumerate(values) if v > 0]
    if len(own) > 24:
        return "not_attempted", []
    hits = [list(c) for k in range(1, min(12, len(own)) + 1) for c in combinations(own, k) if sum(values[i] for i in c) == target]
    return ("none", []) if not hits else ("unique", hits[0]) if len(hits) == 1 else ("undecidable", [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 60), max_size=11), st.integers(-3, 200))
def test_subset_sum_is_the_only_one(values, target):
    state, chosen = sequential.unique_subset_sum(values, target)
    assert (state, sorted(chosen)) == plain_subset(values, target)


def test_subset_sum_limits():
    assert sequential.unique_subset_sum([1] * 25, 5)[0] == "not_attempted"
    assert sequential.unique_subset_sum([2**i for i in range(20)], 2**20 - 1)[0] == "none"  # 20 items are over 12
    assert sequential.unique_subset_sum([2**i for i in range(14)], 2**12 - 1) == ("unique", list(range(12)))


def test_halves_find_what_the_search_does(monkeypatch):
    halves, used = sequential._from_halves, []
    monkeypatch.setattr(sequential, "_from_halves", lambda *a: used.append(a) or halves(*a))
    rnd = random.Random(2)
    for n in (*range(1, 15), 17):
        for values in ([rnd.randint(1, 40) for _ in range(n)], [rnd.randint(1, 10**6) for _ in range(n)], [1] * n):
            for target in (sum(values), sum(values) - 1, sum(rnd.sample(values, (n + 1) // 2)), rnd.randint(1, 10**6)):
                assert sequential.unique_subset_sum(values, target) == plain_subset(values, target)
    assert used


def at(day, hour=9):
    return datetime(2026, 8, day, hour)


def allocated(spark, promises, payouts):
    p = spark.createDataFrame(promises, "source string, transaction_id string, owed_kobo long, occurred_at timestamp, escalates_at timestamp")
    q = spark.createDataFrame(payouts, "source string, payout_reference string, gross_kobo long, expected_net_kobo long, derived_net_kobo long, value_date timestamp")
    return sorted(tuple(r)[1:] for r in sequential.allocate(p, q).collect())


def test_allocate_outcomes(spark):
    promise = lambda name, kobo: ("a", name, kobo, at(12), at(20))
    payout = lambda name, gross, net=None, derived=None: ("a", name, gross, net if net is not None else gross, derived if derived is not None else (net if net is not None else gross), at(13))
    assert allocated(spark, [promise("t1", 300), promise("t2", 700), promise("t3", 500)], [payout("p1", 1000, 985)]) == [("p1", "PAYOUT_MATCH", "t1", 300), ("p1", "PAYOUT_MATCH", "t2", 700)]
    assert allocated(spark, [promise("t1", 1000)], [payout("p1", 1000, 900, 985)]) == [("p1", "PAYOUT_UNBALANCED", None, None)]
    assert allocated(spark, [promise("t1", 1000)], [payout("p1", 400), payout("p2", 600)]) == [("p1", "PARTIAL_PAYOUT_MATCH", "t1", 400), ("p2", "PAYOUT_MATCH", "t1", 600)]
    assert allocated(spark, [promise(f"t{i}", 500) for i in range(3)], [payout("p1", 1000)]) == [("p1", "PHANTOM_CREDIT", None, None)]
    assert allocated(spark, [promise(f"t{i}", i + 1) for i in range(25)], [payout("p1", 7)]) == [("p1", "BATCH_TOO_LARGE", None, None)]
    assert allocated(spark, [("a", "late", 5, at(14), at(20))], [payout("p1", 5)]) == [("p1", "PHANTOM_CREDIT", None, None)]


def test_allocate_keeps_sources_apart_and_order_does_not_matter(spark):
    rnd = random.Random(3)
    promises = [(s, f"{s}{i}", 2**i * 100, at(1 + i % 5), at(25)) for s in "ab" for i in range(10)]
    payouts = [(s, f"{s}p{i}", sum(2**j * 100 for j in rnd.sample(range(10), 2)), 1, 1, at(20)) for s in "ab" for i in range(4)]
    first = allocated(spark, promises, payouts)
    rnd.shuffle(promises)
    rnd.shuffle(payouts)
    assert allocated(spark, promises, payouts) == first
    for r in first:
        assert r[2] is None or r[2][0] == r[0][0]


def test_reserve_fold_drops_the_excess(spark):
    holds = spark.createDataFrame([("a", at(1), "h1", 100), ("a", at(2), "h2", 50), ("a", at(9), "h3", 70)], "source string, withheld_at timestamp, inflow_key string, withheld_kobo long")
    releases = spark.createDataFrame([("a", at(3), "r1", 120), ("a", at(4), "r2", 60), ("a", at(10), "r3", 10)], "source string, at timestamp, released_by string, amount_kobo long")
    got = sorted(tuple(r)[1:] for r in reserves.reserve_fold(holds, releases).na.fill("").collect())
    assert got == [("r1", "h1", 100, 0), ("r1", "h2", 20, 0), ("r2", "", 0, 30), ("r2", "h2", 30, 0), ("r3", "h3", 10, 0)]


def test_confirm_named_then_amount_then_ambiguous(spark):
    day = at(13)
    inflows = spark.createDataFrame([("i1", 985, day), ("i2", 500, day), ("i3", 700, day), ("i4", 700, day)], "inflow_key string, expected_net_kobo long, value_date timestamp")
    credits = spark.createDataFrame([(f"c{i}", k, day + timedelta(hours=1)) for i, k in enumerate((985, 490, 700), 1)], "idempotency_key string, amount_kobo long, value_date timestamp")
    named = spark.createDataFrame([("c1", "i1")], "idempotency_key string, inflow_key string")
    cand = spark.createDataFrame([("c1", "i1", 0), ("c2", "i2", 10), ("c3", "i3", 0), ("c3", "i4", 0)], "idempotency_key string, inflow_key string, short_kobo long")
    got = sorted((r["idempotency_key"], r["inflow_key"] or "", r["how"]) for r in sequential.confirm(inflows, credits, named, cand).collect())
    assert got == [("c1", "i1", "named"), ("c2", "i2", "bank_charge"), ("c3", "", "ambiguous")]


def test_confirm_pairs_sets_and_refuses_names_that_do_not_fit(spark):
    day = at(13)
    inflows = spark.createDataFrame([(f"i{i}", k, day) for i, k in enumerate((700, 700, 300, 400, 900), 1)], "inflow_key string, expected_net_kobo long, value_date timestamp")
    credits = spark.createDataFrame([(f"c{i}", k, day + timedelta(hours=i)) for i, k in enumerate((700, 700, 300, 5000), 1)], "idempotency_key string, amount_kobo long, value_date timestamp")
    named = spark.createDataFrame([("c3", "i3"), ("c3", "i4"), ("c4", "i5")], "idempotency_key string, inflow_key string")
    cand = spark.createDataFrame([(c, i, 0) for c in ("c1", "c2") for i in ("i1", "i2")] + [("c3", "i3", 0)], "idempotency_key string, inflow_key string, short_kobo long")
    got = sorted((r["idempotency_key"], r["inflow_key"] or "", r["how"]) for r in sequential.confirm(inflows, credits, named, cand, 10).collect())
    # c1 leaves c2 one inflow of the amount, as in the reference
    assert got == [("c1", "i1", "amount_set"), ("c2", "i2", "amount"), ("c3", "", "ambiguous"), ("c4", "", "amount_mismatch")]


def test_duplicates_of_credits_of_this_run(spark):
    left = spark.createDataFrame([("b", 100), ("d", 100), ("f", 100), ("x", 7), ("a", 100)], "idempotency_key string, amount_kobo long")
    names = spark.createDataFrame([("x", "i1")], "idempotency_key string, inflow_key string")
    banked = spark.createDataFrame([("i1", "aa", 100), ("i2", "e", 100)], "inflow_key string, confirmed_by string, credited_kobo long")
    assert sorted(map(tuple, matching.duplicates_here(left, names, banked).collect())) == [("b", "i1"), ("d", "i1"), ("x", "i1")]


def plain_allocate(promises, payouts):
    """One payout after the other, over lists."""
    owed = {(s, t): k for s, t, k, _, _, _ in promises}
    terms = {(s, t): c for s, t, _, _, _, c in promises}
    out = []
    for s, name, gross, net, derived, v in sorted(payouts, key=lambda q: q[1]):
        if net != derived:
            out.append((s, name, "PAYOUT_UNBALANCED", None, None))
            continue
        if gross == 0 and net > 0:
            out.append((s, name, "RESERVE_RELEASED", None, None))
            continue
        own = [(s, t) for s2, t, _, a, b, _ in sorted(promises, key=lambda p: (p[3], p[1])) if s2 == s and owed[s2, t] > 0 and (v is None or a <= v and (b is None or v <= b))]
        state, chosen = plain_subset([owed[x] for x in own], gross)
        if state == "none" and own and any(terms[x] for x in own):
            state, chosen = plain_subset([owed[x] - (sequential.predicted_fee(owed[x], terms[x][1:]) if terms[x] else 0) for x in own], net)
            state = state if state == "unique" else "none"
        roomy = [x for x in own if owed[x] > gross]
        if state == "not_attempted":
            out.append((s, name, "BATCH_TOO_LARGE", None, None))
        elif state == "unique":
            for c in chosen:
                out.append((s, name, "PAYOUT_MATCH", own[c][1], owed[own[c]]))
                owed[own[c]] = 0
        elif len(roomy) == 1 and gross > 0:
            out.append((s, name, "PARTIAL_PAYOUT_MATCH", roomy[0][1], gross))
            owed[roomy[0]] -= gross
        else:
            out.append((s, name, "PHANTOM_CREDIT", None, None))
    return sorted(out, key=str)


def test_allocate_equals_a_plain_fold(spark):
    """Sparse and crowded sources, undated payouts, open ends, part matches, net matches."""
    contract = "struct<contract_id:string,percent_bp:int,flat_kobo:int,waived_below_kobo:int,cap_kobo:int,vat_bp:int>"
    rnd = random.Random(11)
    promises, payouts = [], []
    for s, per_day, days in (("sparse", 2, 20), ("mid", 5, 8), ("dense", 40, 8), ("few", 1, 6)):
        for d in range(1, days + 1):
            for i in range(per_day):
                end = None if rnd.random() < 0.01 and s != "dense" else at(min(31, d + rnd.randint(1, 3)), 18)
                promises.append((s, f"{s}{d:02d}{i:02d}", rnd.choice([rnd.randint(1, 60), rnd.randint(1000, 9000)]), at(d, rnd.randint(0, 20)), end, ("c", 150, 3, 20, 100, 750) if rnd.random() < 0.6 else None))
    for s in ("sparse", "mid", "dense", "few"):
        own = [p for p in promises if p[0] == s]
        for i in range(14):
            picked = rnd.sample(own, min(len(own), rnd.randint(1, 3)))
            gross = sum(p[2] for p in picked)
            net = sum(p[2] - (sequential.predicted_fee(p[2], p[5][1:]) if p[5] else 0) for p in picked)
            v = None if s == "few" and i % 5 == 0 else max(p[3] for p in picked) + timedelta(hours=rnd.randint(0, 30))
            kind = i % 7
            gross, net, derived = (gross, net, net) if kind < 3 else (gross + 7_000_000, net, net) if kind < 5 else (0, net, net) if kind == 5 else (gross, net, net + 1)
            payouts.append((s, f"{rnd.random():.6f}", gross if rnd.random() < 0.8 else max(1, gross // 3), net, derived, v))
    p = spark.createDataFrame(promises, f"source string, transaction_id string, owed_kobo long, occurred_at timestamp, escalates_at timestamp, contract {contract}")
    q = spark.createDataFrame(payouts, "source string, payout_reference string, gross_kobo long, expected_net_kobo long, derived_net_kobo long, value_date timestamp")
    want = plain_allocate(promises, payouts)
    assert sorted((tuple(r) for r in sequential.allocate(p, q).collect()), key=str) == want
    assert {r[2] for r in want} == {"PAYOUT_UNBALANCED", "RESERVE_RELEASED", "BATCH_TOO_LARGE", "PAYOUT_MATCH", "PARTIAL_PAYOUT_MATCH", "PHANTOM_CREDIT"}


def test_lines_of_one_promise_take_in_order(spark):
    lines = spark.createDataFrame([(f"l{i}", "a", r, k, s, at(13)) for i, (r, k, s) in enumerate([("r1", 300, "reversed"), ("r1", 1000, "settled"), ("r1", 1000, "settled"), ("r2", 0, "reversed"), ("r2", 2000, "reversed"), ("r3", 5, "settled"), ("r4", 5, "settled")])], "idempotency_key string, source string, reference string, gross_kobo long, status string, settled_at timestamp")
    promises = spark.createDataFrame([("a", "r1", "t1", "authorized", 1000, 1000), ("a", "r2", "t2", "authorized", 1000, 1000), ("a", "r4", "t4", "authorized", 5, 5), ("a", "r4", "t5", "authorized", 5, 5)], "source string, reference string, transaction_id string, state string, gross_kobo long, owed_kobo long")
    claims = sequential.line_claims(lines, promises)
    got = sorted((r["idempotency_key"], r["reason"], r["amount_kobo"]) for r in claims.collect())
    assert got == [("l0", "PARTIAL_REVERSAL", 300), ("l1", "BATCH_MATCH", 700), ("l2", "PHANTOM_CREDIT", None), ("l3", "AMOUNT_MISMATCH", None), ("l4", "AMOUNT_MISMATCH", None), ("l5", "PHANTOM_CREDIT", None), ("l6", "PHANTOM_CREDIT", None)]
    first = spark.createDataFrame([("t1", 300)], "transaction_id string, amount_kobo long")
    due = promises.withColumn("escalates_at", F.to_timestamp(F.lit("2026-08-14")))
    for day, late in ((13, "PENDING_T_PLUS_N"), (15, "MISSING_SETTLEMENT")):
        rest = {r["transaction_id"]: (r["reason"], r["left_kobo"]) for r in sequential.leftovers(due, first, F.lit(at(day))).collect()}
        assert rest == {"t1": ("PARTIAL_SETTLEMENT", 700), "t2": (late, 1000), "t4": (late, 5), "t5": (late, 5)}
