"""Releases of reserves in order against a plain queue."""

import random
from datetime import datetime, timedelta

import pytest
from reconcord.operators import reserves

T0 = datetime(2024, 1, 1)


def plain(holds, releases):
    out = []
    events = sorted([(s, at, 0, k, n) for k, s, n, at in holds if n > 0] + [(s, at, 1, k, n) for s, at, k, n in releases if n > 0])
    queue = {}
    for source, _, turn, name, kobo in events:
        own = queue.setdefault(source, [])
        if turn == 0:
            own.append([name, kobo])
            continue
        while kobo and own:
            use = min(kobo, own[0][1])
            out.append((source, name, own[0][0], use, 0))
            own[0][1] -= use
            kobo -= use
            if not own[0][1]:
                own.pop(0)
        if kobo:
            out.append((source, name, None, 0, kobo))
    return out


@pytest.mark.parametrize("seed, n, sources", [(1, 30, 3), (2, 800, 1), (3, 800, 2), (4, 2000, 3)])
def test_releases_equal_a_plain_queue(spark, seed, n, sources):
    rnd = random.Random(seed)
    source = lambda: "hot" if rnd.random() < 0.6 else f"s{rnd.randrange(sources)}"
    holds = [(f"h{k}", source(), rnd.choice([0, 1, 5, 100, rnd.randrange(1, 1000), 10**12]), T0 + timedelta(hours=rnd.randrange(200))) for k in range(n)]
    releases = [(source(), T0 + timedelta(hours=rnd.randrange(-5, 220)), f"r{k}", rnd.choice([0, 1, 7, 300, rnd.randrange(1, 3000), 10**12])) for k in range(n)]
    h = spark.createDataFrame(holds, "inflow_key string, source string, withheld_kobo long, withheld_at timestamp").repartition(3)
    r = spark.createDataFrame(releases, "source string, at timestamp, released_by string, amount_kobo long").repartition(3)
    got = sorted(map(tuple, reserves.reserve_fold(h, r).collect()), key=str)
    assert got == sorted(plain(holds, releases), key=str)
    assert {x[2] is None for x in got} == {True, False}


def test_no_holds_or_no_releases(spark):
    h = spark.createDataFrame([("h1", "a", 5, T0)], "inflow_key string, source string, withheld_kobo long, withheld_at timestamp")
    r = spark.createDataFrame([("a", T0, "r1", 7)], "source string, at timestamp, released_by string, amount_kobo long")
    assert reserves.reserve_fold(h, r.limit(0)).count() == 0
    assert [tuple(x) for x in reserves.reserve_fold(h.limit(0), r).collect()] == [("a", "r1", None, 0, 7)]
    assert sorted((x["inflow_key"] or "", x["applied_kobo"], x["unapplied_kobo"]) for x in reserves.reserve_fold(h, r).collect()) == [("", 0, 2), ("h1", 5, 0)]
