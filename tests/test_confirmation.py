"""The bank's stage against a plain loop over the same rules."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from reconcord.operators import confirmation

DAY = timedelta(days=1)
T0 = datetime(2024, 3, 1)
AS_OF = T0 + 20 * DAY
INFLOW = "inflow_key string, expected_net_kobo long, value_date timestamp, escalates_at timestamp, allowance_kobo long, pairs boolean"
LINE = "idempotency_key string, direction string, amount_kobo long, value_date timestamp, narration string, stated_reference string"


def names(line, key):
    return line[5] == key or key.upper() in re.findall(r"[A-Z0-9][A-Z0-9_-]{5,}", (line[4] or "").upper())


def legal(line, inflow):
    return inflow[2] is None or (line[3] is not None and line[3] >= inflow[2] - DAY)


def plain(inflows, lines, banked):
    """Credit by credit and debit by debit, in the order of keys."""
    inflows = sorted(inflows)
    credits = sorted(x for x in lines if x[1] == "credit" and x[2] > 0)
    pairs = {}
    free_c = [c for c in credits if not any(names(c, i[0]) for i in inflows)]
    free_i = [i for i in inflows if not any(names(c, i[0]) for c in credits)]
    for amount in {c[2] for c in free_c}:
        cs, js = [c for c in free_c if c[2] == amount], [i for i in free_i if i[1] == amount]
        if len(cs) >= 2 and len(cs) == len(js) and all(i[5] for i in js) and all(legal(c, i) for c in cs for i in js):
            cs.sort(key=lambda c: (c[3], c[0]))
            js.sort(key=lambda i: (i[2] or datetime(1970, 1, 1), i[0]))
            pairs |= {c[0]: i[0] for c, i in zip(cs, js)}
    left, money, out = {i[0]: i for i in inflows}, list(banked), []
    for c in credits:
        named = [i for i in left.values() if names(c, i[0])]
        pick, how = (named[0], "named") if len(named) == 1 else (None, None)
        if not named:
            fits = [i for i in left.values() if legal(c, i) and 0 <= i[1] - c[2] <= i[4]]
            if len(fits) == 1:
                pick, how = fits[0], "amount"
            elif pairs.get(c[0]) in left:
                pick, how = left[pairs[c[0]]], "amount_set"
        if pick is None:
            of = [k for k, _ in money if names(c, k)]
            same = [k for k, a in money if a == c[2]]
            twice = of[0] if len(of) == 1 else same[0] if len(same) == 1 else None
            out.append(("credit", c[0], twice, "DUPLICATE_BANK_CREDIT" if twice else "UNIDENTIFIED_CREDIT", None, None, False))
            continue
        short = pick[1] - c[2]
        if not 0 <= short <= pick[4]:
            out.append(("credit", c[0], pick[0], "AMOUNT_MISMATCH", None, short, False))
            continue
        out.append(("credit", c[0], pick[0], "BANK_CHARGE" if short else "BANK_CONFIRMED", "bank_charge" if short else how, short, False))
        del left[pick[0]]
        money.append((pick[0], c[2]))
    gone = set()
    for d in sorted(x for x in lines if x[1] == "debit"):
        open_ = [k for k, a in money if a == d[2] and k not in gone]
        named = [k for k in open_ if names(d, k)]
        pick = named[0] if len(named) == 1 else open_[0] if not named and len(open_) == 1 else None
        if pick:
            gone.add(pick)
            out.append(("debit", d[0], pick, "RETURNED_PAYOUT", None, None, False))
    for i in left.values():
        late = i[3] is not None and AS_OF > i[3]
        out.append(("inflow", None, i[0], "MISSING_SETTLEMENT" if late else "AWAITING_BANK_CREDIT", None, None, not late))
    return out


def outcomes(spark, inflows, lines, banked):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = confirmation.bank_stage(frame(inflows, INFLOW), frame(lines, LINE), frame(banked, "inflow_key string, credited_kobo long"), F.lit(AS_OF))
    return [tuple(r) for r in got.collect()]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def made(seed, n):
    rnd = random.Random(seed)
    amounts = [1000, 1000, 1000, 2000, 2050, 2090, 3000, 4000, 5000, 5000, *range(6000, 6400, 40)]
    inflows = [(f"PAYOUT-{k:03d}", rnd.choice(amounts), rnd.choice([None, T0, T0 + DAY, T0 + 9 * DAY]), rnd.choice([None, T0 + 5 * DAY, T0 + 90 * DAY]), rnd.choice([0, 0, 50, 100]), rnd.random() < 0.8) for k in range(n)]
    banked = [(f"OLDER-{k:03d}", rnd.choice(amounts)) for k in range(n // 4)]
    word = lambda: rnd.choice(["", "", "", "TRF x", f"TRF payout-{rnd.randrange(n):03d}", f"older-{rnd.randrange(n):03d} PAYOUT-{rnd.randrange(n):03d}"])
    lines = [(f"bank:{rnd.random():.9f}", rnd.choice(["credit"] * 4 + ["debit"]), rnd.choice([*amounts, 0, 1950]), T0 + rnd.choice([0, 1, 2, 12]) * DAY, word(), rnd.choice([None] * 6 + [f"PAYOUT-{rnd.randrange(n):03d}"])) for _ in range(n + n // 2)]
    return inflows, lines, banked


@pytest.mark.parametrize("seed, n", [(1, 12), (2, 40), (3, 120), (4, 25)])
def test_the_stage_equals_a_plain_loop(spark, seed, n):
    case = made(seed, n)
    same(outcomes(spark, *case), plain(*case))


def test_one_amount_for_all_is_decided_by_counts(spark, monkeypatch):
    """Equal groups pair first in first out, unequal ones do not, and no frame reaches the fold."""
    inflows = [(f"PAYOUT-{k:04d}", amount, T0, None, 0, pairs) for amount, n, pairs in ((700, 300, True), (800, 200, True), (900, 150, False), (950, 1, False)) for k in range(amount * 10, amount * 10 + n)]
    lines = [(f"bank:{amount}:{k:04d}", "credit", amount, T0 + DAY, "", None) for amount, n in ((700, 300), (800, 201), (900, 150), (950, 3)) for k in range(n)]

    def fail(credits, inflows):
        raise AssertionError("a frame of a group without ties")

    monkeypatch.setattr(confirmation, "_fold", fail)
    got = outcomes(spark, inflows, lines, [])
    monkeypatch.undo()
    same(got, plain(inflows, lines, []))
    assert sum(r[3] == "BANK_CONFIRMED" for r in got) == 301 and sum(r[3] == "DUPLICATE_BANK_CREDIT" for r in got) == 2


def test_returns_follow_the_order_of_keys(spark):
    banked = [("PAYOUT-1", 500), ("PAYOUT-2", 500), ("PAYOUT-3", 900)]
    lines = [("d1", "debit", 500, T0, "", None), ("d2", "debit", 500, T0, "RET PAYOUT-2", None), ("d3", "debit", 500, T0, "", None), ("d4", "debit", 500, T0, "PAYOUT-2", None), ("d5", "debit", 900, T0, "", None), ("d6", "debit", 900, T0, "", None), ("d7", "debit", 1, T0, "PAYOUT-3", None)]
    got = outcomes(spark, [], lines, banked)
    same(got, plain([], lines, banked))
    # the first is a guess between two, the third finds one left
    assert sorted((r[1], r[2]) for r in got) == [("d2", "PAYOUT-2"), ("d3", "PAYOUT-1"), ("d5", "PAYOUT-3")]


def test_empty_sides(spark):
    inflows, lines, banked = made(7, 6)
    for case in (([], lines, banked), (inflows, [], banked), (inflows, lines, []), ([], [], [])):
        same(outcomes(spark, *case), plain(*case))


def test_the_query_holds_every_outcome(spark):
    from reconcord.plans import reads, views

    inflows, lines, banked = reads._stage_inputs(views.register(spark, "/root/testdata/sf0.001"))
    columns = lambda df, schema: [tuple(r) for r in df.select([x.split()[0] for x in schema.split(", ")]).collect()]
    got = [tuple(r) for r in confirmation.bank_stage(inflows, lines, banked, F.lit(AS_OF)).collect()]
    same(got, plain(columns(inflows, INFLOW), columns(lines, LINE), columns(banked, "inflow_key string, credited_kobo long")))
    assert {r[3] for r in got} == {"BANK_CONFIRMED", "BANK_CHARGE", "AMOUNT_MISMATCH", "DUPLICATE_BANK_CREDIT", "UNIDENTIFIED_CREDIT", "RETURNED_PAYOUT", "MISSING_SETTLEMENT", "AWAITING_BANK_CREDIT"}


def test_a_frame_of_several_amounts_keeps_them_apart():
    import pandas as pd

    from reconcord.operators import confirmation

    debits = pd.DataFrame({"idempotency_key": ["d1", "d2", "d3"], "amount_kobo": [5, 7, 7], "names": [None, ["i2", "i1"], None]})
    banked = pd.DataFrame({"inflow_key": ["i1", "i2", "i3"], "amount_kobo": [5, 7, 9]})
    got = confirmation._take_back(debits, banked)
    assert list(got.itertuples(index=False, name=None)) == [("d1", "i1"), ("d2", "i2")]


def test_near_amounts_are_found_without_pairs(spark):
    """A row for each amount that is tied, not for each two within an allowance, which grow with the square."""
    credits = spark.range(400).selectExpr("10000 + 2 * id as amount_kobo")
    inflows = spark.range(400).selectExpr("10001 + 2 * id as expected_net_kobo", "if(id % 2 = 0, 500L, 0L) as allowance_kobo")
    tied = confirmation._tied(credits, inflows, 500)
    assert tied.count() <= 800 and tied.columns == ["amount_kobo"]
    apart = confirmation._tied(credits.selectExpr("amount_kobo * 1000 as amount_kobo"), inflows.selectExpr("expected_net_kobo * 1000 as expected_net_kobo", "allowance_kobo"), 500)
    assert apart.count() == 0


@pytest.mark.parametrize("seed, n, frame", [(5, 60, 10_000), (6, 60, 2), (9, 200, 2)])
def test_narrow_cells_leave_credits_open_and_lose_none(spark, monkeypatch, seed, n, frame):
    case = made(seed, n)
    monkeypatch.setattr(confirmation, "CELL", 1)
    monkeypatch.setattr(confirmation, "STRIP", 1)
    monkeypatch.setattr(confirmation, "FRAME", frame)
    opened = []
    settled = confirmation._settled
    monkeypatch.setattr(confirmation, "_settled", lambda rows: opened.append(rows.where("not settled").count()) or settled(rows))
    same(outcomes(spark, *case), plain(*case))
    assert opened[0] > 0


def test_a_cell_is_right_or_open(spark):
    """Chains of amounts over many cells: what a cell settles is what one cell over all of them does."""
    rnd = random.Random(4)
    for most, gap in ((10, 3), (10, 12), (10, 40)):
        amounts = [1000 + rnd.randrange(gap * 300) for _ in range(300)]
        inflows = [(f"i{k:03d}", a, rnd.choice([0, most // 2, most]), rnd.randrange(5)) for k, a in enumerate(amounts)]
        named = lambda: [(*x[:2], x[2]) for x in rnd.sample(inflows, rnd.choice([0, 0, 0, 1, 2]))]
        credits = [(f"c{k:03d}", max(1, rnd.choice(amounts) - rnd.randrange(most)), rnd.randrange(5), named(), None) for k in range(300)]
        early = [(k, a, allow, due * 2 * confirmation._SLACK) for k, a, allow, due in inflows]
        credits = [(k, a, at * 2 * confirmation._SLACK, sorted(names), pair) for k, a, at, names, pair in credits]
        whole: list = []
        confirmation._cell(-(10**9), 10**9, range(10**8), most, credits, early, whole)
        assert len(whole) == 300 and not any((r[2] or "").startswith("open") for r in whole)
        right, n = {r[0]: r for r in whole}, 0
        for begin in range(960, 1000 + gap * 300, 40):
            low, high, out = begin - 20, begin + 60, []
            confirmation._cell(low, high, range(begin, begin + 40), most, [c for c in credits if low <= c[1] < high], [i for i in early if low <= i[1] < high], out)
            for r in out:
                if not (r[2] or "").startswith("open"):
                    assert r == right[r[0]]
                    n += 1
        assert n > 100
