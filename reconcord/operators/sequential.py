"""The order-dependent matchers.

Counts decide what they can before any fold.  What is left is folded in order,
one group of records that may claim the same things a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

MAX_ITEMS, MAX_SUBSET, MAX_STEPS = 24, 12, 200_000


def unique_subset_sum(values: list[int], target: int, max_items: int = MAX_ITEMS, max_subset: int = MAX_SUBSET, max_steps: int = MAX_STEPS) -> tuple[str, list[int]]:
    """(outcome, indexes): 'unique' with the only subset that makes the target, else 'none', 'undecidable' or 'not_attempted'."""
    if target <= 0:
        return "none", []
    own = [i for i, v in enumerate(values) if v > 0]
    if len(own) > max_items:
        return "not_attempted", []
    if (1 << len(own)) - 1 <= max_steps:  # as many steps as a search could take: it would come to its end
        return _from_halves(values, [i for i in own if values[i] <= target], target, max_subset)
    rest = [0] * (len(own) + 1)
    for k in range(len(own) - 1, -1, -1):
        rest[k] = rest[k + 1] + values[own[k]]
    found: list[list[int]] = []
    steps = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, target, ())]
    while stack:
        k, left, taken = stack.pop()
        if left == 0:
            found.append([own[i] for i in taken])
            if len(found) == 2:
                return "undecidable", []
            continue
        if k == len(own) or left < 0 or len(taken) >= max_subset or rest[k] < left:
            continue
        steps += 1
        if steps > max_steps:
            return "undecidable", []
        stack.append((k + 1, left, taken))
        stack.append((k + 1, left - values[own[k]], (*taken, k)))
    return ("unique", found[0]) if found else ("none", [])


def _from_halves(values: list[int], own: list[int], target: int, max_subset: int) -> tuple[str, list[int]]:
    """What a whole search finds, from the sums of each half of the items ``own`` (of values from 1 to the target)."""
    total = sum([values[i] for i in own])
    if total <= target:
        return ("unique", own) if total == target and len(own) <= max_subset else ("none", [])
    half = len(own) // 2
    first, second = [0], [0]  # the place of a sum has a bit for each of its items
    for i in own[:half]:
        v = values[i]
        first += [x + v for x in first]
    for i in own[half:]:
        v = values[i]
        second += [x + v for x in second]
    wanted: dict[int, list[int]] = {}
    for place, x in enumerate(first):
        wanted.setdefault(target - x, []).append(place)
    found = [low | (high << half) for high, x in enumerate(second) if x in wanted for low in wanted[x]]
    if found and len(own) > max_subset:
        found = [places for places in found if places.bit_count() <= max_subset]
    if len(found) != 1:
        return ("undecidable" if found else "none"), []
    return "unique", [i for k, i in enumerate(own) if found[0] >> k & 1]


def predicted_fee(owed: int, terms: tuple) -> int:
    """Total fee of an amount under (percent_bp, flat_kobo, waived_below_kobo, cap_kobo, vat_bp)."""
    bp, flat, waived, cap, vat = terms
    fee = (owed * bp + 5000) // 10000 + (0 if owed < waived else flat)
    fee = fee if cap is None else min(fee, cap)
    return fee + (fee * vat + 5000) // 10000


def solve(owed: list[int], terms: list[tuple | None], gross: int, net: int) -> tuple[str, list[int]]:
    """The only subset that makes the gross; if there is none, the only one that makes the net after predicted fees."""
    if not owed:
        return "none", []
    state, chosen = unique_subset_sum(owed, gross)
    if state != "none" or not any(terms):
        return state, chosen
    after = [o if t is None else o - predicted_fee(o, t) for o, t in zip(owed, terms, strict=True)]
    state, chosen = unique_subset_sum(after, net)
    return (state, chosen) if state == "unique" else ("none", [])


def plain(column: pa.Array | pa.ChunkedArray) -> list:
    """The integers of a column; nulls are None."""
    column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    if not column.null_count:
        return column.to_numpy().tolist()
    return [x if valid else None for x, valid in zip(column.fill_null(0).to_numpy().tolist(), column.is_valid().to_numpy().tolist(), strict=True)]


_TERMS = ("percent_bp", "flat_kobo", "waived_below_kobo", "cap_kobo", "vat_bp")


def _attempts(promises: DataFrame, payouts: DataFrame, rounds: int) -> DataFrame:
    """Adds ``near`` and ``searched`` to the payouts: whether the search for them can begin at all.

    A search is not attempted with over MAX_ITEMS promises in reach, and then
    claims nothing; each search that is attempted claims at most MAX_SUBSET.  So
    a payout with more promises in reach than MAX_ITEMS and MAX_SUBSET for each
    attempted one nearby is decided by counts alone.  The attempted ones are
    found from those that start within MAX_ITEMS, on one row a source and day.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    seen = promises.where("owed_kobo > 0")
    span = seen.groupBy("source").agg(F.max(F.coalesce(day("escalates_at"), F.lit(10**6)) - day("occurred_at")).alias("span"), F.count("*").alias("all"))
    p = payouts.withColumn("day", day("value_date"))
    one = lambda df, at, what: df.select("source", at.alias("day"), *[F.lit(int(c == what)).alias(c) for c in ("begun", "ended", "due")]).where("day is not null")
    marks = one(seen, day("occurred_at"), "begun").unionByName(one(seen, day("escalates_at"), "ended")).unionByName(one(p, F.col("day"), "due"))
    axis = marks.groupBy("source", "day").agg(*[F.sum(c).alias(c) for c in ("begun", "ended", "due")])
    rising = Window.partitionBy("source").orderBy("day")
    within = F.sum("begun").over(rising) - F.col("begun") - F.sum("ended").over(rising)
    axis = axis.withColumn("within", within).where("due > 0").join(span, "source", "left").fillna(0, ["span", "all"])
    free = p.where("day is null").groupBy("source").agg(F.count("*").alias("undated"))
    axis = axis.join(free, "source", "left").fillna(0, ["undated"])
    # promises of other days count for an undated payout too, so it is attempted unless a whole source is small
    near = F.lit(0)
    for _ in range(rounds):
        axis = axis.withColumn("open", F.when(F.col("within") <= MAX_ITEMS + MAX_SUBSET * near, F.col("due")).otherwise(0))
        around = F.sum("open").over(Window.partitionBy("source").orderBy("day").rangeBetween(-SPAN_DAYS, SPAN_DAYS))
        near = F.when(F.col("span") <= SPAN_DAYS, around).otherwise(F.sum("due").over(Window.partitionBy("source"))) + F.col("undated")
        axis = axis.withColumn("near", near)
        near = F.col("near")
    # what has not settled after these rounds is searched
    every = F.sum("due").over(Window.partitionBy("source")) + F.col("undated")
    grown = F.when(F.col("within") <= MAX_ITEMS + MAX_SUBSET * F.col("near"), F.col("due")).otherwise(0) != F.col("open")
    loose = F.max(grown.cast("int")).over(Window.partitionBy("source")) == 1
    axis = axis.withColumn("near", F.when(loose, every).otherwise(F.col("near")))
    axis = axis.select("source", "day", "near", (F.col("within") <= MAX_ITEMS + MAX_SUBSET * F.col("near")).alias("searched"))
    total = span.join(p.groupBy("source").agg(F.count("*").alias("due")), "source").select("source", (F.col("all") <= MAX_ITEMS + MAX_SUBSET * F.col("due")).alias("few"), F.col("due").alias("every"))
    out = p.join(axis, ["source", "day"], "left").join(total, "source", "left")
    searched = F.when(F.col("day").isNull(), F.coalesce("few", F.lit(True))).otherwise(F.col("searched"))
    return out.withColumn("searched", searched).withColumn("near", F.coalesce("near", "every", F.lit(0))).drop("few", "every")


#: Days that a payout may lie from another one and still share a promise, where all promises escalate within them.
SPAN_DAYS = 31
#: Days of promises that are joined to payouts at once.
WEEK_DAYS = 8
#: Rows from which on stretches of time are given to another frame.
FRAME = 20_000
#: Rounds after which all payouts of a source count as attempted.
ROUNDS = 2


def allocate(promises: DataFrame, payouts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Allocates promises to payouts in the order of the payouts' references.

    promises: source, transaction_id, owed_kobo, occurred_at, escalates_at and, where fees are predicted, contract
    payouts:  source, payout_reference, gross_kobo, expected_net_kobo, derived_net_kobo, value_date

    Rows (source, payout_reference, reason, transaction_id, amount_kobo), one for
    each promise allocated, or one without promise for a payout that has none;
    ``allocation_confidence`` rates the reasons.  A payout takes the only subset of open, reachable
    promises that makes its gross, or its net after predicted fees; else a part
    of the only promise that is large enough; else it is an exception.  Promises
    are reachable if they occurred by the value date and were not overdue then.

    Payouts with far too many promises in reach are decided by counts.  The
    others count the promises in their reach, a number that is bounded for each,
    and are folded by stretches of time with the promises of the stretch: no
    promise is in reach of two stretches.  A frame takes stretches until its
    payouts have counted ``FRAME`` promises.
    """
    schema = "source string, payout_reference string, reason string, transaction_id string, amount_kobo long"
    if "contract" in promises.columns:
        promises = promises.select("*", *[F.col(f"contract.{t}").cast("long").alias(t) for t in _TERMS])
    else:
        promises = promises.select("*", *[F.lit(None).cast("long").alias(t) for t in _TERMS])
    # read several times below
    week = lambda c: F.floor(F.unix_date(F.to_date(c)) / WEEK_DAYS)
    goods = staged(promises.where("owed_kobo > 0").select("source", "transaction_id", "owed_kobo", "occurred_at", "escalates_at", *_TERMS).withColumn("own_day", F.to_date("occurred_at")))
    alone = F.when(F.col("expected_net_kobo") != F.col("derived_net_kobo"), "PAYOUT_UNBALANCED").when((F.col("gross_kobo") == 0) & (F.col("expected_net_kobo") > 0), "RESERVE_RELEASED")
    tagged = staged(payouts.withColumn("alone", alone))
    tried = staged(_attempts(goods, tagged.where("alone is null").drop("alone", "derived_net_kobo"), rounds))
    bare = lambda df, reason: df.select("source", "payout_reference", reason.alias("reason"), F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("long").alias("amount_kobo"))

    day_span = goods.groupBy("source").agg(F.max(F.coalesce(F.datediff("escalates_at", "own_day"), F.lit(10**6))).alias("span"), F.min("own_day").alias("first"), F.max("own_day").alias("last"))
    searched = tried.where("searched").join(day_span, "source")
    till = F.when(F.col("value_date").isNull(), F.col("last")).otherwise(F.least(F.to_date("value_date"), F.col("last")))
    since = F.when(F.col("value_date").isNull(), F.col("first")).otherwise(F.greatest(F.col("first"), F.date_sub(F.to_date("value_date"), F.least("span", F.lit(40_000)).cast("int"))))
    reach = searched.withColumn("till", till).withColumn("since", since).where("since <= till").withColumn("week", F.explode(F.sequence(week("since"), week("till"))))
    ok = F.col("value_date").isNull() | ((F.col("occurred_at") <= F.col("value_date")) & (F.col("escalates_at").isNull() | (F.col("value_date") <= F.col("escalates_at"))))
    own = ("source", "payout_reference", "gross_kobo", "expected_net_kobo", "value_date", "near")
    weeks = goods.withColumn("week", week("own_day"))
    pairs = reach.select(*own, "week").join(weeks.select("source", "week", "occurred_at", "escalates_at"), ["source", "week"]).where(ok)
    size = staged(pairs.groupBy(*own).agg(F.count("*").alias("n"), F.min("occurred_at").alias("low"), F.max("occurred_at").alias("high")))
    decided = bare(tagged.where("alone is not null"), F.col("alone")).unionByName(bare(tried.where("not searched"), F.lit("BATCH_TOO_LARGE")))
    if not size.head(1):  # no promise is in reach of any search
        return decided.unionByName(bare(tried.where("searched"), F.lit("PHANTOM_CREDIT")))
    # payouts that share a promise overlap in the time from their first promise to their last one
    many = F.col("n") > MAX_ITEMS + MAX_SUBSET * F.col("near")
    order = Window.partitionBy("source").orderBy("low", "payout_reference")
    apart = F.coalesce((F.col("low") > F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    # of several stretches with few rows one task's frame is made: the fold of one touches nothing of another
    rows_before = F.sum("n").over(order) - F.col("n")
    begins = F.when((F.col("apart") == 1) | (F.col("rows_before") == 0), F.col("rows_before"))
    islands = size.where(~many).withColumn("apart", apart).withColumn("rows_before", rows_before).withColumn("island", F.floor(F.max(begins).over(order) / FRAME))
    islands = staged(islands.select(*own, "low", "high", "island"))
    span_of = islands.groupBy("source", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    claimed = span_of.withColumn("week", F.explode(F.sequence(week("low"), week("high")))).join(weeks, ["source", "week"]).where("occurred_at between low and high")
    frame = [F.col(c).alias(c) for c in ("source", "island")]  # columns of their own on each side
    claimed = claimed.select(*frame, "transaction_id", "owed_kobo", F.unix_micros("occurred_at").alias("at"), F.unix_micros("escalates_at").alias("till"), *_TERMS)

    def fold(payouts: pa.Table, promises: pa.Table) -> pa.Table:
        payouts, promises = payouts.sort_by("payout_reference"), promises.sort_by([("at", "ascending"), ("transaction_id", "ascending")])
        at, till, owed = (plain(promises[c]) for c in ("at", "till", "owed_kobo"))
        terms = [None if t[0] is None else t for t in zip(*[plain(promises[c]) for c in _TERMS], strict=True)]
        ended, endless = [k for k, x in enumerate(till) if x is not None], [k for k, x in enumerate(till) if x is None]
        span = max((till[k] - at[k] for k in ended), default=0)
        at_ended, at_endless = [at[k] for k in ended], [at[k] for k in endless]
        rows, reasons, of, kobo = [], [], [], []

        def add(row: int, reason: str, k: int | None = None, amount: int | None = None) -> None:
            rows.append(row), reasons.append(reason), of.append(k), kobo.append(amount)

        for row, (gross, net, day) in enumerate(zip(*[plain(payouts[c]) for c in ("gross_kobo", "expected_net_kobo", "day")], strict=True)):
            if day is None:
                near = [k for k, left in enumerate(owed) if left > 0]
            else:
                near = [k for k in ended[bisect_left(at_ended, day - span):bisect_right(at_ended, day)] if owed[k] > 0 and day <= till[k]]
                if endless:
                    near = sorted(near + [k for k in endless[:bisect_right(at_endless, day)] if owed[k] > 0])
            state, chosen = solve([owed[k] for k in near], [terms[k] for k in near], gross, net)
            if state == "not_attempted":
                add(row, "BATCH_TOO_LARGE")
            elif state == "unique":
                for k in [near[c] for c in chosen]:
                    add(row, "PAYOUT_MATCH", k, owed[k])
                    owed[k] = 0
            else:
                roomy = [k for k in near if owed[k] > gross]
                if len(roomy) == 1 and gross > 0:
                    add(row, "PARTIAL_PAYOUT_MATCH", roomy[0], gross)
                    owed[roomy[0]] -= gross
                else:
                    add(row, "PHANTOM_CREDIT")
        taken = payouts.select(["source", "payout_reference"]).take(pa.array(rows, pa.int64()))
        columns = (pa.array(reasons, pa.string()), promises["transaction_id"].take(pa.array(of, pa.int64())), pa.array(kobo, pa.int64()))
        return pa.table([*taken.columns, *columns], ["source", "payout_reference", "reason", "transaction_id", "amount_kobo"])

    rows = islands.select(*frame, "payout_reference", "gross_kobo", "expected_net_kobo", F.unix_micros("value_date").alias("day"))
    folded = rows.groupBy("source", "island").cogroup(claimed.groupBy("source", "island")).applyInArrow(fold, schema)
    none = tried.where("searched").drop("near").join(size.select("source", "payout_reference", "n", "near"), ["source", "payout_reference"], "left").where(F.col("n").isNull() | many)
    return folded.unionByName(decided).unionByName(bare(none, F.when(F.col("n").isNull(), "PHANTOM_CREDIT").otherwise("BATCH_TOO_LARGE")))


def allocation_confidence(reason: F.Column) -> F.Column:
    """Per cent: a whole payout and a released reserve are certain, a part of a promise is inferred."""
    return F.when(reason.isin("PAYOUT_MATCH", "RESERVE_RELEASED"), 100).when(reason == "PARTIAL_PAYOUT_MATCH", 80).otherwise(0)


def line_claims(lines: DataFrame, promises: DataFrame) -> DataFrame:
    """What settlement lines without a payout claim of the open promises, in the order of their keys.

    lines:    idempotency_key, source, reference, gross_kobo, status, settled_at
    promises: source, reference, transaction_id, state, gross_kobo, owed_kobo (what is left, maybe nothing)

    Rows (idempotency_key, reason, transaction_id, amount_kobo, inflow_key,
    confidence_pct).  A line needs the only promise of its reference.  One that
    undoes a payment claims its own amount, any other all that is left, as part
    of the batch of its source and day.  Lines of one promise only take from it,
    so a running sum tells what each of them finds.
    """
    per = promises.groupBy("source", "reference").agg(F.count("*").alias("n"), F.min(F.struct("transaction_id", "state", F.col("gross_kobo").alias("promise_gross"), "owed_kobo")).alias("p"))
    both = lines.join(per, ["source", "reference"], "left").select("idempotency_key", "source", "gross_kobo", "status", "settled_at", F.when(F.col("n") == 1, F.col("p")).alias("p"))
    both = both.select("*", *[F.col(f"p.{c}").alias(c) for c in ("transaction_id", "state", "promise_gross", "owed_kobo")]).drop("p")
    waits, part = F.col("state").isin("authorized", "exception"), (F.col("gross_kobo") > 0) & (F.col("gross_kobo") <= F.col("promise_gross"))
    kind = (
        F.when(F.col("status") == "reversed", F.when(waits & part, "REVERSAL").otherwise("AMOUNT_MISMATCH"))
        .when(F.col("status") == "chargeback", F.when((F.col("state") == "settled") & part, "CHARGEBACK").otherwise("AMOUNT_MISMATCH"))
        .otherwise(F.when(waits, "BATCH_MATCH").otherwise("AMOUNT_MISMATCH"))
    )
    one = both.where("transaction_id is not null").withColumn("kind", kind)
    takes = F.when(F.col("kind") == "BATCH_MATCH", F.col("owed_kobo")).when(F.col("kind") == "AMOUNT_MISMATCH", 0).otherwise(F.col("gross_kobo"))
    before = F.coalesce(F.sum(takes).over(Window.partitionBy("transaction_id").orderBy("idempotency_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("left", F.col("owed_kobo") - before)
    reason = F.when(F.col("left") <= 0, "PHANTOM_CREDIT").when(F.col("kind").isin("BATCH_MATCH", "AMOUNT_MISMATCH"), F.col("kind")).otherwise(F.concat(F.when(F.col("gross_kobo") < F.col("promise_gross"), "PARTIAL_").otherwise(""), "kind"))
    one = one.withColumn("reason", reason)
    amount = F.when(F.col("reason") == "BATCH_MATCH", F.col("left")).when(~F.col("reason").isin("PHANTOM_CREDIT", "AMOUNT_MISMATCH"), F.col("gross_kobo"))
    batch = F.concat_ws(":", F.lit("derived"), "source", F.coalesce(F.to_date("settled_at").cast("string"), F.lit("undated")))
    key = F.when(F.col("reason") == "BATCH_MATCH", batch).when(amount.isNotNull(), F.col("idempotency_key"))
    sure = F.when(F.col("reason") == "BATCH_MATCH", 80).when(F.col("reason").startswith("PARTIAL"), 90).when(amount.isNotNull(), 100).otherwise(0)
    found = one.select("idempotency_key", "reason", F.when(F.col("reason") != "PHANTOM_CREDIT", F.col("transaction_id")).alias("transaction_id"), amount.alias("amount_kobo"), key.alias("inflow_key"), sure.alias("confidence_pct"))
    lone = both.where("transaction_id is null").select("idempotency_key", F.lit("PHANTOM_CREDIT").alias("reason"), "transaction_id", F.lit(None).cast("long").alias("amount_kobo"), F.lit(None).cast("string").alias("inflow_key"), F.lit(0).alias("confidence_pct"))
    return found.unionByName(lone)


def leftovers(promises: DataFrame, claims: DataFrame, as_of: F.Column) -> DataFrame:
    """What becomes of promises with something left after a run's claims (transaction_id, amount_kobo).

    Rows (transaction_id, reason, left_kobo, deferred): PARTIAL_SETTLEMENT where
    a part was claimed, PENDING_T_PLUS_N until the deadline and its grace are
    over, then MISSING_SETTLEMENT, the only one that is not put off.
    """
    used = claims.groupBy("transaction_id").agg(F.sum("amount_kobo").alias("used"))
    own = promises.select("transaction_id", "state", "owed_kobo", "escalates_at").where(~F.col("state").isin("settled", "reversed"))
    rest = own.join(used, "transaction_id", "left").fillna(0, ["used"]).withColumn("left_kobo", F.col("owed_kobo") - F.col("used")).where("left_kobo > 0")
    late = F.coalesce(as_of > F.col("escalates_at"), F.lit(False))
    reason = F.when(F.col("used") > 0, "PARTIAL_SETTLEMENT").when(late, "MISSING_SETTLEMENT").otherwise("PENDING_T_PLUS_N")
    return rest.select("transaction_id", reason.alias("reason"), "left_kobo", (reason != "MISSING_SETTLEMENT").alias("deferred"))


def confirm(inflows: DataFrame, credits: DataFrame, named: DataFrame, candidates: DataFrame, allowance: int = 0) -> DataFrame:
    """Confirms inflows by bank credits, in the order of the credits' keys.

    named (idempotency_key, inflow_key; all pairs, also of a credit that names
    several) and candidates (idempotency_key, inflow_key, short_kobo) come from
    the set-based joins.  The fold runs per connected component of these pairs,
    so unrelated credits are other tasks.
    Rows (idempotency_key, inflow_key, how): named, by amount, with a bank
    charge, or 'amount_set' where as many unnamed credits as inflows share an
    amount; without inflow 'ambiguous' where several fit, or 'amount_mismatch'
    where the inflow named is not within ``allowance`` of the credit.
    """
    from .graph import connected
    from .matching import pair_equal_amounts

    free = credits.join(named.select("idempotency_key"), "idempotency_key", "left_anti"), inflows.join(named.select("inflow_key"), "inflow_key", "left_anti")
    pairs = pair_equal_amounts(*free).select("idempotency_key", "inflow_key", F.lit(0).cast("long").alias("short_kobo"), F.lit("set").alias("kind"))
    short = (F.col("expected_net_kobo") - F.col("amount_kobo")).alias("short_kobo")
    names = named.join(credits.select("idempotency_key", "amount_kobo"), "idempotency_key").join(inflows.select("inflow_key", "expected_net_kobo"), "inflow_key").select("idempotency_key", "inflow_key", short, F.lit("named").alias("kind"))
    all_ = candidates.select("idempotency_key", "inflow_key", F.col("short_kobo").cast("long"), F.lit("amount").alias("kind")).unionByName(names).unionByName(pairs)
    edges = all_.select("idempotency_key", "inflow_key").distinct()
    comp = connected(edges.select(F.concat(F.lit("c:"), "idempotency_key").alias("a"), F.concat(F.lit("i:"), "inflow_key").alias("b")))
    rows = all_.join(comp.select(F.col("id"), "component"), F.concat(F.lit("c:"), F.col("idempotency_key")) == F.col("id")).drop("id")
    rows = rows.join(credits.select("idempotency_key"), "idempotency_key", "left_semi").join(inflows.select("inflow_key"), "inflow_key", "left_semi")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        spent: set = set()
        out = []
        by: dict[str, dict] = {}
        for credit, inflow, short, kind in frame[["idempotency_key", "inflow_key", "short_kobo", "kind"]].itertuples(index=False, name=None):
            by.setdefault(credit, {}).setdefault((inflow, kind), int(short))
        for credit in sorted(by):
            open_ = [(inflow, kind, short) for (inflow, kind), short in by[credit].items() if inflow not in spent]
            names, loose, pair = ([x for x in open_ if x[1] == kind] for kind in ("named", "amount", "set"))
            pick, how = None, ""
            if names:
                pick, how = (names[0], "named") if len(names) == 1 else (None, "")
            elif len(loose) == 1:
                pick = loose[0]
                how = "amount" if pick[2] == 0 else "bank_charge"
            elif pair:
                pick, how = pair[0], "amount_set"
            if how == "named" and not 0 <= pick[2] <= allowance:
                out.append((credit, None, "amount_mismatch"))
            elif pick is not None:
                out.append((credit, pick[0], how))
                spent.add(pick[0])
            elif len(open_):
                out.append((credit, None, "ambiguous"))
        return pd.DataFrame(out, columns=["idempotency_key", "inflow_key", "how"])

    return rows.groupBy("component").applyInPandas(fold, "idempotency_key string, inflow_key string, how string")
