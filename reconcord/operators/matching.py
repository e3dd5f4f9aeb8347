"""Matching promises, settlement lines, inflows and bank lines.

Every rule that asks for exactly one partner is a count, never a pick.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

SLACK_MINUTES = 1440


def reference_match(lines: DataFrame, promises: DataFrame) -> DataFrame:
    """Each line with the number of promises of its (source, reference) and, if there is just one, its id."""
    per = promises.groupBy("source", "reference").agg(F.count("*").alias("n"), F.min("transaction_id").alias("only"))
    both = lines.join(per, ["source", "reference"], "left").fillna(0, ["n"])
    return both.select("idempotency_key", F.col("n").alias("n_promises"), F.when(F.col("n") == 1, F.col("only")).alias("transaction_id"))


def line_conclusion(matched: DataFrame) -> DataFrame:
    """Conclusion and confidence of reference-matched lines.

    ``matched`` has the line's gross_kobo, fee_kobo and status, the promise's
    promise_gross and state, and predicted (total fee, null without a contract).
    """
    waits = F.col("state").isin("authorized", "exception")
    part = (F.col("gross_kobo") > 0) & (F.col("gross_kobo") <= F.col("promise_gross"))
    whole = F.col("gross_kobo") == F.col("promise_gross")
    net = F.col("gross_kobo") - F.col("fee_kobo")
    reason = (
        F.when(F.col("status") == "reversed", F.when(~waits | ~part, "AMOUNT_MISMATCH").when(whole, "REVERSAL").otherwise("PARTIAL_REVERSAL"))
        .when(F.col("status") == "chargeback", F.when((F.col("state") != "settled") | ~part, "AMOUNT_MISMATCH").when(whole, "CHARGEBACK").otherwise("PARTIAL_CHARGEBACK"))
        .when(~waits, "AMOUNT_MISMATCH")
        .when(whole, F.when(F.col("predicted").isNull() | (F.col("predicted") == F.col("fee_kobo")), "EXACT_MATCH").otherwise("FEE_VARIANCE"))
        .when(F.col("predicted").isNotNull() & (F.col("promise_gross") - F.col("predicted") == net), "FEE_ADJUSTED_MATCH")
        .otherwise("AMOUNT_MISMATCH")
    )
    sure = F.when(F.col("reason").isin("FEE_VARIANCE", "PARTIAL_REVERSAL", "PARTIAL_CHARGEBACK"), 90).when(F.col("reason") == "FEE_ADJUSTED_MATCH", 99).when(F.col("reason") == "AMOUNT_MISMATCH", 0).otherwise(100)
    return matched.withColumn("reason", reason).withColumn("confidence_pct", sure)


def unallocated_payouts(payouts: DataFrame, inflows: DataFrame) -> DataFrame:
    """Payouts without an inflow of their key."""
    return payouts.join(inflows.select(F.col("inflow_key").alias("payout_reference")), "payout_reference", "left_anti")


def unallocated_lines(lines: DataFrame, allocated_keys: DataFrame, matched_keys: DataFrame) -> DataFrame:
    """Lines that neither an allocation nor a match's links name; both sides have idempotency_key."""
    return lines.join(allocated_keys, "idempotency_key", "left_anti").join(matched_keys, "idempotency_key", "left_anti")


def unmatched_bank_lines(lines: DataFrame, inflows: DataFrame) -> DataFrame:
    """Bank lines that confirm nothing; debits always stay."""
    used = inflows.where("confirmed_by is not null").select(F.col("confirmed_by").alias("idempotency_key")).distinct()
    return lines.where("direction = 'debit'").unionByName(lines.where("direction <> 'debit'").join(used, "idempotency_key", "left_anti"))


def confirmed_inflows(inflows: DataFrame, lines: DataFrame) -> DataFrame:
    """Confirmed inflows with the credit that confirmed them."""
    credit = lines.where("direction = 'credit' and amount_kobo > 0").select(F.col("idempotency_key").alias("confirmed_by"), F.col("amount_kobo").alias("credited_kobo"))
    return inflows.where("confirmed_by is not null").join(credit, "confirmed_by").select("inflow_key", "source", "expected_net_kobo", "confirmed_by", "credited_kobo")


def banked_inflows(inflows: DataFrame, entries: DataFrame, payouts: DataFrame) -> DataFrame:
    """Confirmed inflows with what the bank paid: the sum of the confirming transaction's entries on the bank account.

    Inflows of payouts with status ``returned`` are finished and left out, and
    so are those whose transaction has no such entry.
    """
    paid = entries.where("account_id = 'bank_account'").groupBy(F.col("transaction_id").alias("confirmed_by")).agg(F.sum("amount_kobo").alias("credited_kobo"))
    gone = payouts.where("status = 'returned'").select(F.col("payout_reference").alias("inflow_key"))
    live = inflows.where("confirmed_by is not null").join(gone, "inflow_key", "left_anti")
    return live.join(paid, "confirmed_by").select("inflow_key", "source", "confirmed_by", "credited_kobo", "value_date")


def identifiers(lines: DataFrame) -> DataFrame:
    """(idempotency_key, word): the words of the narration in upper case and the stated reference as it is."""
    words = lines.select("idempotency_key", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("narration"), F.lit(r"[A-Z0-9][A-Z0-9_-]{5,}"), F.lit(0)))).alias("word"))
    return words.select("idempotency_key", "word", F.lit(True).alias("token")).unionByName(lines.where("stated_reference is not null").select("idempotency_key", F.col("stated_reference").alias("word"), F.lit(False).alias("token")))


def bank_names(lines: DataFrame, inflows: DataFrame) -> DataFrame:
    """All (idempotency_key, inflow_key) where a credit names the inflow, by a word of the narration or the stated reference."""
    return line_names(lines.where("direction = 'credit' and amount_kobo > 0"), inflows)


def line_names(lines: DataFrame, inflows: DataFrame) -> DataFrame:
    """As ``bank_names``, of lines in either direction."""
    own = identifiers(lines)
    keys = inflows.select("inflow_key", F.upper("inflow_key").alias("word"), F.lit(True).alias("token")).unionByName(inflows.select("inflow_key", F.col("inflow_key").alias("word"), F.lit(False).alias("token")))
    return own.join(keys, ["word", "token"]).select("idempotency_key", "inflow_key").distinct()


def bank_match_named(lines: DataFrame, inflows: DataFrame) -> DataFrame:
    """Credits that name exactly one inflow, by a word of the narration or the stated reference."""
    named = bank_names(lines, inflows)
    return named.groupBy("idempotency_key").agg(F.count("*").alias("n"), F.min("inflow_key").alias("inflow_key")).where("n = 1").drop("n")


def not_before(credit_date: str, inflow_date: str) -> F.Column:
    return F.col(inflow_date).isNull() | (F.col(credit_date) >= F.col(inflow_date) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(SLACK_MINUTES)))


def bank_match_candidates(lines: DataFrame, inflows: DataFrame, allowance: int) -> DataFrame:
    """Credits with the inflows they may pay: up to ``allowance`` short and not before the value date.

    The tolerance join runs on bands of ``allowance + 1`` minor units, each
    inflow filed in the two bands that its credits can fall into.
    """
    band = allowance + 1
    c = lines.where("direction = 'credit' and amount_kobo > 0").select("idempotency_key", "amount_kobo", F.col("value_date").alias("credit_date"), F.expr(f"amount_kobo div {band}").alias("band"))
    i = inflows.select("inflow_key", "expected_net_kobo", F.col("value_date").alias("inflow_date"), F.explode(F.array_distinct(F.array(F.expr(f"expected_net_kobo div {band}"), F.expr(f"(expected_net_kobo - {allowance}) div {band}")))).alias("band"))
    short = F.col("expected_net_kobo") - F.col("amount_kobo")
    fits = c.join(i, "band").where(short.between(0, allowance) & not_before("credit_date", "inflow_date"))
    return fits.select("idempotency_key", "inflow_key", short.alias("short_kobo"))


def pair_equal_amounts(credits: DataFrame, inflows: DataFrame) -> DataFrame:
    """Pairs groups of two or more credits and inflows of one exact amount and equal number, first in first out.

    A group pairs only if its earliest credit may pay its latest inflow.
    """
    c = credits.groupBy("amount_kobo").agg(F.count("*").alias("n"), F.min("value_date").alias("credit_date"))
    i = inflows.groupBy(F.col("expected_net_kobo").alias("amount_kobo")).agg(F.count("*").alias("m"), F.max("value_date").alias("inflow_date"))
    good = c.join(i, "amount_kobo").where((F.col("n") >= 2) & (F.col("n") == F.col("m")) & not_before("credit_date", "inflow_date")).select("amount_kobo")
    order = lambda key: Window.partitionBy("amount_kobo").orderBy(F.coalesce("value_date", F.to_timestamp(F.lit("1970-01-01"))), key)
    left = credits.join(good, "amount_kobo", "left_semi").select("amount_kobo", "idempotency_key", F.row_number().over(order("idempotency_key")).alias("rn"))
    right = inflows.withColumn("amount_kobo", F.col("expected_net_kobo")).join(good, "amount_kobo", "left_semi").select("amount_kobo", "inflow_key", F.row_number().over(order("inflow_key")).alias("rn"))
    return left.join(right, ["amount_kobo", "rn"]).select("idempotency_key", "inflow_key", "amount_kobo")


def duplicate_credit(unmatched: DataFrame, banked: DataFrame) -> DataFrame:
    """Unmatched credits whose amount equals that of just one banked inflow."""
    per = banked.groupBy(F.col("credited_kobo").alias("amount_kobo")).agg(F.count("*").alias("n"), F.min("inflow_key").alias("inflow_key")).where("n = 1").drop("n")
    return unmatched.where("direction = 'credit' and amount_kobo > 0").join(per, "amount_kobo").select("idempotency_key", "inflow_key", "amount_kobo")


def duplicates_here(left: DataFrame, names: DataFrame, banked: DataFrame) -> DataFrame:
    """Credits left over that are the same money as a credit before them in the run: (idempotency_key, inflow_key).

    left: idempotency_key, amount_kobo; names: all pairs named; banked:
    inflow_key, confirmed_by, credited_kobo.  The only banked inflow that the
    credit names, else the only one banked of its amount, each time among those
    confirmed by an earlier key.
    """
    before = F.col("confirmed_by") < F.col("idempotency_key")
    named = left.select("idempotency_key").join(names, "idempotency_key").join(banked.select("inflow_key", "confirmed_by"), "inflow_key").where(before)
    named = named.groupBy("idempotency_key").agg(F.count("*").alias("n"), F.min("inflow_key").alias("by_name")).where("n = 1").drop("n")
    # of an amount just one is before a credit if the first is and the second is not
    w = Window.partitionBy("credited_kobo").orderBy("confirmed_by")
    two = banked.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy(F.col("credited_kobo").alias("amount_kobo"))
    two = two.agg(F.min(F.when(F.col("rn") == 1, F.col("confirmed_by"))).alias("first"), F.min(F.when(F.col("rn") == 2, F.col("confirmed_by"))).alias("second"), F.min(F.when(F.col("rn") == 1, F.col("inflow_key"))).alias("by_amount"))
    same = left.select("idempotency_key", "amount_kobo").join(two, "amount_kobo").where((F.col("first") < F.col("idempotency_key")) & (F.col("second").isNull() | (F.col("second") > F.col("idempotency_key")))).select("idempotency_key", "by_amount")
    return named.join(same, "idempotency_key", "full").select("idempotency_key", F.coalesce("by_name", "by_amount").alias("inflow_key"))


def returned_payout(debits: DataFrame, banked: DataFrame) -> DataFrame:
    """Debits that undo a confirmed inflow: one banked inflow of the amount, and one debit for it."""
    per = banked.groupBy(F.col("credited_kobo").alias("amount_kobo")).agg(F.count("*").alias("n"), F.min("inflow_key").alias("inflow_key")).where("n = 1").drop("n")
    hit = debits.where("direction = 'debit'").join(per, "amount_kobo")
    return hit.groupBy("inflow_key").agg(F.count("*").alias("n"), F.min("idempotency_key").alias("idempotency_key"), F.min("amount_kobo").alias("amount_kobo")).where("n = 1").drop("n")


def _nearest_rows(keep: int):
    """Fold of one part: its targets against its items and those carried over from other parts."""

    def fold(key: tuple, targets: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"target": pd.Series(dtype="int64"), "item": pd.Series(dtype="object"), "amount": pd.Series(dtype="int64"), "tie": pd.Series(dtype="object")})
        if not len(targets) or not len(items):
            return none
        rising = items.sort_values(["amount", "tie"], kind="stable")
        falling = items.sort_values(["amount", "tie"], ascending=[False, True], kind="stable")
        both = pd.concat([falling, rising], ignore_index=True)
        order = np.empty(len(both), np.int64)
        order[both["tie"].to_numpy(object).argsort(kind="stable")] = np.arange(len(both))
        amount, n = both["amount"].to_numpy(np.int64), len(items)
        a = targets["target"].to_numpy(np.int64)
        above = np.searchsorted(amount[n:], a, "left")  # items below the target, which lead the others in `falling` from n - above
        step = np.arange(keep)
        at = np.concatenate([(n - above)[:, None] + step, (n + above)[:, None] + step], 1)
        gone = np.concatenate([at[:, :keep] >= n, at[:, keep:] >= 2 * n], 1)
        at = np.where(gone, 0, at)
        far = np.where(gone, np.iinfo(np.int64).max, np.abs(amount[at] - a[:, None]))
        best = np.lexsort((order[at], far), axis=1)[:, :keep]
        row = np.repeat(np.arange(len(a)), best.shape[1])
        good = ~gone[row, best.ravel()]
        hit = at[row, best.ravel()][good]
        return pd.DataFrame({"target": a[row[good]], "item": both["item"].to_numpy(object)[hit], "amount": amount[hit], "tie": both["tie"].to_numpy(object)[hit]})

    return fold


def _edges(keep: int):
    """The items that each part needs from the others: the ``keep`` highest before it and the ``keep`` lowest after it."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        columns, out = ["grp", "item", "amount", "tie"], []
        own = dict(tuple(frame.groupby("part")))
        last = int(frame["parts"].iloc[0])
        for turn, rising in ((range(last + 1), False), (range(last, -1, -1), True)):
            carried = frame.iloc[:0]
            for k in turn:
                out.append(carried[columns].assign(part=k))
                if k in own:
                    carried = pd.concat([carried, own[k][own[k]["up"] != rising]]).sort_values(["amount", "tie"], ascending=[rising, True], kind="stable").head(keep)
        return pd.concat(out).astype({"part": "int32"})[["grp", "part", "item", "amount", "tie"]]

    return fold


def nearest(targets: DataFrame, items: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` items nearest to each target of their group, however far, by distance and then ``tie``.

    targets: grp, target; items: grp, item, amount, tie.  Rows (grp, target,
    item, amount, tie), once for each distinct target.

    Both are dealt into ranges of amount, at most ``keep`` items of one amount.
    A target needs only the ``keep`` items before and after it in the order of
    amounts; where a range ends too early, the nearest items of other ranges
    are carried over.  So nothing is compared in pairs.
    """
    parts = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.row_number().over(Window.partitionBy("grp", "amount").orderBy("tie")) <= keep
    # read several times below
    goods = staged(items.where("amount is not null").withColumn("first", first).where("first").drop("first"))
    wanted = staged(targets.where("target is not null").distinct())
    cuts = goods.select("amount").unionAll(wanted.select(F.col("target").alias("amount"))).agg(F.coalesce(F.percentile_approx("amount", [k / parts for k in range(1, parts)] or [0.5], 10_000), F.array().cast("array<bigint>")).alias("cuts"))
    part = lambda c: F.expr(f"cast(aggregate(cuts, 0, (n, x) -> n + if(x <= {c}, 1, 0)) as int)")
    goods = goods.crossJoin(F.broadcast(cuts)).select("grp", part("amount").alias("part"), "item", "amount", "tie")
    wanted = wanted.crossJoin(F.broadcast(cuts)).select("grp", part("target").alias("part"), "target")
    ends = None
    for up, order in ((False, F.col("amount").asc()), (True, F.col("amount").desc())):
        one = goods.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "part").orderBy(order, "tie"))).where(F.col("rn") <= keep).drop("rn").withColumn("up", F.lit(up))
        ends = one if ends is None else ends.unionByName(one)
    # up marks the highest items of a part, carried to later parts; the others go to earlier ones
    carried = ends.withColumn("parts", F.lit(parts)).groupBy("grp").applyInPandas(_edges(keep), "grp string, part int, item string, amount long, tie string")
    goods = goods.unionByName(carried)
    goods = goods.toDF(*goods.columns)  # new names for columns that both sides may have from one table
    found = wanted.groupBy("grp", "part").cogroup(goods.groupBy("grp", "part"))
    rows = _nearest_rows(keep)
    return found.applyInPandas(lambda key, t, i: rows(key, t, i).assign(grp=key[0]), "grp string, target long, item string, amount long, tie string")


def nearest_candidates(credits: DataFrame, inflows: DataFrame, keep: int, allowance: int = 0) -> DataFrame:
    """The ``keep`` inflows nearest in amount to each credit, however far: those within their bank-charge allowance first, then by distance and key.

    The allowance is the inflow's ``allowance_kobo`` where there is such a
    column, else ``allowance``.
    """
    own = F.col("allowance_kobo") if "allowance_kobo" in inflows.columns else F.lit(allowance)
    i = inflows.select(own.cast("string").alias("grp"), F.col("inflow_key").alias("item"), F.col("expected_net_kobo").cast("long").alias("amount"), F.col("inflow_key").alias("tie"))
    # the nearest of each allowance hold the nearest within it and the nearest of all
    groups = i.select("grp").distinct()
    c = credits.select(F.col("amount_kobo").cast("long").alias("target")).where("target is not null").distinct().crossJoin(F.broadcast(groups)).select("grp", "target")
    far = F.abs(F.col("amount") - F.col("target"))
    near = nearest(c, i, keep).withColumn("far_kobo", far).withColumn("beyond", (far > F.col("grp").cast("long")).cast("int"))
    w = Window.partitionBy("target").orderBy("beyond", "far_kobo", "item")
    best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return credits.select("idempotency_key", F.col("amount_kobo").cast("long").alias("target")).join(best, "target").select("idempotency_key", F.col("item").alias("inflow_key"), "far_kobo", "rank")


def _owed_in_order(promises: DataFrame) -> DataFrame:
    tie = F.concat(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS "), "transaction_id")
    return promises.where("owed_kobo > 0").select(F.col("source").alias("grp"), F.col("transaction_id").alias("item"), F.col("owed_kobo").cast("long").alias("amount"), tie.alias("tie"))


def nearest_promises(payouts: DataFrame, promises: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` open promises of its source nearest to each payout's gross, by distance, time and id."""
    far = F.abs(F.col("amount") - F.col("target"))
    near = nearest(payouts.select(F.col("source").alias("grp"), F.col("gross_kobo").cast("long").alias("target")), _owed_in_order(promises), keep).withColumn("far_kobo", far)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "target").orderBy("far_kobo", "tie")))
    own = payouts.select("payout_reference", F.col("source").alias("grp"), F.col("gross_kobo").cast("long").alias("target"))
    return own.join(best, ["grp", "target"]).select("payout_reference", F.col("item").alias("transaction_id"), "far_kobo", "rank")


def unattempted_promises(payouts: DataFrame, promises: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` largest open promises of each payout's source, for payouts whose search was not attempted."""
    w = Window.partitionBy("grp").orderBy(F.col("amount").desc(), "tie")
    top = _owed_in_order(promises).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return payouts.select("payout_reference", F.col("source").alias("grp")).join(F.broadcast(top), "grp").select("payout_reference", F.col("item").alias("transaction_id"), F.col("amount").alias("owed_kobo"), "rank")


def near_misses(credits: DataFrame, inflows: DataFrame, names: DataFrame, keep: int, allowance: int = 0) -> DataFrame:
    """``nearest_candidates`` with the signed difference, the kind of the inflow and why it was not taken.

    credits: idempotency_key, amount_kobo, value_date; inflows also value_date,
    spent (another credit of the run took it) and derived (made of settlement
    lines, not a payout); names: all pairs named.  The reasons, the first that
    holds: ambiguous (the credit names it and others), already_claimed,
    outside_window, amount_differs.
    """
    several = names.groupBy("idempotency_key").agg(F.count("*").alias("n")).where("n > 1").join(names, "idempotency_key").select("idempotency_key", "inflow_key", F.lit(True).alias("named"))
    near = nearest_candidates(credits, inflows, keep, allowance)
    c = credits.select("idempotency_key", "amount_kobo", F.col("value_date").alias("credit_date"))
    i = inflows.select("inflow_key", "expected_net_kobo", F.col("value_date").alias("inflow_date"), "spent", "derived")
    both = near.join(c, "idempotency_key").join(i, "inflow_key").join(several, ["idempotency_key", "inflow_key"], "left")
    early = ~F.coalesce(not_before("credit_date", "inflow_date"), F.lit(True))
    why = F.when(F.col("named"), "ambiguous").when(F.col("spent"), "already_claimed").when(early, "outside_window").otherwise("amount_differs")
    kind = F.when(F.col("derived"), "settlement_line").otherwise("payout")
    return both.select("idempotency_key", "inflow_key", kind.alias("kind"), (F.col("expected_net_kobo") - F.col("amount_kobo")).alias("difference_kobo"), why.alias("rejected_because"), "rank")


def promise_misses(payouts: DataFrame, promises: DataFrame, keep: int) -> DataFrame:
    """The promises that each payout came closest to: signed difference, reason and rank.

    payouts: source, payout_reference, gross_kobo, value_date, searched;
    promises: source, transaction_id, owed_kobo, occurred_at, escalates_at.
    Where the payout was searched the nearest, outside_window if they occurred
    after its value date or were overdue then, else amount_differs; where it
    was not, the largest, not_attempted.
    """
    reach = F.col("value_date").isNull() | ((F.col("occurred_at") <= F.col("value_date")) & (F.col("escalates_at").isNull() | (F.col("value_date") <= F.col("escalates_at"))))
    own = payouts.where("searched")
    near = nearest_promises(own, promises, keep).join(own.select("payout_reference", "gross_kobo", "value_date"), "payout_reference")
    near = near.join(promises.select("transaction_id", "owed_kobo", "occurred_at", "escalates_at"), "transaction_id")
    near = near.withColumn("rejected_because", F.when(reach, "amount_differs").otherwise("outside_window"))
    rest = payouts.where("not searched")
    large = unattempted_promises(rest, promises, keep).join(rest.select("payout_reference", "gross_kobo"), "payout_reference").withColumn("rejected_because", F.lit("not_attempted"))
    difference = (F.col("owed_kobo") - F.col("gross_kobo")).alias("difference_kobo")
    columns = ("payout_reference", "transaction_id", difference, "rejected_because", "rank")
    return near.select(*columns).unionByName(large.select(*columns))


def bank_line_collision(lines: DataFrame, existing: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Rows whose key exists: collision with the fields that differ, or plain duplicate."""
    old = existing.select(*key, *[F.col(c).alias(f"old_{c}") for c in compare])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in compare]))
    return lines.join(old, key).withColumn("differs", F.concat_ws(",", differs)).withColumn("kind", F.when(F.col("differs") == "", "duplicate").otherwise("collision"))


def dedupe(rows: DataFrame, seen: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All rows marked fresh (first of their key, not seen before) or duplicate."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    known = seen.select(*key).distinct().withColumn("known", F.lit(True))
    return rows.withColumn("first", first).join(known, key, "left").withColumn("fresh", F.col("first") & F.col("known").isNull()).drop("first", "known")
