"""Payout arithmetic, allocation shares and derived inflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Account of each kind of adjustment.
ADJUSTMENT_ACCOUNTS = {
    "fee": "fees_expense", "tax": "taxes_withheld", "reserve": "psp_reserve", "reserve_release": "psp_reserve",
    "penalty": "penalties", "refund": "reversals", "chargeback": "chargebacks",
}


def payout_arithmetic(payouts: DataFrame, adjustments: DataFrame, *kept: str) -> DataFrame:
    """Derived net, what the declared net leaves unexplained, and whether it is consistent, behind the columns ``kept`` of the payouts."""
    cut = adjustments.groupBy("payout_reference").agg(F.sum("kobo").alias("cut"))
    out = payouts.join(cut, "payout_reference", "left").fillna(0, ["cut"]).withColumn("derived_net_kobo", F.col("gross_kobo") - F.col("cut"))
    unexplained = F.col("expected_net_kobo") - F.col("derived_net_kobo")
    return out.select("payout_reference", *kept, "derived_net_kobo", unexplained.alias("unexplained_kobo"), (unexplained == 0).alias("consistent"))


def adjustment_entries(adjustments: DataFrame) -> DataFrame:
    """Sum per payout and account without zeros; position is that of the account's first adjustment."""
    kinds = F.create_map(*[F.lit(x) for kv in ADJUSTMENT_ACCOUNTS.items() for x in kv])
    per = adjustments.withColumn("account_id", kinds[F.col("kind")]).groupBy("payout_reference", "account_id")
    return per.agg(F.sum("kobo").alias("kobo"), F.min("position").alias("position")).where("kobo <> 0")


def apportion(shares: DataFrame, totals: DataFrame, group: str, item: str, weight: str = "weight", total: str = "total_kobo") -> DataFrame:
    """Splits each group's total over its items by weight, exactly, by largest remainder.

    ``shares`` has (group, item, weight), ``totals`` (group, account_id, total).
    Ties go to the smaller item; a group of zero weight gets zeros; signs are kept.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    weights = shares.groupBy(group).agg(F.sum(weight).alias("all_weight"))
    x = totals.join(weights, group).join(shares, group).withColumn("mag", F.abs(wide(total)))
    exact = F.expr(f"case when all_weight > 0 then cast(cast(mag as decimal(19,0)) * cast({weight} as decimal(19,0)) as decimal(38,0)) div cast(all_weight as decimal(19,0)) else 0 end")
    x = x.withColumn("base", exact.cast("long")).withColumn("rest", F.when(F.col("all_weight") > 0, (F.col("mag").cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")) - F.col("base").cast("decimal(19,0)") * F.col("all_weight").cast("decimal(19,0)")))
    spare = F.col("mag") - F.sum("base").over(Window.partitionBy(group, "account_id"))
    rank = F.row_number().over(Window.partitionBy(group, "account_id").orderBy(F.desc("rest"), item))
    kobo = F.signum(wide(total)).cast("long") * (F.col("base") + F.when((F.col("all_weight") > 0) & (rank <= spare), 1).otherwise(0))
    return x.withColumn("share_kobo", kobo.cast("long")).select(group, "account_id", item, "share_kobo")


def inflow_from_lines(lines: DataFrame) -> DataFrame:
    """One derived inflow for each source and settled day (or 'undated') of lines without a payout."""
    day = F.coalesce(F.to_date("settled_at").cast("string"), F.lit("undated"))
    own = lines.where("payout_reference is null").withColumn("inflow_key", F.concat_ws(":", F.lit("derived"), "source", day))
    return own.groupBy("inflow_key", "source").agg(
        F.sum("gross_kobo").alias("gross_kobo"), F.sum(F.col("gross_kobo") - F.col("fee_kobo")).alias("expected_net_kobo"), F.sum("fee_kobo").alias("fee_kobo"), F.count("*").alias("n_lines")
    )


def inflow_from_payouts(allocations: DataFrame, payouts: DataFrame) -> DataFrame:
    """One inflow for each allocated payout; its gross is what was allocated."""
    gross = allocations.groupBy(F.col("inflow_key").alias("payout_reference")).agg(F.sum("amount_kobo").alias("gross_kobo"))
    return payouts.drop("gross_kobo").join(gross, "payout_reference").withColumnRenamed("payout_reference", "inflow_key")


def inflow_shortfall(inflows: DataFrame, deductions: DataFrame) -> DataFrame:
    cut = deductions.groupBy("inflow_key").agg(F.sum("kobo").alias("cut"))
    return inflows.join(cut, "inflow_key", "left").fillna(0, ["cut"]).select("inflow_key", (F.col("gross_kobo") - F.col("cut") - F.col("expected_net_kobo")).alias("shortfall_kobo"))
