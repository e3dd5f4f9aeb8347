"""Fee contracts and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import apply_bp


#: Contracts that are sent to every task, about 1 MB; more are joined by shuffles.
FEW = 10_000
_TERMS = ("contract_id", "percent_bp", "flat_kobo", "waived_below_kobo", "cap_kobo", "vat_bp")


def contract_asof(payments: DataFrame, contracts: DataFrame, key: str, at: str, few: int = FEW) -> DataFrame:
    """``payments`` with the contract in force at ``at``; a contract for the channel goes before one for all.

    Validity is half-open.  A payment without channel asks for 'unknown'.  Up to
    ``few`` contracts are gathered by source and looked up in the payment's row,
    so payments are not shuffled; beyond that both sides are joined by source.
    """
    channel = F.coalesce("channel", F.lit("unknown"))
    if contracts.limit(few + 1).count() <= few:
        listed = contracts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((F.col("channel") == "*").alias("any"), *_TERMS, "channel", "effective_from", "effective_to"))).alias("_contracts"))
        in_force = lambda c: ((c["channel"] == channel) | (c["channel"] == "*")) & (c["effective_from"] <= F.col(at)) & (c["effective_to"].isNull() | (F.col(at) < c["effective_to"]))
        both = payments.join(F.broadcast(listed), "source", "left").withColumn("_c", F.get(F.filter("_contracts", in_force), F.lit(0)))
        return both.select(*payments.columns, F.when(F.col("_c").isNotNull(), F.struct(*[F.col(f"_c.{t}").alias(t) for t in _TERMS])).alias("contract"))
    c = contracts.withColumnRenamed("channel", "c_channel").withColumnRenamed("source", "c_source")
    on = (F.col("source") == F.col("c_source")) & ((F.col("c_channel") == channel) | (F.col("c_channel") == "*")) & (F.col("effective_from") <= F.col(at)) & (F.col("effective_to").isNull() | (F.col(at) < F.col("effective_to")))
    best = F.struct((F.col("c_channel") == "*").alias("any"), "contract_id")
    found = payments.select(key, "source", "channel", at).join(c, on).groupBy(key).agg(F.min_by(F.struct(*_TERMS), best).alias("contract"))
    return payments.join(found, key, "left")


def fee_quote(priced: DataFrame, gross: str = "gross_kobo") -> DataFrame:
    """Adds fee_kobo, vat_kobo and total_kobo from the column ``contract``; null without a contract."""
    basis = F.abs(F.col(gross))
    c = F.col("contract")
    flat = F.when(basis < c["waived_below_kobo"], 0).otherwise(c["flat_kobo"])
    fee = F.least(apply_bp(basis, c["percent_bp"]) + flat, F.coalesce(c["cap_kobo"], F.lit(2**62)))
    out = priced.withColumn("fee_kobo", F.when(c.isNotNull(), fee).cast("long"))
    out = out.withColumn("vat_kobo", apply_bp(F.col("fee_kobo"), c["vat_bp"]))
    return out.withColumn("total_kobo", F.col("fee_kobo") + F.col("vat_kobo"))


def contract_overlap(contracts: DataFrame) -> DataFrame:
    """Each contract that an earlier one of its scope reaches into, with the one that reaches furthest (``before_id``).

    A contract ends before ``effective_to``; null is never.  Of equal starts
    the smaller id is the earlier.  One row a contract, however many overlap.
    """
    w = Window.partitionBy("source", "channel").orderBy("effective_from", "contract_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("effective_to", F.to_timestamp(F.lit("9999-01-01")))
    x = contracts.withColumn("before", F.max(F.struct(end.alias("reach"), F.col("contract_id").alias("id"))).over(w))
    return x.where("effective_from < before.reach").select("source", "channel", F.col("before.id").alias("before_id"), "contract_id")


def explain_allocations(allocations: DataFrame, promises: DataFrame, contracts: DataFrame, shares: DataFrame) -> DataFrame:
    """For each allocation (inflow_key, transaction_id, amount_kobo) the fee and VAT that the promise's contract predicts on the allocated amount, and the fee share observed.

    ``shares`` are the apportioned deductions.  Nulls say that no contract
    covered the promise, or that no fee was apportioned to it; rows stay.
    """
    own = promises.select("transaction_id", "source", "channel", "occurred_at")
    both = allocations.select("inflow_key", "transaction_id", "amount_kobo").join(own, "transaction_id", "left")
    both = both.withColumn("_row", F.concat_ws(chr(31), "inflow_key", "transaction_id"))
    priced = fee_quote(contract_asof(both, contracts, "_row", "occurred_at"), "amount_kobo")
    scope = contracts.groupBy("contract_id").agg(F.first("channel").alias("channel"))
    fee = shares.where("account_id = 'fees_expense' and share_kobo <> 0").groupBy("inflow_key", "transaction_id").agg(F.sum("share_kobo").alias("observed_fee_kobo"))
    priced = priced.drop("channel").withColumn("contract_id", F.col("contract.contract_id")).join(scope, "contract_id", "left")
    return priced.join(fee, ["inflow_key", "transaction_id"], "left").select(
        "inflow_key", "transaction_id", "contract_id", "channel", F.col("fee_kobo").alias("expected_fee_kobo"), F.col("vat_kobo").alias("expected_vat_kobo"), "observed_fee_kobo"
    )
