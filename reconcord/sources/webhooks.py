"""Webhook deliveries to canonical payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import naira_to_kobo

#: Where each sender keeps a payment's fields; amounts in minor units or in naira.
SHAPES = {
    "paystack": {"kind": "event", "reference": "data.reference", "kobo": "data.amount", "naira": None, "currency": "data.currency", "status": "data.status", "channel": "data.channel", "at": "data.paid_at"},
    "flutterwave": {"kind": "type", "reference": "data.reference", "kobo": None, "naira": "data.amount", "currency": "data.currency", "status": "data.status", "channel": "data.payment_method.type", "at": "data.created_datetime"},
    "nomba": {"kind": "event_type", "reference": "data.transaction.transactionId", "kobo": None, "naira": "data.transaction.transactionAmount", "currency": None, "status": "data.transaction.type", "channel": "data.transaction.type", "at": "data.transaction.time"},
}
SUCCESS = ("success", "successful", "succeeded", "paid", "payment_success")


def scan_webhooks(deliveries: DataFrame) -> DataFrame:
    """Deliveries (source, body, verified) with result: payment, unverified, ignored or rejected."""
    j = lambda p: F.get_json_object("body", f"$.{p}") if p else F.lit(None).cast("string")

    def pick(name: str) -> F.Column:
        out = F.lit(None).cast("string")
        for source, shape in SHAPES.items():
            out = F.when(F.col("source") == source, j(shape[name])).otherwise(out)
        return out

    kobo = F.coalesce(F.when(pick("kobo").rlike(r"^[0-9]{1,18}$"), pick("kobo").cast("long")), naira_to_kobo(pick("naira")))
    x = deliveries.withColumn("kind", pick("kind")).withColumn("reference", pick("reference")).withColumn("amount_kobo", kobo)
    x = x.withColumn("currency", F.coalesce(F.upper(pick("currency")), F.lit("NGN"))).withColumn("status", F.when(F.lower(pick("status")).isin(*SUCCESS) | F.lower("kind").isin(*SUCCESS), "SUCCESSFUL").otherwise(F.upper(pick("status"))))
    x = x.withColumn("channel", F.lower(pick("channel"))).withColumn("occurred_at", F.try_to_timestamp(pick("at")))
    result = F.when(~F.col("verified"), "unverified").when(F.col("kind").isNull() | F.col("reference").isNull(), "rejected").when((F.col("currency") != "NGN") | (F.col("status") != "SUCCESSFUL"), "ignored").when(F.col("amount_kobo").isNull(), "rejected").otherwise("payment")
    return x.withColumn("result", result).withColumn("idempotency_key", F.concat_ws(":", F.lit("payment"), "source", "reference"))
