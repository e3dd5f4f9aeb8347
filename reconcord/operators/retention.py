"""Retention carried out: what is due is reduced or purged, and what cannot be stays and is reported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protect
from .graph import staged
from .queue import retention_due

#: Text to a struct (body, dropped); a null body means that the text could not be reduced.
Redactor = Callable[[Column], Column]


@dataclass
class Applied:
    """A pass over a table; nothing is written until the caller does."""

    #: Every row as it is after the pass, with ``result``: kept, redacted, purged or failed.
    rows: DataFrame
    #: One event for each row that changed: subject, occurrence, from, to, dropped_fields, at.
    audit: DataFrame
    #: Rows that were due and stay as they were: id and why.
    failed: DataFrame


def _applied(rows: DataFrame, key: str, before: str, to: Column, extra: list[str]) -> Applied:
    """Splits a pass that was computed once (``staged``) into its three outputs."""
    changed = rows.where(F.col("result").isin("redacted", "purged"))
    audit = changed.select(F.col(key).alias("subject"), F.col(before).alias("occurrence"), F.col(before).alias("from"), to.alias("to"), F.col("_dropped").alias("dropped_fields"), F.col("_at").alias("at"))
    failed = rows.where("result = 'failed'").select(key, F.col("_why").alias("why"))
    return Applied(rows.drop(*extra, "_dropped", "_why", "_at"), audit, failed)


def apply_retention(evidence: DataFrame, ring: protect.KeyRing, as_of: Column, redact: Redactor) -> Applied:
    """Reduces originals of webhooks past their time and purges all else that is due.

    evidence: evidence_id, kind, content, stored_at, purged and the sealed,
    wrapped_key, key_id of ``seal_rows`` in the context of the evidence_id.
    What is reduced is sealed anew under the active key, and its time starts
    again at ``as_of``.  What is purged keeps its row and loses its bytes.  A
    row that the ring cannot open, or whose text cannot be reduced, stays as
    it is and is among ``failed``; the others are not held up by it.
    """
    aad = protect.context(evidence=F.col("evidence_id"))
    due = retention_due(evidence, as_of).select("evidence_id", "step")
    own = protect.unseal_rows(evidence.join(due, "evidence_id", "left"), ring, aad)
    text = F.when(F.col("step") == "reduce", F.col("plain").cast("string"))
    made = own.withColumn("_was", F.col("content")).withColumn("_made", redact(text)).withColumn("_body", F.col("_made.body"))
    good = F.col("_body").isNotNull() & text.isNotNull()
    result = F.when(F.col("step").isNull(), "kept").when(F.col("step") == "purge", "purged").when(good, "redacted").otherwise("failed")
    why = F.when(F.col("result") == "failed", F.when(F.col("plain").isNull(), "cannot be opened").otherwise("cannot be reduced"))
    told = made.withColumn("result", result).withColumn("_why", why).withColumn("_at", as_of).withColumn("_dropped", F.when(F.col("result") == "redacted", F.col("_made.dropped")))
    old = {c: f"_old_{c}" for c in ("sealed", "wrapped_key", "key_id")}
    fresh = protect.seal_rows(told.withColumnsRenamed(old), ring, F.when(F.col("result") == "redacted", F.col("_body")), aad)
    empty = F.lit(b"")
    for c, was in old.items():
        gone = F.when(F.col("result") == "purged", empty) if c != "key_id" else F.when(F.lit(False), F.lit(""))
        fresh = fresh.withColumn(c, F.when(F.col("result") == "redacted", F.col(c)).otherwise(F.coalesce(gone, F.col(was))))
    again = F.col("result") == "redacted"
    out = fresh.withColumn("content", F.when(again, "redacted").otherwise(F.col("content"))).withColumn("stored_at", F.when(again, as_of).otherwise(F.col("stored_at")))
    out = out.withColumn("purged", F.col("purged") | (F.col("result") == "purged"))
    kept = staged(out.select(*evidence.columns, "result", "_was", "_dropped", "_why", "_at"))
    return _applied(kept, "evidence_id", "_was", F.col("result"), ["_was"])


def sweep_originals(deliveries: DataFrame, before: Column, at: Column, redact: Redactor) -> Applied:
    """Reduces each delivery that still holds an original received before a cut-off, whatever its state.

    deliveries: delivery_id, content, received_at, raw.  Adds redacted_at and
    redacted_dropped.  A body that is null, or that the redactor gives up on,
    stays and is among ``failed``.
    """
    due = (F.col("content") == "original") & (F.col("received_at") < before)
    made = deliveries.withColumn("_due", F.coalesce(due, F.lit(False))).withColumn("_made", redact(F.when(F.col("_due"), F.col("raw"))))
    good = F.col("_made.body").isNotNull() & F.col("raw").isNotNull()
    told = made.withColumn("_was", F.col("content")).withColumn("result", F.when(~F.col("_due"), "kept").when(good, "redacted").otherwise("failed"))
    hit = F.col("result") == "redacted"
    out = told.withColumn("raw", F.when(hit, F.col("_made.body")).otherwise(F.col("raw"))).withColumn("content", F.when(hit, "redacted").otherwise(F.col("content")))
    out = out.withColumn("redacted_at", F.when(hit, at)).withColumn("redacted_dropped", F.when(hit, F.col("_made.dropped")))
    out = out.withColumn("_dropped", F.col("redacted_dropped")).withColumn("_why", F.when(F.col("result") == "failed", "cannot be reduced")).withColumn("_at", at)
    kept = staged(out.select(*deliveries.columns, "redacted_at", "redacted_dropped", "result", "_was", "_dropped", "_why", "_at"))
    return _applied(kept, "delivery_id", "_was", F.lit("redacted"), ["_was"])
