"""The exception queue, anomalies, summaries, alerts, evidence and the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities.
SEVERITY = {
    "PHANTOM_CREDIT": 3, "UNIDENTIFIED_CREDIT": 3, "DUPLICATE_BANK_CREDIT": 3, "RETURNED_PAYOUT": 3, "BANK_LINE_COLLISION": 3,
    "AMOUNT_MISMATCH": 2, "PAYOUT_UNBALANCED": 2, "BATCH_TOO_LARGE": 2, "RESERVE_UNRELEASED": 2, "MISSING_SETTLEMENT": 1,
}
ANOMALY_SEVERITY = {"unknown_shape": 3, "colliding_identity": 3, "malformed_rows": 2, "unknown_value": 2, "unknown_field": 1}


def _lookup(table: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(1))


def severity(reason: Column) -> Column:
    return _lookup(SEVERITY, reason)


def anomaly_severity(kind: Column, share: Column) -> Column:
    """Base severity, one more (at most 3) if half of the rows show it."""
    return F.least(F.lit(3), _lookup(ANOMALY_SEVERITY, kind) + (share >= 0.5).cast("int"))


def exceptions_view(events: DataFrame) -> DataFrame:
    """Current row of each exception with the instant of its first event."""
    x = events.groupBy("exception_key").agg(F.max_by(F.struct("to_state", "reason", "amount_kobo", "event_id"), "event_id").alias("x"), F.min("happened_at").alias("raised_at"))
    return x.select("exception_key", "x.*", "raised_at")


def open_exceptions(view: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` oldest that are not resolved, the severest first."""
    oldest = view.where("to_state <> 'resolved'").orderBy("raised_at", "exception_key").limit(limit)
    return oldest.withColumn("severity", severity(F.col("reason"))).orderBy(F.desc("severity"), "raised_at", "exception_key")


def queue_page(view: DataFrame, states: tuple[str, ...], subject: str | None, limit: int) -> DataFrame:
    """As ``open_exceptions``, of exceptions in ``states`` and, if named, of one kind of subject."""
    own = view.where(F.col("to_state").isin(*states))
    own = own if subject is None else own.where(F.col("subject") == subject)
    oldest = own.orderBy("raised_at", "exception_key").limit(limit)
    return oldest.withColumn("severity", severity(F.col("reason"))).orderBy(F.desc("severity"), "raised_at", "exception_key")


def exception_history(events: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every change of the exceptions (of those in ``keys``, if given), with the state before it, null at first; one row an event, none overwritten."""
    own = events if keys is None else events.join(keys.select("exception_key").distinct(), "exception_key", "left_semi")
    before = F.lag("to_state").over(Window.partitionBy("exception_key").orderBy("event_id"))
    return own.select("exception_key", "event_id", before.alias("from_state"), "to_state", "happened_at")


def raise_exceptions(view: DataFrame, drafts: DataFrame) -> DataFrame:
    """What each draft does: new, unchanged (open or acknowledged) or reopened."""
    both = drafts.join(view.select("exception_key", F.col("to_state").alias("was")), "exception_key", "left")
    return both.withColumn("effect", F.when(F.col("was").isNull(), "new").when(F.col("was") == "resolved", "reopened").otherwise("unchanged"))


def queue_diff(view: DataFrame, found: DataFrame, witnessed: DataFrame | None = None) -> DataFrame:
    """Exceptions in the queue that a run did not find again, and what becomes of them.

    Acknowledged ones are withheld.  ``witnessed`` (exception_key) tells which
    subjects a truncated run looked at; others are withheld.  Without it all are.
    """
    gone = view.where("to_state <> 'resolved'").join(found.select("exception_key"), "exception_key", "left_anti")
    if witnessed is None:
        seen = gone.withColumn("seen", F.lit(True))
    else:
        seen = gone.join(witnessed.select("exception_key", F.lit(True).alias("seen")).distinct(), "exception_key", "left").fillna(False, ["seen"])
    return seen.select("exception_key", "reason", F.when((F.col("to_state") == "acknowledged") | ~F.col("seen"), "withheld").otherwise("cleared").alias("effect"))


def clear_vanished(view: DataFrame, found: DataFrame, scope: dict[str, bool], witnessed: DataFrame) -> DataFrame:
    """Exceptions (with subject, subject_id) that a run did not find again, and what becomes of them: cleared or withheld.

    ``scope`` names the kinds of subject that the run judged and whether its
    window over them was truncated; other kinds are not looked at.  A whole
    window clears also subjects that it did not load; a truncated one only
    those in ``witnessed`` (subject, subject_id).  What is acknowledged is
    withheld.  An empty scope clears nothing.
    """
    kinds = F.col("subject").isin(list(scope))
    gone = view.where((F.col("to_state") != "resolved") & kinds).join(found.select("exception_key"), "exception_key", "left_anti")
    seen = gone.join(witnessed.select("subject", "subject_id", F.lit(True).alias("seen")).distinct(), ["subject", "subject_id"], "left")
    cut = F.col("subject").isin([kind for kind, truncated in scope.items() if truncated])
    kept = (F.col("to_state") == "acknowledged") | (cut & F.col("seen").isNull())
    return seen.select("subject", "subject_id", "exception_key", "reason", F.when(kept, "withheld").otherwise("cleared").alias("effect"))


def anomaly_history(events: DataFrame) -> DataFrame:
    """Each anomaly's current state and history."""
    raised = F.col("to_state") == "raised"
    x = events.groupBy("anomaly_key").agg(
        F.max_by(F.struct("to_state", "kind", "occurrences", "rows_in_file"), "event_id").alias("x"), F.min("happened_at").alias("first_seen"), F.max("happened_at").alias("last_seen"),
        F.count(F.when(raised, 1)).alias("times_raised"), F.sum(F.when(raised, F.col("occurrences")).otherwise(0)).alias("total_occurrences"), F.count_distinct("evidence_id").alias("n_evidence"),
    )
    share = F.col("occurrences") / F.col("rows_in_file")
    return x.select("anomaly_key", "x.to_state", "x.kind", "x.occurrences", "x.rows_in_file", "first_seen", "last_seen", "times_raised", "total_occurrences", "n_evidence").withColumn("severity", anomaly_severity(F.col("kind"), share))


def clear_conformed(view: DataFrame, seen: DataFrame) -> DataFrame:
    """Open anomalies of the sources read (seen: source, anomaly_key or null) that were not seen again, acknowledged ones too: the format conforms now."""
    read = seen.select("source").distinct()
    return view.where("to_state <> 'resolved'").join(read, "source", "left_semi").join(seen.where("anomaly_key is not null").select("anomaly_key"), "anomaly_key", "left_anti")


def summary(matches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Conclusions by reason and kind in [start, end)."""
    return matches.where((F.col("happened_at") >= start) & (F.col("happened_at") < end)).groupBy("reason").agg(F.count("*").alias("n"), F.sum("amount_kobo").alias("amount_kobo"))


def access_volume(access: DataFrame) -> DataFrame:
    return access.groupBy("principal", "action").agg(F.count_distinct("evidence_id").alias("n_evidence"))


def purge_after(kind: Column, content: Column, stored_at: Column) -> Column:
    """Originals of webhooks stay 30 days, all else six years (2192 days)."""
    return stored_at + F.when((kind == "webhook") & (content == "original"), F.make_dt_interval(F.lit(30))).otherwise(F.make_dt_interval(F.lit(2192)))


def retention_due(evidence: DataFrame, as_of: Column) -> DataFrame:
    """Evidence whose time is up: originals of webhooks are reduced, all else is purged."""
    due = evidence.where("not purged").withColumn("purge_at", purge_after(F.col("kind"), F.col("content"), F.col("stored_at"))).where(F.col("purge_at") <= as_of)
    return due.withColumn("step", F.when((F.col("kind") == "webhook") & (F.col("content") == "original"), "reduce").otherwise("purge"))


def retry_after_ms(attempts: Column, delivery_id: Column) -> Column:
    """Exponential back-off from 1 s to 5 min, spread by the last byte of a hexadecimal id."""
    spread = F.conv(F.right(delivery_id, F.lit(2)), 16, 10).cast("double")
    return F.round(F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempts - 1), F.lit(300000.0)) * (0.875 + spread / 255 * 0.25)).cast("long")


def inbox_depth(deliveries: DataFrame, as_of: Column) -> DataFrame:
    """Deliveries by state and whether they are put off, with the oldest of each."""
    late = (F.col("state") == "pending") & F.coalesce(F.col("next_attempt_at") > as_of, F.lit(False))
    return deliveries.withColumn("deferred", late).groupBy("state", "deferred").agg(F.count("*").alias("n"), F.min("received_at").alias("oldest"))


def health_alerts(depth: DataFrame, queue: DataFrame, as_of: Column, backlog: int, failed: int, pending_minutes: int, exceptions: int) -> DataFrame:
    """Alerts whose threshold is passed; a threshold of zero switches one off."""
    minutes = (F.unix_timestamp(as_of) - F.unix_timestamp("oldest")) / 60
    x = depth.agg(
        F.sum(F.when((F.col("state") == "pending") & ~F.col("deferred"), F.col("n")).otherwise(0)).alias("waiting"),
        F.sum(F.when(F.col("state") == "failed", F.col("n")).otherwise(0)).alias("failures"),
        F.max(F.when((F.col("state") == "pending") & ~F.col("deferred"), minutes)).cast("long").alias("age"),
    ).withColumn("k", F.lit(1))
    q = queue.agg(F.count(F.when(F.col("to_state") == "open", 1)).alias("open")).withColumn("k", F.lit(1))
    one = lambda kind, value, hit: F.when(hit, F.struct(F.lit(kind).alias("alert"), value.cast("long").alias("value")))
    alerts = F.array(
        one("backlog", F.col("waiting"), F.lit(backlog > 0) & (F.col("waiting") > backlog)), one("failed", F.col("failures"), F.lit(failed > 0) & (F.col("failures") >= failed)),
        one("oldest_pending", F.col("age"), F.lit(pending_minutes > 0) & (F.col("age") > pending_minutes)), one("exceptions", F.col("open"), F.lit(exceptions > 0) & (F.col("open") > exceptions)),
    )
    return x.join(q, "k").select(F.explode(F.array_compact(alerts)).alias("a")).select("a.*")


def stale_alerts(conclusions: DataFrame, statements: DataFrame, attestations: DataFrame, as_of: Column, run_minutes: int, attest_minutes: int) -> DataFrame:
    """(alert, subject, value): what nobody did for too long; a threshold of zero switches one off.

    ``reconciliation``: no conclusion (happened_at) for more than
    ``run_minutes``, or ever.  ``attestation``: an account with a statement
    (bank_account_id) whose books nobody compared (as_of) for more than
    ``attest_minutes``, or ever; an account without statements has nothing to
    compare.  value is the age in whole minutes, null for never.
    """
    minutes = lambda c: F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(c)) / 60).cast("long")
    run = conclusions.agg(F.max("happened_at").alias("last")).select(F.lit("reconciliation").alias("alert"), F.lit("").alias("subject"), "last", F.lit(run_minutes).alias("most"))
    accounts = statements.where("bank_account_id is not null").select("bank_account_id").distinct()
    last = attestations.groupBy("bank_account_id").agg(F.max("as_of").alias("last"))
    attested = accounts.join(last, "bank_account_id", "left").select(F.lit("attestation").alias("alert"), F.col("bank_account_id").alias("subject"), "last", F.lit(attest_minutes).alias("most"))
    late = F.col("last").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("last") > F.col("most") * 60)
    return run.unionByName(attested).where((F.col("most") > 0) & late).select("alert", "subject", minutes("last").alias("value"))


#: Actions that always need a second person.
LISTED_ACTIONS = ("write_off", "reclassify", "clear_phantom", "reallocate")


def approval_failure(resolutions: DataFrame, large_kobo: int = 5_000_000) -> DataFrame:
    """Adds ``failure``: what forbids a decision, or null.

    An approval is whole or absent, by another person, and needed for bookings,
    listed actions and large amounts; amounts are not negative.
    """
    approved = F.col("approver").isNotNull()
    listed = F.col("action").isin(*LISTED_ACTIONS) if "action" in resolutions.columns else F.lit(False)
    needs = F.col("books_entries") | listed | F.coalesce(F.abs("amount_kobo") >= large_kobo, F.lit(False))
    failure = (
        F.when(approved != F.col("approved_at").isNotNull(), "half approval").when(F.col("approver") == F.col("resolver"), "self approval")
        .when(needs & ~approved, "approval needed").when(F.col("amount_kobo") < 0, "negative amount")
    )
    return resolutions.withColumn("failure", failure)
