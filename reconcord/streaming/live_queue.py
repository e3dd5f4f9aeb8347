"""The exception queue kept by a stream: late evidence raises, clears and reopens what it bears on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.queue import clear_vanished, raise_exceptions
from .parts import Snapshots, touched

FACTS = "subject_id string, owed_kobo long, settled_kobo long, n_promises long, n_settlements long, due boolean, at timestamp"
QUEUE = "subject string, subject_id string, exception_key string, reason string, to_state string, raised_at timestamp, changed_at timestamp"


def facts_of(evidence: DataFrame) -> DataFrame:
    """What is known of each subject from evidence (subject_id, kind, amount_kobo, at).

    kind is promise, settlement or due, the instant at which a promise should
    have been settled.  Rows of other kinds tell nothing of amounts.
    """
    of = lambda kind: F.col("kind") == kind
    amount = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("amount_kobo"))), F.lit(0))
    return evidence.where("subject_id is not null").groupBy("subject_id").agg(
        amount("promise").alias("owed_kobo"), amount("settlement").alias("settled_kobo"), F.count(F.when(of("promise"), 1)).alias("n_promises"),
        F.count(F.when(of("settlement"), 1)).alias("n_settlements"), F.coalesce(F.max(of("due")), F.lit(False)).alias("due"), F.max("at").alias("at"),
    )


def merged(facts: DataFrame) -> DataFrame:
    """Facts of one subject from several batches as one row; the order of the batches does not matter."""
    sums = [F.sum(c).alias(c) for c in ("owed_kobo", "settled_kobo", "n_promises", "n_settlements")]
    return facts.groupBy("subject_id").agg(*sums, F.max("due").alias("due"), F.max("at").alias("at"))


def judged(facts: DataFrame) -> DataFrame:
    """Drafts (subject, subject_id, exception_key, reason, at) of the subjects whose facts are an exception."""
    reason = (
        F.when((F.col("n_promises") == 0) & (F.col("n_settlements") > 0), "PHANTOM_CREDIT")
        .when((F.col("n_settlements") > 0) & (F.col("settled_kobo") != F.col("owed_kobo")), "AMOUNT_MISMATCH")
        .when((F.col("n_promises") > 0) & (F.col("n_settlements") == 0) & F.col("due"), "MISSING_SETTLEMENT")
    )
    own = facts.withColumn("reason", reason).where("reason is not null")
    return own.select(F.lit("promise").alias("subject"), "subject_id", F.concat_ws(":", F.lit("promise"), "subject_id", "reason").alias("exception_key"), "reason", "at")


class LiveQueue:
    """A foreachBatch function and the two snapshot tables that it keeps: facts of subjects, and the queue.

    A batch reads and writes the parts of its own subjects.  Only subjects of
    the batch are judged again; another's silence says nothing.  What a person
    holds (``acknowledged``) is not closed.  A batch that is replayed changes
    nothing.  Instants are the latest of all evidence of a subject, not the
    clock's.  Each evidence row must come once (``inbox_dedupe`` or
    ``append_once`` before this).  A row of kind ``acknowledge`` is a person who
    takes the open exceptions of its subject_id.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.facts, self.queue = Snapshots(spark, f"{path}/facts", FACTS, parts), Snapshots(spark, f"{path}/queue", QUEUE, parts)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        new = facts_of(batch).persist()
        held = batch.where("kind = 'acknowledge' and subject_id is not null").select("subject_id").distinct()
        try:
            parts = touched(new, "subject_id", self.facts.parts)
            if not parts:
                return
            seen = new.select("subject_id")
            known = merged(self.facts.read(parts, epoch).unionByName(new))
            self.facts.write(known, "subject_id", epoch)
            present = self.facts.read(parts).join(seen, "subject_id", "left_semi")
            after = self._turned(self.queue.read(parts, epoch), judged(present), present, held)
            self.queue.write(after, "subject_id", epoch)
        finally:
            new.unpersist()

    def _turned(self, before: DataFrame, found: DataFrame, present: DataFrame, held: DataFrame) -> DataFrame:
        """The queue after a batch: raised, reopened, cleared or as it was."""
        raised = raise_exceptions(before, found).where("effect <> 'unchanged'").drop("was")
        witnessed = present.select(F.lit("promise").alias("subject"), "subject_id")
        gone = clear_vanished(before, found, {"promise": True}, witnessed).where("effect = 'cleared'").select("exception_key", F.lit(True).alias("gone"))
        new = raised.where("effect = 'new'").select("subject", "subject_id", "exception_key", "reason", F.lit("open").alias("to_state"), F.col("at").alias("raised_at"), F.col("at").alias("changed_at"))
        back = raised.where("effect = 'reopened'").select("exception_key", F.lit(True).alias("back"))
        moved = before.join(gone, "exception_key", "left").join(back, "exception_key", "left").join(present.select("subject_id", "at"), "subject_id", "left")
        state = F.when(F.col("gone"), "resolved").when(F.col("back"), "open").otherwise(F.col("to_state"))
        old = moved.withColumn("changed_at", F.when(state != F.col("to_state"), F.col("at")).otherwise(F.col("changed_at"))).withColumn("to_state", state)
        both = old.select(new.columns).unionByName(new)
        taken = both.join(held.withColumn("held", F.lit(True)), "subject_id", "left")
        return taken.withColumn("to_state", F.when(F.col("held") & (F.col("to_state") == "open"), "acknowledged").otherwise(F.col("to_state"))).select(new.columns)

    def present(self) -> DataFrame:
        """The queue as it stands, resolved rows too."""
        return self.queue.read()
