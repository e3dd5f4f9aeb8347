"""Queries of the streaming operators: the given tables replayed through a stream, with SQL for what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared
from ..streaming import inbox, retries
from ..streaming.live_queue import LiveQueue
from ..streaming.parts import KeyedTable, files
from .queries import query

#: Files that the deliveries are replayed from, in order of time, one a micro-batch.
FILES = 2
#: Rows of a file that a stream is replayed from; micro-batches with more rows are several files.
FILE_ROWS = 1_000_000
_FAILS = "event_id % 11"


@query(f"""with d as (select event_id, {_FAILS} as fails, case when {_FAILS} = 10 then null else least({_FAILS} + 1, 8) end as n, cast('0x' || right(sha256(cast(event_id as varchar)), 2) as int) as spread from events),
e as (select event_id, fails, coalesce(n, 8) as attempts, spread from d)
select event_id, attempts, case when fails < 8 then 'processed' else 'failed' end as state,
cast(coalesce(list_sum([round(least(1000 * 2 ** (k - 1), 300000) * (0.875 + spread / 255 * 0.25)) for k in range(1, attempts)]), 0) as bigint) as waited_ms,
cast(case when fails < 8 then attempts - 1 else attempts end as bigint) as errors from e""")
def timed_retries(v):
    """Every event as a delivery that fails as often as its id says, on the clock of the events; then the clock alone moves on."""
    spark = v["events"].sparkSession
    root = f"{shared(spark)}/retries/{uuid.uuid4().hex}"
    schema = "delivery_id string, body string, received_at timestamp"
    own = v["events"].select(F.sha2(F.col("event_id").cast("string"), 256).alias("delivery_id"), F.concat_ws(":", "event_id", F.expr(_FAILS)).alias("body"), F.col("ts").cast("timestamp").alias("received_at"))
    own.repartitionByRange(FILES, "received_at").sortWithinPartitions("received_at").write.parquet(f"{root}/in")
    last = own.agg(F.max("received_at")).first()[0]
    ticks = spark.range(1, retries.MAX_ATTEMPTS + 2).select(F.lit("").alias("delivery_id"), F.lit(None).cast("string").alias("body"), (F.lit(last) + F.make_dt_interval(hours="id")).alias("received_at"), "id")
    ticks.repartitionByRange(retries.MAX_ATTEMPTS + 1, "id").sortWithinPartitions("id").select(schema.replace(" string", "").replace(" timestamp", "").split(", ")).write.mode("append").parquet(f"{root}/in")

    def outcome(delivery_id: str, body: str | None, attempt: int) -> str | None:
        return None if body is None or attempt > int(body.split(":")[1]) else f"no {attempt}"

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, retries.PROVIDER)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        out = retries.retries(source, outcome, event_time=True)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    made = spark.read.schema(retries.OUTPUT).parquet(f"{root}/out")
    per = made.groupBy("delivery_id").agg(F.count("*").alias("n"), F.max_by("state", "attempt").alias("state"), F.max(F.unix_millis("at")).alias("end"), F.min(F.unix_millis("at")).alias("begin"), F.count("error").alias("errors"))
    back = v["events"].select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("delivery_id"))
    return back.join(per, "delivery_id").select("event_id", F.col("n").cast("int").alias("attempts"), "state", (F.col("end") - F.col("begin")).alias("waited_ms"), "errors")


def _replayed(evidence, at: str, root: str, batches: int):
    """A stream of the rows in order of time in so many micro-batches; a file is one task's, so a micro-batch has more of them the more rows there are."""
    spark = evidence.sparkSession
    each = max(1, -(-evidence.count() // (batches * FILE_ROWS)))
    evidence.repartitionByRange(batches * each, at).sortWithinPartitions(at).write.parquet(f"{root}/in")
    fs, folder = files(spark, f"{root}/in")
    # streams take files by their instants, and tasks end in any order
    parts = sorted((f.getPath().getName(), f) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    last = max((f.getModificationTime() for _, f in parts), default=0)
    for k, (_, f) in enumerate(parts):
        fs.setTimes(f.getPath(), last - 1000 * (len(parts) - k), -1)
    return spark.readStream.schema(evidence.schema).option("maxFilesPerTrigger", each).parquet(f"{root}/in")


@query("""with e as (select reference as subject_id, 'promise' as kind, gross_kobo as amount_kobo from promises union all select reference, 'settlement', gross_kobo from settlement_lines where status = 'settled'),
f as (select subject_id, coalesce(sum(amount_kobo) filter (where kind = 'promise'), 0) as owed, coalesce(sum(amount_kobo) filter (where kind = 'settlement'), 0) as settled, count(*) filter (where kind = 'promise') as p, count(*) filter (where kind = 'settlement') as s from e group by 1)
select subject_id, case when p = 0 then 'PHANTOM_CREDIT' when s = 0 then 'MISSING_SETTLEMENT' else 'AMOUNT_MISMATCH' end as reason, 'open' as to_state from f where p = 0 or s = 0 or owed <> settled""", "promises", "settlement_lines")
def live_queue(v):
    """The queue after all promises, settlements and deadlines came by in order of time: what late evidence settled is cleared."""
    promise, line = v["promises"], v["settlement_lines"].where("status = 'settled'")
    evidence = (
        promise.select(F.col("reference").alias("subject_id"), F.lit("promise").alias("kind"), F.col("gross_kobo").alias("amount_kobo"), F.col("occurred_at").alias("at"))
        .unionByName(promise.select(F.col("reference").alias("subject_id"), F.lit("due").alias("kind"), F.lit(None).cast("long").alias("amount_kobo"), (F.col("occurred_at") + F.make_dt_interval(F.lit(1))).alias("at")))
        .unionByName(line.select(F.col("reference").alias("subject_id"), F.lit("settlement").alias("kind"), F.col("gross_kobo").alias("amount_kobo"), F.col("settled_at").alias("at")))
    )
    spark = evidence.sparkSession
    root = f"{shared(spark)}/live_queue/{uuid.uuid4().hex}"
    live = LiveQueue(spark, f"{root}/out", 8)
    _replayed(evidence, "at", root, FILES + 1).writeStream.foreachBatch(live).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.present().where("to_state <> 'resolved'").select("subject_id", "reason", "to_state")


@query("select distinct delivery_id from deliveries", "deliveries")
def appended_once(v):
    """Deliveries with many repeats, of which a table gets each one once."""
    own = v["deliveries"].select("delivery_id", "received_at")
    root = f"{shared(own.sparkSession)}/appended/{uuid.uuid4().hex}"
    inbox.append_once(_replayed(own, "received_at", root, FILES), f"{root}/out", "delivery_id", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return own.sparkSession.read.parquet(f"{root}/out").select("delivery_id")


def _keyed(v) -> KeyedTable:
    """Two thirds of the promises, then all of them, appended by key."""
    spark = v["promises"].sparkSession
    table = KeyedTable(spark, f"{shared(spark)}/keyed/{uuid.uuid4().hex}", "transaction_id", "transaction_id string, gross_kobo long, came string", 16)
    table.append(v["promises"].where("k % 3 <> 0").select("transaction_id", "gross_kobo", F.lit("first").alias("came")))
    table.append(v["promises"].select("transaction_id", "gross_kobo", F.lit("second").alias("came")))
    return table


@query("select transaction_id, gross_kobo, case when k % 3 <> 0 then 'first' else 'second' end as came from promises", "promises")
def keyed_append(v):
    return _keyed(v).read()


@query("select transaction_id, gross_kobo, case when k % 3 <> 0 then 'first' else 'second' end as came from promises where transaction_id = (select max(transaction_id) from promises)", "promises")
def point_lookup(v):
    """The row of the last key: one folder of the table is read."""
    return _keyed(v).lookup(v["promises"].agg(F.max("transaction_id")).first()[0] or "")
