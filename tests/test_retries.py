"""Timed retries: instants, ends, restarts and repeats, on a clock that the test moves."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from reconcord.operators import queue
from reconcord.streaming import retries

START = datetime(2024, 1, 1)
IDS = [f"{k:062x}{x}" for k, x in enumerate(["00", "80", "ff", "7f"])]


@pytest.fixture
def timed(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, retries.PROVIDER)
    yield spark
    spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def failing():
    """Bodies say how often they fail first; made here, as workers cannot import this module."""

    def outcome(delivery_id, body, attempt):
        if body is None:
            raise ValueError("no body")
        return None if attempt > int(body) else f"no {attempt}"

    return outcome


def put(spark, folder, rows):
    spark.createDataFrame([(i, b, START + timedelta(milliseconds=ms)) for i, b, ms in rows], "delivery_id string, body string, received_at timestamp").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    """All micro-batches that the files so far make; later calls go on from the checkpoint."""
    source = spark.readStream.schema("delivery_id string, body string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = retries.retries(source, failing(), event_time=True, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.read.schema(retries.OUTPUT).parquet(str(tmp_path / "out")).orderBy("delivery_id", "attempt").collect()


def tick(spark, folder, ms):
    put(spark, folder, [("tick", "0", ms)])


def test_attempts_fall_on_their_instants_and_end(timed, tmp_path):
    spark, folder = timed, str(tmp_path / "in")
    put(spark, folder, [(IDS[0], "2", 0), (IDS[1], "100", 0), (IDS[2], "0", 0), (IDS[3], None, 5), (None, "0", 0)])
    tick(spark, folder, 1500)
    run(spark, tmp_path)
    # a restart from the checkpoint: another query over the same folders
    for k in range(2, 12):
        tick(spark, folder, 10**6 * k)
    put(spark, folder, [(IDS[0], "9", 0), (IDS[1], "0", 0)])  # repeats of an ended and of a failed one
    tick(spark, folder, 10**6 * 12)
    rows = [r for r in run(spark, tmp_path) if r["delivery_id"] != "tick"]
    by = {i: [r for r in rows if r["delivery_id"] == i] for i in IDS}
    assert len(rows) == 3 + 8 + 1 + 8
    assert [r["state"] for r in by[IDS[0]]] == ["pending", "pending", "processed"]
    assert [r["state"] for r in by[IDS[1]]] == ["pending"] * 7 + ["failed"]
    assert [(r["state"], r["next_at"], r["error"]) for r in by[IDS[2]]] == [("processed", None, None)]
    assert by[IDS[3]][-1]["error"] == "ValueError: no body" and by[IDS[3]][-1]["state"] == "failed"
    for i, first in ((IDS[0], 0), (IDS[1], 0), (IDS[3], 5)):
        at = START + timedelta(milliseconds=first)
        for r in by[i]:
            assert r["at"] == at
            at += timedelta(milliseconds=retries.delay(r["attempt"], i))
            assert r["next_at"] == (at if r["state"] == "pending" else None)


def test_delays_equal_the_column_of_the_queue(spark):
    rows = [(i, k) for i in [*IDS, "zz"] for k in range(1, 12)]
    df = spark.createDataFrame(rows, "delivery_id string, attempts int").withColumn("ms", queue.retry_after_ms(F.col("attempts"), F.col("delivery_id")))
    for r in df.where("delivery_id <> 'zz'").collect():
        assert r["ms"] == retries.delay(r["attempts"], r["delivery_id"])
    assert [retries.delay(k, "80") // 1000 for k in (1, 2, 9, 10, 50)] == [1, 2, 256, 300, 300]


def test_retries_by_the_clock_of_processing(timed, tmp_path):
    spark, folder = timed, str(tmp_path / "in")
    put(spark, folder, [("a0", "2", 0), ("b0", "9", 0)])
    source = spark.readStream.schema("delivery_id string, body string, received_at timestamp").parquet(folder)
    q = retries.retries(source, failing(), most=3, wait=lambda attempts, i: 300).writeStream.format("memory").queryName("timed_retries").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("timed_retries").where("state <> 'pending'").count() < 2:
            time.sleep(0.5)
        rows = spark.table("timed_retries").orderBy("delivery_id", "attempt").collect()
    finally:
        q.stop()
    assert [(r["delivery_id"], r["attempt"], r["state"]) for r in rows] == [("a0", 1, "pending"), ("a0", 2, "pending"), ("a0", 3, "processed"), ("b0", 1, "pending"), ("b0", 2, "pending"), ("b0", 3, "failed")]
    assert all(b["at"] >= a["next_at"] for a, b in zip(rows, rows[1:]) if a["delivery_id"] == b["delivery_id"])


def test_retries_name_the_store_they_need(spark):
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        pytest.skip("set for the session")
    with pytest.raises(ValueError, match="RocksDB"):
        retries.retries(spark.createDataFrame([], "delivery_id string, body string, received_at timestamp"), failing())


def test_due_attempts_follow_in_one_go_and_ends_are_forgotten(timed, tmp_path):
    """One step of the clock past all instants makes all attempts; deliveries of one bucket keep apart."""
    spark, folder = timed, str(tmp_path / "in")
    put(spark, folder, [(IDS[0], "2", 0), (IDS[1], "100", 0), (IDS[2], "0", 0)])
    tick(spark, folder, 2 * 10**6)
    tick(spark, folder, 3 * 10**6)
    put(spark, folder, [(IDS[0], "0", 3 * 10**6), (IDS[2], "0", 3 * 10**6 + 1)])  # after both were forgotten
    rows = [r for r in run(spark, tmp_path, keep=5000, buckets=1) if r["delivery_id"] != "tick"]
    by = {i: [(r["attempt"], r["state"]) for r in rows if r["delivery_id"] == i] for i in IDS[:3]}
    assert sorted(by[IDS[0]]) == [(1, "pending"), (1, "processed"), (2, "pending"), (3, "processed")]
    assert by[IDS[1]] == [(k, "pending") for k in range(1, 8)] + [(8, "failed")]
    assert by[IDS[2]] == [(1, "processed"), (1, "processed")]
    at = START
    for r in sorted((r for r in rows if r["delivery_id"] == IDS[1]), key=lambda r: r["attempt"]):
        assert r["at"] == at
        at += timedelta(milliseconds=retries.delay(r["attempt"], IDS[1]))
