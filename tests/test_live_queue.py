"""The queue that a stream keeps, in every order of arrival; tables in parts; keys known by state."""

import itertools
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from reconcord.operators.queue import clear_vanished
from reconcord.plans import streams
from reconcord.streaming import inbox
from reconcord.streaming.live_queue import LiveQueue, facts_of, judged
from reconcord.streaming.parts import KeyedTable, Snapshots

T0 = datetime(2024, 1, 1)
EVIDENCE = "subject_id string, kind string, amount_kobo long, at timestamp"
ROWS = [
    ("late", "promise", 100), ("late", "due", None), ("late", "settlement", 100),
    ("short", "promise", 100), ("short", "settlement", 60), ("parts", "promise", 100), ("parts", "settlement", 60), ("parts", "settlement", 40),
    ("never", "promise", 5), ("never", "due", None), ("ghost", "settlement", 7), (None, "settlement", 9),
]


def frame(spark, rows):
    return spark.createDataFrame([(s, k, a, T0 + timedelta(hours=i)) for i, (s, k, a) in enumerate(rows)], EVIDENCE)


def standing(live):
    return sorted((r["subject_id"], r["reason"], r["to_state"]) for r in live.present().where("to_state <> 'resolved'").collect())


def test_every_order_of_arrival_ends_in_the_queue_of_the_batch_run(spark, tmp_path):
    wanted = sorted((r["subject_id"], r["reason"], "open") for r in judged(facts_of(frame(spark, ROWS))).collect())
    assert wanted == [("ghost", "PHANTOM_CREDIT", "open"), ("never", "MISSING_SETTLEMENT", "open"), ("short", "AMOUNT_MISMATCH", "open")]
    stretches = [ROWS[:2] + ROWS[5:6], ROWS[2:5] + ROWS[9:10], ROWS[6:9] + ROWS[10:]]
    for n, order in enumerate(itertools.permutations(stretches)):
        live = LiveQueue(spark, str(tmp_path / f"q{n}"), 3)
        for epoch, rows in enumerate(order):
            live(frame(spark, rows), epoch)
        assert standing(live) == wanted


def test_late_evidence_clears_and_a_replay_changes_nothing(spark, tmp_path):
    live = LiveQueue(spark, str(tmp_path / "q"), 3)
    live(frame(spark, ROWS[:2] + ROWS[8:10]), 0)
    assert [r[:2] for r in standing(live)] == [("late", "MISSING_SETTLEMENT"), ("never", "MISSING_SETTLEMENT")]
    for _ in range(2):
        live(frame(spark, ROWS[2:3]), 1)
        # the other subject was not looked at again
        assert [r[:2] for r in standing(live)] == [("never", "MISSING_SETTLEMENT")]
        assert live.facts.read().where("subject_id = 'late'").first()["settled_kobo"] == 100
    live(frame(spark, [("late", "settlement", 1)]), 2)
    assert standing(live) == [("late", "AMOUNT_MISMATCH", "open"), ("never", "MISSING_SETTLEMENT", "open")]
    live(frame(spark, [("late", "promise", 1)]), 3)
    live(frame(spark, [("late", "settlement", 5)]), 4)
    row = live.present().where("reason = 'AMOUNT_MISMATCH'").first()
    assert (row["to_state"], row["raised_at"], row["changed_at"]) == ("open", T0 + timedelta(hours=1), T0 + timedelta(hours=1))  # the latest evidence is still the deadline's


def test_what_a_person_holds_is_not_cleared(spark, tmp_path):
    live = LiveQueue(spark, str(tmp_path / "q"), 2)
    live(frame(spark, ROWS[:2]), 0)
    live(frame(spark, [("late", "acknowledge", None)]), 1)
    live(frame(spark, ROWS[2:3]), 2)
    assert standing(live) == [("late", "MISSING_SETTLEMENT", "acknowledged")]
    live(frame(spark, []), 3)
    assert standing(live) == [("late", "MISSING_SETTLEMENT", "acknowledged")]


def test_a_stream_that_fails_half_way_takes_its_batch_up_again(spark, tmp_path):
    frame(spark, ROWS[:2] + ROWS[8:]).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(EVIDENCE).parquet(str(tmp_path / "in"))
    live = LiveQueue(spark, str(tmp_path / "q"), 2)

    def start(f):
        source().writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    def breaks(batch, epoch):
        live.facts.write(facts_of(batch), "subject_id", epoch)
        raise RuntimeError("lost between the two tables")

    with pytest.raises(Exception, match="lost between"):
        start(breaks)
    start(live)
    assert [r[0] for r in standing(live)] == ["ghost", "late", "never"]
    assert live.facts.read().agg(F.sum("owed_kobo")).first()[0] == 105


def test_a_version_without_its_mark_is_not_there_and_old_ones_go(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "id string, n long", 4)
    assert table.read().count() == 0
    for e in range(5):
        table.write(spark.createDataFrame([("a", e)], "id string, n long"), "id", e)
    assert [r["n"] for r in table.read().collect()] == [4] and [r["n"] for r in table.read(before=4).collect()] == [3]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version=3", "version=4"]
    (tmp_path / "t" / "version=4" / "_SUCCESS").unlink()
    assert [r["n"] for r in table.read().collect()] == [3]


def test_a_large_part_is_written_in_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "100k")
    try:
        table = Snapshots(spark, str(tmp_path / "t"), "id string, n long", 1)
        rows = spark.range(60000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"))
        for e in range(3):
            table.write(rows, "id", e)
        assert [tuple(r) for r in table.read().agg(F.count("*"), F.sum("n"), F.count_distinct("id")).collect()] == [(60000, 60000 * 59999 // 2, 60000)]
        assert len(list((tmp_path / "t" / "version=2" / "part=0").glob("*.parquet"))) > 3
    finally:
        spark.conf.set(key, was)


def test_a_replay_of_many_files_keeps_its_batches_and_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    rows = frame(spark, [(f"s{i}", "promise", i) for i in range(600)])
    seen = []
    source = streams._replayed(rows, "at", str(tmp_path), 3)
    source.writeStream.foreachBatch(lambda b, _: seen.append((b.rdd.getNumPartitions(), *b.agg(F.min("at"), F.max("at"), F.count("*")).first()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for *_, n in seen) == 600
    assert all(a[2] <= b[1] for a, b in zip(seen, seen[1:]))
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) == 12


def test_scope_of_clearing(spark):
    view = spark.createDataFrame([("payout", "p1", "open"), ("payout", "p2", "acknowledged"), ("payout", "p3", "resolved"), ("credit", "c1", "open"), ("credit", "c2", "open"), ("line", "l1", "open")], "subject string, subject_id string, to_state string").withColumn("exception_key", F.col("subject_id")).withColumn("reason", F.lit("R"))
    found = view.where("subject_id = 'none'")
    seen = spark.createDataFrame([("credit", "c1"), ("credit", "c1")], "subject string, subject_id string")
    done = lambda scope: {r["subject_id"]: r["effect"] for r in clear_vanished(view, found, scope, seen).collect()}
    assert done({"payout": False, "credit": True}) == {"p1": "cleared", "p2": "withheld", "c1": "cleared", "c2": "withheld"}
    assert done({}) == {}


def test_keyed_table_reads_one_folder_for_one_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), "id", "id string, n long", 8)
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"))
    table.append(rows.where("n < 0"))
    assert table.read().count() == 0
    for _ in range(2):
        table.append(rows.unionByName(rows.withColumn("n", F.col("n") + 5)), "n")
    assert [tuple(r) for r in table.read().agg(F.count("*"), F.sum("n")).collect()] == [(1000, 499500)]
    one = table.lookup("k77")
    assert [tuple(r) for r in one.collect()] == [("k77", 77)] and table.lookup("none").count() == 0
    read = one.select(F.input_file_name()).distinct().collect()
    assert len(read) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(id,k77)" in plan
    # only the folder of the new key is read by an append
    part = str(read[0][0]).split("part=")[1].split("/")[0]
    for other in (tmp_path / "k").iterdir():
        if other.name.startswith("part=") and other.name != f"part={part}":
            for f in other.glob("*.parquet"):
                f.write_bytes(b"unreadable")
            for f in other.glob(".*.crc"):
                f.unlink()
    table.append(rows.where("id = 'k77'"))
    assert table.lookup("k77").count() == 1
    with pytest.raises(Exception, match="null in id"):
        table.append(spark.createDataFrame([(None, 1)], "id string, n long"))


def test_append_once_never_reads_the_table(spark, tmp_path):
    schema, out, ck = "id string, n long", str(tmp_path / "out"), str(tmp_path / "ck")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: inbox.append_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, "id", ck, availableNow=True).awaitTermination()
    put([("a", 1), ("a", 1), ("b", 2)])
    run()
    put([("b", 3), ("c", 4)])
    run()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    # rows were written, the commit was lost: the batch comes again
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    put([("d", 5), ("a", 6)])
    run()
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 5)]
    shutil.rmtree(ck)
    with pytest.raises(ValueError, match="does not know"):
        run()
