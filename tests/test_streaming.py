from datetime import datetime

import duckdb
import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from siltstone.streaming import jobs, machines
from tests.oracle import rows_of, spark_rows


def stream_of(spark, tmp_path, batches, schema):
    """Each batch a file, taken one at a time in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_going_back_fails_the_batch(spark, tmp_path):
    batches = [[("a", datetime(2026, 1, 2))], [("a", datetime(2026, 1, 2))], [("a", datetime(2026, 1, 1))]]
    stream = stream_of(spark, tmp_path, batches, "k string, at timestamp")
    query = stream.writeStream.foreachBatch(jobs.guarded_append(f"{tmp_path}/out", "k", "at")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(PySparkException, match="COLLECTION_CONTRACT_INVALID"):
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/batch=0", f"{tmp_path}/out/batch=1").count() == 2


END = datetime(2100, 1, 1)


def run_machine(spark, tmp_path, stream):
    out = machines.start(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True), spark)
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


at = lambda s: datetime(2026, 1, 1, 0, s // 60, s % 60)
ACTIONS = [
    (1, at(0), "claim"), (1, at(1), "sent"), (2, at(0), "claim"), (2, at(1), "failed"), (2, at(2), "claim"), (2, at(3), "failed"), (2, at(4), "claim"), (2, at(5), "failed"), (2, at(6), "claim"), (2, at(7), "failed"), (2, at(8), "claim"),
    (3, at(0), "claim"), (3, at(10), "claim"), (4, at(0), "claim"), (4, at(400), "claim"), (4, at(410), "sent"), (5, at(0), "sent"), (6, at(5), "claim"), (6, at(305), "claim"), (6, at(306), "failed"),
]
CHANGES = {
    1: [("pending", 0, at(0)), ("sending", 0, at(0)), ("sent", 0, at(1))], 3: [("pending", 0, at(0)), ("sending", 0, at(0)), ("stale", 0, at(300))],
    4: [("pending", 0, at(0)), ("sending", 0, at(0)), ("stale", 0, at(300)), ("sending", 1, at(400)), ("sent", 1, at(410))], 5: [("pending", 0, at(0))],
    6: [("pending", 0, at(5)), ("sending", 0, at(5)), ("stale", 0, at(305)), ("failed", 0, at(306))],
}


@pytest.mark.parametrize("batches", [1, 4])
def test_delivery_machine(spark, tmp_path, batches):
    """The changes are the same however rows fall into micro-batches, and out of order within the delay."""
    shuffled = sorted(ACTIONS, key=lambda r: hash((r[0] * 7919, r[1].second)) % 97) if batches == 1 else ACTIONS[::-1]
    parts = [[r for k, r in enumerate(shuffled) if k % batches == i] for i in range(batches)]
    stream = stream_of(spark, tmp_path, [*parts, [(0, END, "sent")]], "key long, at timestamp, action string")
    got = {}
    for r in sorted(run_machine(spark, tmp_path, machines.delivery_states(stream)), key=lambda r: (r.key, r.change)):
        got.setdefault(r.key, []).append((r.status, r.retry_count, r.at))
    assert {k: got[k] for k in CHANGES} == CHANGES
    assert got[2][-1][:2] == ("failed", 3)


def test_stale_is_told_before_another_row_comes(spark, tmp_path):
    """Time goes on by rows of other keys alone."""
    stream = stream_of(spark, tmp_path, [[(1, at(0), "claim")], [(2, at(2000), "claim")], [(2, at(2001), "sent")]], "key long, at timestamp, action string")
    assert ("stale", at(300)) in [(r.status, r.at) for r in run_machine(spark, tmp_path, machines.delivery_states(stream)) if r.key == 1]


def test_runs_end_at_their_deadline(spark, tmp_path):
    rows = [("a", at(0), "started", 60), ("a", at(59), "succeeded", None), ("b", at(0), "started", 60), ("b", at(61), "succeeded", None), ("c", at(5), "started", 100), ("d", at(5), "started", 100), ("d", at(6), "cancelled", None), ("e", at(7), "COLLECTION_NETWORK", None), ("f", at(0), "started", 60), ("f", at(60), "succeeded", None)]
    stream = stream_of(spark, tmp_path, [rows[::-1], [("z", END, "succeeded", None)]], "key string, at timestamp, event string, deadline int")
    got = {r.key: (r.outcome, r.at) for r in run_machine(spark, tmp_path, machines.run_outcomes(stream)) if r.key != "z"}
    assert got == {"a": ("succeeded", at(59)), "b": ("COLLECTION_TIMEOUT", at(60)), "c": ("COLLECTION_TIMEOUT", at(105)), "d": ("COLLECTION_CANCELLED", at(6)), "e": ("COLLECTION_NETWORK", at(7)), "f": ("succeeded", at(60))}


def test_dedup_keeps_one_across_batches(spark, tmp_path):
    row = (1, datetime(2026, 1, 1))
    stream = stream_of(spark, tmp_path, [[row], [row, (2, datetime(2026, 1, 1))]], "k long, at timestamp")
    assert jobs.run_to_end(jobs.deduplicated(stream, ["k"]), "t").agg(F.count("*").alias("n")).first().n == 2


def test_cadence_and_retry_gates(spark, tmp_path):
    tick, retry = lambda k, s: (k, at(s), 300, "tick", 0), lambda k, s, d: (k, at(s), 300, "retry", d)
    rows = [tick("a", 0), tick("a", 60), tick("a", 299), tick("a", 300), retry("b", 1, 50), tick("b", 0), tick("b", 40), tick("b", 60), tick("b", 120), retry("b", 130, 0), tick("b", 140), tick("b", 500)]
    stream = stream_of(spark, tmp_path, [rows[::-1], [("z", END, 300, "tick", 0)]], "key string, at timestamp, cadence int, action string, delay int")
    got = sorted((r.key, r.at, r.attempt) for r in run_machine(spark, tmp_path, machines.cadence_grants(stream)) if r.key != "z")
    assert got == [("a", at(0), 0), ("a", at(300), 0), ("b", at(0), 0), ("b", at(60), 1), ("b", at(140), 2), ("b", at(500), 0)]


@pytest.mark.parametrize("name", ["stream_dedup", "stream_tumbling_24h", "stream_sessions", "stream_delivery_states"])
def test_streams_over_unordered_files(spark, tmp_path, name):
    """A table may be a folder of files in no order of time; no row is lost, whatever the least event_id is."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 5)
    events.repartition(3, F.hash("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.sql(jobs.oracle_sql()[name])
    assert spark_rows(jobs.queries()[name](spark, str(tmp_path))) == (sorted(found.columns), rows_of(found.columns, found.fetchall()))


def test_guard_reads_marks_only(spark, tmp_path):
    write = jobs.guarded_append(f"{tmp_path}/out", "k", "at")
    for i in range(4):
        write(spark.createDataFrame([("a", datetime(2026, 1, 1 + i)), ("b", datetime(2026, 1, 1))], "k string, at timestamp"), i)
    assert sorted(p.name for p in (tmp_path / "out" / "_marks").iterdir() if not p.name.startswith(".")) == ["2", "3"]
    with pytest.raises(jobs.WatermarkRegression):
        write(spark.createDataFrame([("a", datetime(2026, 1, 3))], "k string, at timestamp"), 4)
    write(spark.createDataFrame([("c", datetime(2025, 1, 1))], "k string, at timestamp"), 4)


def test_a_restarted_job_goes_on_where_it_stopped(spark, tmp_path):
    """State, offsets and output come from the checkpoint: nothing is read or written twice, and keys stay known."""
    at = datetime(2026, 1, 1)

    def go(rows, name):
        spark.createDataFrame(rows, "k long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema("k long, at timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = jobs.deduplicated(stream, ["k"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert go([(1, at), (2, at), (1, at)], "a") == [1, 2]
    assert go([(2, at), (3, at)], "b") == [1, 2, 3]


def test_a_batch_that_failed_half_way_is_written_once(spark, tmp_path):
    """The sink is given the same batch again after a restart."""
    batches = [[("a", datetime(2026, 1, 1))], [("a", datetime(2026, 1, 2))]]
    stream = stream_of(spark, tmp_path, batches, "k string, at timestamp")
    write, failed = jobs.guarded_append(f"{tmp_path}/out", "k", "at"), []

    def lost(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    start = lambda: stream.writeStream.foreachBatch(lost).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(PySparkException, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert failed == [1] and spark.read.parquet(f"{tmp_path}/out/batch=0", f"{tmp_path}/out/batch=1").count() == 2


def test_state_is_stored_by_buckets(spark, tmp_path, monkeypatch):
    """400 keys are 4 buckets of the state store, in several chunks each; nulls keep what they are."""
    monkeypatch.setattr(machines, "_CHUNK", 30)
    rows = [(2**60 + i, at(i % 50), "claim") for i in range(400)] + [(2**60 + i, at(60 + i % 50), "sent") for i in range(0, 400, 2)] + [(None, at(3), "claim")]
    stream = machines.delivery_states(stream_of(spark, tmp_path, [rows[::-1], [(0, END, "sent")]], "key long, at timestamp, action string"), buckets=4)
    query = machines.start(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True), spark)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 100
    last = {}
    for r in sorted(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect(), key=lambda r: r.change):
        last[r.key] = (r.status, r.at)
    assert last.pop(None) == ("stale", at(303))
    assert last == {2**60 + i: ("stale", at(300 + i % 50)) if i % 2 else ("sent", at(60 + i % 50)) for i in range(400)}
