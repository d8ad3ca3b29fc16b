"""Structured Streaming jobs, run to the end of what is there (``availableNow``) and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tables import fresh_path
from siltstone.streaming import machines


def source(spark: SparkSession, sf_dir: str, name: str, *, files: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of many: ``files`` a micro-batch, or all that are there."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    # A stream takes a folder or a pattern, and a table may be one file: as a pattern, its path stands for both.
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def run_to_end(stream: DataFrame, name: str, *, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """Runs a stream until its source is exhausted and returns what it wrote: exactly once, by checkpoint and file sink.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, for all that is there (``availableNow``) unless given; one that
    never ends is left to the caller to stop.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], *, delay: str = "40 days") -> DataFrame:
    """First event of each key within the watermark: state is bounded by the delay, not by the number of keys seen."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, *, width: str = "24 hours", delay: str = "0 seconds") -> DataFrame:
    """Counts by fixed windows; late rows beyond the delay are dropped."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, *, gap: str = "24 hours", delay: str = "0 seconds") -> DataFrame:
    """Counts by sessions of a user: a pause as long as ``gap`` ends one."""
    return events.withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))


class WatermarkRegression(ValueError):
    """A source went back in time."""


def guarded_append(path: str, by: str, at: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that fails a batch whose rows are older than what was stored, instead of dropping them.

    Batches are folders named by their id, so a repeated batch replaces itself.  Beside them stands the greatest time of each
    key after each batch, so a batch reads what the one before it left and no older rows; of these tables the last two stay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy(by).agg(F.min(at).alias("_least"), F.max(at).alias("_most"))
        marks = lambda i: f"{path}/_marks/{i}"
        if batch_id:
            stored = spark.read.parquet(marks(batch_id - 1))
            if now.join(stored.withColumnRenamed("_most", "_stored"), by).where("_least < _stored").limit(1).count():
                raise WatermarkRegression("COLLECTION_CONTRACT_INVALID")
            now = now.select(by, "_most").unionByName(stored).groupBy(by).agg(F.max("_most").alias("_most"))
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        now.select(by, "_most").write.mode("overwrite").parquet(marks(batch_id))
        if batch_id > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(marks(batch_id - 2))
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return write


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(deduplicated(_events(spark, sf_dir), ["user_id", "event_type"]), "stream_dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


def _window_columns(start: Column) -> Column:
    return F.date_format(start, "yyyy-MM-dd HH:mm:ss")


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events and one row far ahead, from a table of its own, whose time closes all windows before it.

    Files of a table are in no order of time, so they are one micro-batch: the watermark then moves behind all of them, and
    no row is late.
    """
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "at")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("at"))
    path = fresh_path(spark, "end")
    end.write.parquet(path)
    return events.union(spark.readStream.schema(end.schema).parquet(path))


def stream_tumbling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(tumbling(_closed(spark, sf_dir)), "stream_tumbling").select(_window_columns(F.col("window.start")).alias("window_start"), "event_type", "n").where("event_type <> 'end'")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(sessions(_closed(spark, sf_dir)), "stream_sessions").where("user_id >= 0").select("user_id", _window_columns(F.col("session_window.start")).alias("session_start"), "n")


def _machine_to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a machine said until its source was exhausted."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    machines.start(stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True), spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each notification after a stream of actions made from events; the row far ahead lets all timers run."""
    rows = _closed(spark, sf_dir)
    action = F.when(F.col("event_type").isin("view", "click", "signup"), "claim").when(F.col("event_type") == "purchase", "sent").otherwise("failed")
    changes = _machine_to_end(machines.delivery_states(rows.select(F.col("user_id").alias("key"), "at", action.alias("action"))), "stream_delivery").where("key >= 0")
    return changes.groupBy("key").agg(F.max_by("status", "change").alias("status"), F.max_by("retry_count", "change").alias("retry_count"), F.max("change").alias("changes"))


def stream_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs ended: each event starts a run that has one to six minutes, and says after half a minute to five how it ended."""
    rows = _closed(spark, sf_dir)
    said = F.when(F.col("event_id") % 7 == 0, "cancelled").when(F.col("event_id") % 11 == 0, "COLLECTION_NETWORK").otherwise("succeeded")
    run = F.col("event_id").cast("string")
    begun = F.struct(run.alias("key"), F.col("at"), F.lit("started").alias("event"), (60 + F.col("event_id") % 6 * 60).alias("deadline"))
    ended = F.struct(run.alias("key"), (F.col("at") + F.expr("make_dt_interval(0, 0, 0, 30 + event_id % 10 * 30)")).alias("at"), said.alias("event"), F.lit(None).cast("long").alias("deadline"))
    events = rows.select(F.explode(F.when(F.col("event_id") < 0, F.array(begun)).otherwise(F.array(begun, ended))).alias("e")).select("e.*")
    found = _machine_to_end(machines.run_outcomes(events), "stream_outcomes").where("cast(key as long) >= 0")
    return found.groupBy("outcome").agg(F.count("*").alias("runs"), F.max(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("last_at"))


_SQL = {
    "stream_dedup": "SELECT user_id, event_type, 1::BIGINT AS kept FROM events GROUP BY user_id, event_type",
    "stream_tumbling_24h": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    # All users one action further in each round; what is still sending in the end turns stale, as time goes on.
    "stream_delivery_states": """WITH RECURSIVE e AS (SELECT user_id AS key, ts, a, row_number() OVER (PARTITION BY user_id ORDER BY ts, a) AS n
          FROM (SELECT user_id, ts, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'claim' WHEN event_type = 'purchase' THEN 'sent' ELSE 'failed' END AS a FROM events)),
        m(key, n, status, tries, since, changes) AS (
          SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'pending', CAST(0 AS BIGINT), TIMESTAMP '1970-01-01', CAST(0 AS BIGINT) FROM events
          UNION ALL
          SELECT key, n, CASE WHEN goes THEN 'sending' WHEN ends THEN a ELSE seen END, tries + CASE WHEN goes AND seen <> 'pending' THEN 1 ELSE 0 END, CASE WHEN goes THEN ts ELSE since END,
            changes + CASE WHEN seen <> status THEN 1 ELSE 0 END + CASE WHEN goes OR ends THEN 1 ELSE 0 END
          FROM (SELECT *, a = 'claim' AND tries < 3 AND seen IN ('pending', 'failed', 'stale') AS goes, a <> 'claim' AND seen IN ('sending', 'stale') AS ends
            FROM (SELECT e.key, e.n, e.ts, e.a, status, tries, since, changes, CASE WHEN status = 'sending' AND e.ts - since > INTERVAL 300 SECOND THEN 'stale' ELSE status END AS seen FROM m JOIN e ON e.key = m.key AND e.n = m.n + 1)))
        SELECT key, CASE WHEN status = 'sending' THEN 'stale' ELSE status END AS status, tries AS retry_count, changes + CASE WHEN status = 'sending' THEN 1 ELSE 0 END AS changes
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS last FROM m) WHERE last = 1""",
    "stream_run_outcomes": """WITH r AS (SELECT ts, 30 + event_id % 10 * 30 AS took, 60 + event_id % 6 * 60 AS had, CASE WHEN event_id % 7 = 0 THEN 'COLLECTION_CANCELLED' WHEN event_id % 11 = 0 THEN 'COLLECTION_NETWORK' ELSE 'succeeded' END AS said FROM events)
        SELECT CASE WHEN took > had THEN 'COLLECTION_TIMEOUT' ELSE said END AS outcome, count(*) AS runs, strftime(max(ts + to_seconds(CAST(least(took, had) AS BIGINT))), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM r GROUP BY 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_dedup, stream_tumbling_24h, stream_sessions, stream_delivery_states, stream_run_outcomes)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
