"""Streaming operators, run over a table that arrives in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pinned import scratch
from tessera.plans.registry import Registry, table
from tessera.streaming import ring as R

registry = Registry()

#: Parts in which the events arrive, one micro-batch each.
PARTS = 6
_PART_SQL = f"least(epoch_us(ts) - min(epoch_us(ts)) OVER (), max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () - 1) * {PARTS} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ())"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the ``part`` they arrive in: equal spans of time."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    ends = events.agg(F.min(at).alias("first"), F.max(at).alias("last"))
    part = F.expr(f"least(unix_micros(ts) - first, last - first - 1) * {PARTS} div (last - first)")
    return events.join(F.broadcast(ends)).withColumn("part", part).drop("first", "last")


def arrive(rows: DataFrame, parts: int, build: Callable[[DataFrame], DataFrame], mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Let the rows arrive part by part (column ``part``) and run the stream on each part.

    The query stops after each part and is started again from its checkpoint
    for the next one: nothing is carried over but what the checkpoint holds.
    """
    spark = rows.sparkSession
    folder, kept = scratch(spark, "arrived"), spark.conf.get(R.STORE[0], None)
    spark.conf.set(*R.STORE)
    try:
        for part in range(parts):
            rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
            stream = build(spark.readStream.schema(rows.drop("part").schema).parquet(folder))
            stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset(R.STORE[0])
        else:
            spark.conf.set(R.STORE[0], kept)


def _stored(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch, so that one that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _rank() -> Column:
    return (F.col("user_id") % 4).alias("rank")


@registry.query("""
WITH n AS (SELECT user_id % 4 AS rank, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events), s AS (SELECT rank, event_id, (n - 1) % 10 AS slot, row_number() OVER (PARTITION BY rank, (n - 1) % 10 ORDER BY n DESC) AS k FROM n)
SELECT rank, slot, event_id FROM s WHERE k = 1""")
def stream_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer as its checkpoint holds it after six batches, each run of its own."""
    checkpoint = scratch(spark, "ring")
    build = lambda events: R.ring(events.select(_rank(), F.unix_micros("ts").alias("at"), "event_id"), "rank", "at", "event_id", 10)
    arrive(_events(spark, sf_dir).select("part", "ts", "user_id", "event_id"), PARTS, build, "update", lambda batch, number: batch.write.format("noop").mode("overwrite").save(), checkpoint)
    return R.contents(spark, checkpoint).select("rank", "slot", F.col("value").alias("event_id"))


@registry.query("""
WITH n AS (SELECT user_id % 4 AS rank, event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events), s AS (SELECT rank, event_id, (n - 1) % 10 AS slot, row_number() OVER (PARTITION BY rank, (n - 1) % 10 ORDER BY n DESC) AS k FROM n),
h AS (SELECT rank, slot, event_id, count(*) OVER (PARTITION BY rank) AS held FROM s WHERE k = 1), p AS (SELECT unnest(range(4)) AS place)
SELECT rank, place::INT AS place, slot, event_id FROM h JOIN p ON slot = (8 + place) % held""")
def stream_ring_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third run of four slots of each rank's buffer, which passes its end."""
    held = stream_ring_buffer(spark, sf_dir).withColumnRenamed("event_id", "value")
    return R.read_slots(held, "rank", 2, 4).select("rank", "place", "slot", F.col("value").alias("event_id"))


@registry.query("""
WITH e AS (SELECT *, event_id % 50 = 0 AS late, date_trunc('hour', ts) AS h FROM events), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e WHERE NOT late)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM e, w WHERE NOT late OR h + INTERVAL 1 HOUR > mark GROUP BY ALL""")
def stream_running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth event arrives in a batch of its own behind all others: those whose hour has ended are left out."""
    path = scratch(spark, "means")
    late = F.when(F.col("event_id") % 50 == 0, PARTS).otherwise(F.col("part"))
    rows = _events(spark, sf_dir).withColumn("part", late).select("part", "ts", "event_type", "value")
    arrive(rows, PARTS + 1, lambda events: R.running_means(events, "ts", "event_type", "value"), "update", _stored(path), scratch(spark, "stream"))
    out = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("mean", "n"), "batch").alias("r"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", F.round("r.mean", 6).alias("mean"), "r.n")


@registry.query(f"""
WITH p AS (SELECT {_PART_SQL} AS batch FROM events) SELECT batch::INT AS batch, CASE WHEN batch IN (1, 3) THEN 'reuse' ELSE 'fill' END AS kind, count(*) AS events FROM p GROUP BY ALL""")
def stream_refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six batches of events; a refill serves one more batch, and every fifth batch refills in any case."""
    source, out, left = scratch(spark, "steps"), scratch(spark, "refills"), [0]
    rows, checkpoint = _events(spark, sf_dir).select("part", "event_id"), scratch(spark, "stream")

    def note(kind: str, after: int):
        def put(batch: DataFrame, number: int) -> None:
            left[0] = after
            batch.agg(F.lit(number).alias("batch"), F.lit(kind).alias("kind"), F.count("*").alias("events")).write.mode("overwrite").parquet(f"{out}/{number}")

        return put

    for part in range(PARTS):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        steps = spark.readStream.schema("event_id long").parquet(source)
        R.regenerate(steps, 5, note("fill", 1), note("reuse", 0), checkpoint, lambda: left[0]).awaitTermination()
    return spark.read.parquet(f"{out}/*")
