"""Queries of the streaming jobs (Z): each runs to the end of its input and reads the result."""

import math

from pyspark.sql import functions as F

from tagweave.operators import audit as au
from tagweave.operators import enrich, medallion
from tagweave.plans import fixtures as fx
from tagweave.plans.context_queries import AUDIT_FOLD_SQL, AUDIT_HASH_SQL, AUDIT_SEGMENT, AUDIT_SQL, audit_source
from tagweave.plans.registry import query, table
from tagweave.plans.scan_queries import BRONZE_LIST, BRONZE_SQL, SILVER_SQL
from tagweave.schemas import BRONZE_COLUMNS
from tagweave.session import files_version
from tagweave.streaming import jobs

FILES = 6
# Rows of a file at most, about.
FILE_ROWS = 200_000


def _log(spark, sf, copies=1):
    """The log as a few files, each read as a micro-batch."""
    path = fx.scratch(spark, "log")
    rows = fx.plant_envelopes(spark, sf)
    for _ in range(copies):
        rows.repartition(FILES, "partition", "offset").write.mode("append").json(path)
    return jobs.log_stream(spark, path, files_per_batch=2)


def _paths(spark, name):
    return fx.scratch(spark, name), fx.scratch(spark, name + "-cp")


@query("z01_stream_bronze", fx.sql(f"SELECT {BRONZE_LIST}, dt FROM bronze", "plant", "params", bronze=BRONZE_SQL))
def z01(spark, sf):
    out, checkpoint = _paths(spark, "z-bronze")
    log = _log(spark, sf)
    jobs.stream_bronze(log, out, checkpoint).awaitTermination()
    jobs.stream_bronze(log, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(*BRONZE_COLUMNS, F.col("dt").cast("string").alias("dt"))


@query("z02_stream_gold", fx.sql("""
SELECT tag, param, asset, value, unit, ts, quality, bronze_offset, 'pending' AS context_status FROM silver""",
                                 "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def z02(spark, sf):
    out, checkpoint = _paths(spark, "z-gold")
    jobs.stream_gold(_log(spark, sf), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("tag", "param", "asset", "value", "unit", "ts", "quality", "bronze_offset", "context_status")


def _reading_files(spark, sf, df, name="readings"):
    """Readings as files of a bounded size, a third of them per micro-batch."""
    path = fx.scratch(spark, name)
    files = max(FILES, math.ceil(table(spark, sf, "events").count() / FILE_ROWS))
    df.repartition(files).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", math.ceil(files / 3)).parquet(path)


def _run_on_arrival(spark, parts, path, start):
    """Each part is written as it lies and then streamed as one micro-batch."""
    for part in parts:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(part.schema).parquet(path)).awaitTermination()


@query("z03_stream_enrichment", fx.sql("""
SELECT reading_id, 'event' AS kind, asset, batch, status, zone, time_match, NULL AS reason FROM floor_placed WHERE reason IS NULL
UNION ALL SELECT reading_id, 'reject', NULL, NULL, NULL, NULL, NULL, reason FROM floor_placed WHERE reason IS NOT NULL""", "floor_placed"))
def z03(spark, sf):
    events, rejects = fx.scratch(spark, "z-events"), fx.scratch(spark, "z-rejects")
    stream = _reading_files(spark, sf, fx.floor_good(spark, sf))
    lookups = enrich.Snapshots(lambda session: fx.floor_lookups(session, sf),
                               lambda session: files_version(session, [f"{sf}/events.parquet"]))
    jobs.stream_enriched(stream, lookups, events, rejects, fx.scratch(spark, "z-cp"), fx.FLOOR_PARAMETERS).awaitTermination()
    good = spark.read.parquet(events).select("reading_id", F.lit("event").alias("kind"), "asset", "batch", "status", "zone",
                                             "time_match", F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(rejects).select("reading_id", F.lit("reject").alias("kind"), "reason")
    return good.unionByName(bad, allowMissingColumns=True)


@query("z04_stream_dedup", fx.sql("""
SELECT tag, round(value, 4) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", count(*) OVER () AS kept
FROM (SELECT DISTINCT tag, round(value, 4) AS value, date_trunc('second', ts) AS ts FROM plant)""", "plant"))
def z04(spark, sf):
    """Every reading arrives three times; half of them, a fortnight late, for the first time."""
    rows = fx.plant_readings(spark, sf)
    path, (out, checkpoint) = fx.scratch(spark, "late"), _paths(spark, "z-dedup")
    new = F.col("ts") >= F.lit("2026-08-28").cast("timestamp_ntz")
    parts = (rows.filter(new), rows.filter(new), rows.filter(~new), rows.filter(~new), rows)
    _run_on_arrival(spark, parts, path, lambda stream: jobs.stream_deduplicated(stream, out, checkpoint))
    kept = spark.read.parquet(out).select("tag", F.round("value", 4).alias("value"), "timestamp")
    return kept.withColumn("kept", kept.agg(F.count("*")).scalar())


@query("z05_stream_latest", fx.sql("""
SELECT tag, arg_max(value, kafka_offset) AS value, max(kafka_offset) AS kafka_offset, arg_max(ts_raw, kafka_offset) AS ts_raw FROM bronze GROUP BY 1""",
                                   "plant", "params", bronze=BRONZE_SQL))
def z05(spark, sf):
    out, checkpoint = _paths(spark, "z-latest")
    readings = medallion.bronze(_log(spark, sf)).select("tag", "value", "kafka_offset", "ts_raw")
    jobs.stream_latest(readings, out, checkpoint).awaitTermination()
    return jobs.latest_state(spark, out, ["tag"])


@query("z06_stream_counts", fx.sql("""
SELECT param, count(CASE zone WHEN 'control' THEN 1 END) AS control, count(CASE zone WHEN 'alarm' THEN 1 END) AS alarm,
  count(CASE zone WHEN 'trip' THEN 1 END) AS trip, count(CASE status WHEN 'OK' THEN 1 END) AS ok, count(CASE status WHEN 'OVER' THEN 1 END) AS "over",
  count(CASE status WHEN 'UNDER' THEN 1 END) AS "under", count(*) AS total FROM plant_graded GROUP BY 1""", "plant_graded"))
def z06(spark, sf):
    out, checkpoint = _paths(spark, "z-counts")
    stream = jobs.graded(_reading_files(spark, sf, fx.plant_readings(spark, sf)))
    jobs.stream_counts(stream, out, checkpoint).awaitTermination()
    return jobs.latest_state(spark, out, ["param"])


@query("z07_stream_historian", fx.sql("""
SELECT kafka_partition, kafka_offset, tag, value FROM bronze
UNION ALL SELECT kafka_partition + 3, kafka_offset, tag, value FROM bronze""", "plant", "params", bronze=BRONZE_SQL))
def z07(spark, sf):
    """The log holds every envelope twice, and the same offsets in other partitions; the
    historian holds every position once."""
    out, checkpoint = _paths(spark, "z-historian")
    log = _log(spark, sf, copies=2)
    both = log.withColumn("partition", F.explode(F.array("partition", F.col("partition") + fx.LOG_PARTITIONS)))
    jobs.stream_historian(medallion.bronze(both), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("kafka_partition", "kafka_offset", "tag", "value")


@query("z08_paced_replay", fx.sql("""
SELECT strftime(ts, '%Y-%m-%d') AS dt, param, reading_id, value FROM plant""", "plant"))
def z08(spark, sf):
    """All stored readings, a few days' files per micro-batch."""
    path, (out, checkpoint) = fx.scratch(spark, "days"), _paths(spark, "z-paced")
    jobs.write_paced(fx.plant_readings(spark, sf).select("param", "reading_id", "value", "ts"), path)
    schema = "param string, reading_id string, value double, ts timestamp_ntz, dt string"
    stream = jobs.paced_stream(spark, path, schema, files_per_tick=8)
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("dt", "param", "reading_id", "value")


@query("z09_stream_audit", fx.sql("SELECT e.chain, e.segment, e.seq, h.prev_hash, h.hash FROM e JOIN h USING (chain, segment, seq)",
                                  e=AUDIT_SQL, f=AUDIT_FOLD_SQL, h=AUDIT_HASH_SQL))
def z09(spark, sf):
    """Entries arrive day by day; the chains equal those of one batch run."""
    path = fx.scratch(spark, "entries")
    rows = audit_source(spark, sf)
    third = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    out, checkpoint = _paths(spark, "z-audit")
    _run_on_arrival(spark, [rows.filter(third == i) for i in range(3)], path,
                    lambda stream: jobs.stream_audit(stream, out, checkpoint, [F.col("event_id")], AUDIT_SEGMENT))
    return au.stored_entries(spark, out).select("chain", "segment", "seq", "prev_hash", "hash")


