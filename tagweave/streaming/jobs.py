"""The same operators on streams.

Each job returns a started query. With ``available_now`` it processes what is there and
stops, which is how the tests drive it; without, it runs on.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import audit as au
from tagweave.operators import boards, enrich, medallion
from tagweave.operators.dedup import NATURAL_KEY, with_natural_key
from tagweave.operators.sizing import first_per_key
from tagweave.schemas import ENVELOPE
from tagweave.sources import commits, sinks
from tagweave.sources import parameters as dims


def log_stream(spark: SparkSession, path: str, files_per_batch=None) -> DataFrame:
    """Log files as a stream of typed envelopes."""
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic as the same envelopes (needs the Kafka connector)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", "earliest").option("includeHeaders", True).load())
    return medallion.from_records(raw)


def _start(writer, checkpoint: str, available_now: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_bronze(envelopes: DataFrame, path: str, checkpoint: str, available_now=True):
    """Log to Bronze; the file sink's commit log makes a replay harmless."""
    rows = medallion.bronze(envelopes)
    return _start(rows.writeStream.format("parquet").partitionBy("dt").option("path", path),
                  checkpoint, available_now)


def stream_gold(envelopes: DataFrame, path: str, checkpoint: str, parameters=dims.BUILT_IN, available_now=True):
    """Log to Gold in one stateless chain, under day folders as the batch writer."""
    rows = medallion.with_day(medallion.gold(medallion.silver(medallion.bronze(envelopes), parameters)))
    return _start(rows.writeStream.format("parquet").partitionBy("dt").option("path", path), checkpoint, available_now)


def stream_enriched(readings: DataFrame, load_lookups, events_path: str, rejects_path: str,
                    checkpoint: str, parameters=dims.BUILT_IN, available_now=True):
    """Z3: every micro-batch through the batch chain, with the lookups that ``load_lookups`` gives
    for it; ``enrich.Snapshots`` prepares them again only when they have changed.

    Output lands under the batch id and replaces it, so a repeated batch changes nothing.
    """
    def handle(batch: DataFrame, batch_id: int):
        full = enrich.enrich(batch, load_lookups(batch.sparkSession), parameters).persist()
        enrich.events_of(full).drop("lookup_origin").write.mode("overwrite").parquet(f"{events_path}/micro_batch={batch_id}")
        enrich.rejects_of(full).write.mode("overwrite").parquet(f"{rejects_path}/micro_batch={batch_id}")
        full.unpersist()

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, available_now)


def stream_deduplicated(readings: DataFrame, path: str, checkpoint: str, available_now=True):
    """The first copy of each physical reading, however late it comes.

    A micro-batch is compared with what is stored for its own days, so there is no state
    that forgets keys and no reading is too late. Output lands under the batch id and
    replaces it, so a repeated batch changes nothing.
    """
    def handle(batch: DataFrame, batch_id: int):
        day = F.when(F.col("key_time") == "", "unknown").otherwise(F.substring("key_time", 1, 10))
        keyed = with_natural_key(batch).withColumn("dt", day)
        fresh = first_per_key(keyed, NATURAL_KEY, [F.xxhash64(*batch.columns)])
        stored = sinks.existing(batch.sparkSession, path)
        if stored is not None:
            days = [r[0] for r in keyed.select("dt").distinct().collect()]  # as many as the calendar has
            before = stored.filter((F.col("micro_batch") < batch_id) & F.col("dt").cast("string").isin(days))
            fresh = fresh.join(with_natural_key(before).select(*NATURAL_KEY), NATURAL_KEY, "left_anti")
        (fresh.drop(*NATURAL_KEY).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/micro_batch={batch_id}"))

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, available_now)


def _change_state(batch: DataFrame, path: str, batch_id: int, keys, owner: str) -> None:
    """The changed keys of a micro-batch, as one commit."""
    change = commits.Batch(batch.sparkSession, path, batch_id, owner)
    change.change(batch, keys)
    change.commit()


def latest_state(spark: SparkSession, path: str, keys) -> DataFrame:
    """The current row of every key that a stream keeps at a path."""
    return commits.read_state(spark, path, keys)


def stream_latest(readings: DataFrame, path: str, checkpoint: str, key="tag", order="kafka_offset",
                  available_now=True):
    """The last arrived reading per tag, kept in state."""
    rest = [c for c in readings.columns if c != key]
    latest = readings.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
    return _start(latest.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: _change_state(batch, path, batch_id, [key], checkpoint)), checkpoint, available_now)


def stream_counts(events: DataFrame, path: str, checkpoint: str, available_now=True):
    """Zone and status counts per parameter, kept in state. ``events`` carry zone and status."""
    counts = events.groupBy("param").agg(
        *[F.count_if(F.col("zone") == z).alias(z) for z in boards.ZONES],
        *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("OK", "OVER", "UNDER")],
        F.count("*").alias("total"))
    return _start(counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: _change_state(batch, path, batch_id, ["param"], checkpoint)), checkpoint, available_now)


def graded(readings: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """Readings with status and zone from the parameter's own bands; stateless."""
    from tagweave.functions import bands

    catalogue = dims.parameter_frame(readings.sparkSession, parameters)
    rows = readings.join(F.broadcast(catalogue), "param")
    value, lo, hi = F.col("value"), F.col("p_control_lo"), F.col("p_control_hi")
    pairs = [(F.col(f"p_{k}_lo"), F.col(f"p_{k}_hi")) for k in boards.ZONES]
    return rows.withColumn("status", bands.status_of(value, lo, hi)).withColumn(
        "zone", bands.zone_of(value, *pairs)).select(*readings.columns, "status", "zone")


def stream_historian(bronze: DataFrame, path: str, checkpoint: str, available_now=True):
    """K4 per micro-batch, so replays and repeated offsets store nothing twice."""
    def handle(batch: DataFrame, batch_id: int):
        sinks.append_historian(batch, path)

    return _start(bronze.writeStream.foreachBatch(handle), checkpoint, available_now)


def write_paced(rows: DataFrame, path: str, clock="ts") -> str:
    """Stored rows as files, one folder per day, to be streamed in that order."""
    return sinks.write_days(medallion.with_day(rows, clock), path, mode="overwrite")


def paced_stream(spark: SparkSession, path: str, schema, files_per_tick=1) -> DataFrame:
    """The files as a stream of a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_tick).parquet(path)


def stream_audit(entries: DataFrame, path: str, checkpoint: str, order, segment_rows=au.SEGMENT_ROWS,
                 available_now=True):
    """Continue every chain from its last hash; a micro-batch is an append of its number."""
    def handle(batch: DataFrame, batch_id: int):
        au.write_log(batch, order, path, segment_rows, batch_id, checkpoint)

    return _start(entries.writeStream.foreachBatch(handle), checkpoint, available_now)
