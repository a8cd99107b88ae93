"""Writing lake tables, the historian, the log and exports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.operators import medallion
from tagweave.operators.sizing import first_per_key
from tagweave.schemas import ENVELOPE
from tagweave.sources.tables import existing


def write_days(df: DataFrame, path: str, mode="append") -> str:
    """A table under dt=YYYY-MM-DD.

    Rows are rebalanced by day under adaptive execution: a large day is cut into as many
    tasks as its size asks for, small days share one.
    """
    df.hint("rebalance", "dt").write.mode(mode).partitionBy("dt").parquet(path)
    return path


def land_bronze(envelopes: DataFrame, path: str) -> str:
    """K1: Bronze, each row under its own day."""
    return write_days(medallion.bronze(envelopes), path)


def write_silver(bronze: DataFrame, path: str) -> str:
    """K2: Silver under the day of the raw clock."""
    return write_days(medallion.with_day(medallion.silver(bronze)), path)


def write_gold(silver: DataFrame, path: str) -> str:
    """K3: the Gold lake table; the snapshot is ``medallion.latest_by_time`` over it."""
    return write_days(medallion.with_day(medallion.gold(silver)), path)


# What identifies a log record: an offset counts within its partition only.
LOG_POSITION = ["kafka_topic", "kafka_partition", "kafka_offset"]


def insert_new(batch: DataFrame, target: DataFrame, key=tuple(LOG_POSITION)) -> DataFrame:
    """K4: the rows of a batch whose key is new, one copy of each key."""
    fresh = first_per_key(batch, list(key), [F.col(key[-1])])
    return fresh.join(target.select(*key), list(key), "left_anti").select(*batch.columns)


def append_historian(batch: DataFrame, path: str, key=tuple(LOG_POSITION)) -> None:
    """K4: insert that may be repeated; log positions already stored are skipped.

    Only target rows within the batch's offset range are read, through the Parquet
    min / max statistics.
    """
    spark = batch.sparkSession
    target = existing(spark, path)
    if target is not None:
        low, high = batch.agg(F.min(key[-1]), F.max(key[-1])).first()
        if low is None:
            return
        batch = insert_new(batch, target.filter(F.col(key[-1]).between(low, high)), key)
    else:
        batch = first_per_key(batch, list(key), [F.col(key[-1])])
    batch.write.mode("append").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """K5: contextualized events, marked as gold."""
    events.withColumn("medallion_zone", F.lit("gold")).write.mode("append").parquet(path)


def write_log_files(envelopes: DataFrame, path: str) -> str:
    """K6: envelopes as JSON lines; with Kafka, write ``medallion.log_records`` instead."""
    envelopes.write.mode("append").json(path)
    return path


def write_log_topic(envelopes: DataFrame, servers: str, topic=fixed.TOPIC) -> None:
    """K6: envelopes to a Kafka topic (needs the Kafka connector on the class path)."""
    (medallion.log_records(envelopes).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """S8 as a batch: the log files with their explicit schema."""
    return spark.read.schema(ENVELOPE).json(path)


def export_frame(events: DataFrame, zone_column="zone") -> DataFrame:
    """The fixed column order as text; arrays joined, nulls blank."""
    kinds = dict(events.dtypes)

    def cell(name):
        if kinds[name].startswith("array"):
            return F.array_join(F.transform(name, lambda x: x.cast("string")), ", ")
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return events.select(*[cell(c).alias(c) for c in fixed.EXPORT_COLUMNS],
                         F.col(zone_column).alias("board"))


def export_board(events: DataFrame, path: str, zone_column="zone") -> str:
    """One CSV folder per zone."""
    export_frame(events, zone_column).write.mode("overwrite").option("header", True).partitionBy("board").csv(path)
    return path


def export_table(spark: SparkSession, lake_path: str, path: str) -> str:
    """A whole lake table as CSV."""
    spark.read.parquet(lake_path).write.mode("overwrite").option("header", True).csv(path)
    return path
