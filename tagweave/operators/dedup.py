"""One row per physical reading: deduplication, source priority, order of stored readings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scalars as s
from tagweave.operators.sizing import first_per_key, numbered


def with_natural_key(readings: DataFrame) -> DataFrame:
    """Tag, value to four decimals, canonical time."""
    return (readings.withColumn("key_tag", F.trim(F.coalesce("tag", F.lit(""))))
            .withColumn("key_value", s.canonical_value("value"))
            .withColumn("key_time", F.coalesce("timestamp", F.lit(""))))


NATURAL_KEY = ["key_tag", "key_value", "key_time"]


def keep_first_reading(readings: DataFrame, order) -> DataFrame:
    """The first copy of each physical reading, by source rank and then row order."""
    return first_per_key(with_natural_key(readings), NATURAL_KEY, order).drop(*NATURAL_KEY)


def keep_first_id(events: DataFrame, order) -> DataFrame:
    """The first enriched event of each reading id; events without an id all stay."""
    named = F.coalesce(F.trim("reading_id"), F.lit("")) != ""
    unique = first_per_key(events.filter(named), ["reading_id"], order)
    return unique.unionByName(events.filter(~named))


def of_parameter(readings: DataFrame, param=None, tag=None) -> DataFrame:
    """Rows of one parameter, by its tag or by the row's own parameter."""
    if param in (None, "all"):
        return readings
    return readings.filter((F.col("tag") == tag) | (F.col("param") == param))


def present_parameters(readings: DataFrame, parameters: DataFrame) -> DataFrame:
    """The catalogue rows whose parameter occurs in the readings."""
    seen = readings.select("param").distinct()
    return parameters.join(seen, "param", "left_semi")


def priority_union(floor: DataFrame, stream: DataFrame, lake: DataFrame, order="row_index",
                   param=None, tag=None) -> DataFrame:
    """Floor rows, then stream rows, first copy kept; lake rows only if neither has any."""
    live = (of_parameter(floor, param, tag).withColumn("source_rank", F.lit(0))
            .unionByName(of_parameter(stream, param, tag).withColumn("source_rank", F.lit(1)),
                         allowMissingColumns=True))
    spare = of_parameter(lake, param, tag).withColumn("source_rank", F.lit(2))
    spare = spare.filter(~live.select("source_rank").exists())
    rows = live.unionByName(spare, allowMissingColumns=True)
    return keep_first_reading(rows, [F.col("source_rank"), F.col(order)])


def replay_order(readings: DataFrame, order) -> DataFrame:
    """The place of every stored reading in its parameter's order, from 0."""
    return numbered(readings, order, group=["param"], start=0, out="tick")
