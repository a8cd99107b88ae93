"""Helpers that several operators share."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import scratch_path

# A key with more than 1/HOT_SHARE of all rows is hot; fewer than HOT_SHARE keys can be.
HOT_SHARE = 10_000
# Text that a task turns into arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks only, and no later
    stage computes the result a second time.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut an Arrow batch into runs of whole rows with bounded text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(array: pa.Array) -> list:
    """UTF-8 bytes of every text, None for null, without decoding."""
    return array.cast(pa.binary()).to_pylist()


def attach(fact: DataFrame, dim: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Left join to a table that has one row per key and knows each key's rows in the fact table.

    Keys with more than 1/HOT_SHARE of the fact rows are broadcast, which the share bounds
    to fewer than HOT_SHARE rows; their fact rows are spread over all tasks instead of
    meeting in one. ``dim`` gives its columns but ``rows``; null keys get nulls.
    """
    values = [c for c in dim.columns if c not in (key, rows)]
    is_hot = F.col(rows) * HOT_SHARE > F.lit(total)
    hot = dim.filter(is_hot).select(key, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = dim.filter(~is_hot).select(key, F.lit(0).alias("_salt"), *values)
    spread = F.pmod(F.xxhash64(*fact.columns), F.lit(1 << 20)).cast("int") + 1
    split = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = fact.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(split, spread).otherwise(0))
    joined = marked.join(cold, [key, "_salt"], "left")
    return joined.select(*fact.columns, *[
        F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])
