"""Joins and numbering that stay safe when one key holds a large share of the rows."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import scratch_path, shared_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Files are compressed.
BROADCAST_FILE_BYTES = 16 * 1024 * 1024
HOT_SHARE = 10_000


def fits_broadcast(df: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """Measure a build side; broadcasting is allowed only below both bounds."""
    return fit_broadcast({"table": df}, max_rows, max_bytes)["table"]


def fit_broadcast(tables: dict, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> dict:
    """Measure several build sides in one job."""
    measured = None
    for name, df in tables.items():
        width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
        one = one.select(F.lit(name).alias("name"), "rows", "bytes")
        measured = one if measured is None else measured.unionByName(one)
    return {r["name"]: r["rows"] <= max_rows and r["bytes"] <= max_bytes for r in measured.collect()}


def stored(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """Write a lookup table once and read it back, with its size class.

    The class comes from the bytes and the row count of the files, not from a pass over the
    rows; nothing stays cached.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return table, size <= BROADCAST_FILE_BYTES and table.count() <= BROADCAST_ROWS


def stored_all(tables: dict) -> tuple[dict, dict]:
    """``stored`` for several independent tables at once: the tables and their size classes."""
    with ThreadPoolExecutor(len(tables)) as pool:
        done = dict(zip(tables, pool.map(stored, tables.values(), tables)))
    return {name: df for name, (df, _) in done.items()}, {name: small for name, (_, small) in done.items()}


def lookup_join(fact: DataFrame, dim: DataFrame, keys, how="left", small=None) -> DataFrame:
    """Equi-join (left, inner, left_semi or left_anti) a large table with a lookup that has
    at most one row per key.

    A lookup measured small is broadcast, so the fact table is not shuffled. Above the
    bound it is a shuffle join in which no key is hot: a key that holds more than
    1/HOT_SHARE of the fact rows is split over as many salts as it holds such shares, and only
    its lookup row is repeated per salt. Fewer than HOT_SHARE such keys can exist, so their
    table is bounded. Rows with a null key never match and are spread as well.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if small is None:
        small = fits_broadcast(dim)
    if small:
        return fact.join(F.broadcast(dim), keys, how)

    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    hot = F.broadcast(hot_keys(fact.filter(present), keys))
    hashable = [f.name for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]
    # The row and its partition: the same again when a task is repeated, unlike for copies.
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in hashable], F.spark_partition_id())
    parts = F.when(present, F.coalesce("_salts", F.lit(1))).otherwise(HOT_SHARE)
    salted = fact.join(hot, keys, "left").withColumn("_salt", F.pmod(spread, parts)).drop("_salts")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = dim.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def hot_keys(fact: DataFrame, keys) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of the rows, with the shares they hold."""
    counted = fact.groupBy(*keys).count().persist()
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = counted.filter(F.col("count") * HOT_SHARE > total).withColumn(
        "_salts", F.ceil(F.col("count") * HOT_SHARE / F.lit(max(total, 1))).cast("long")).drop("count")
    found = fact.sparkSession.createDataFrame(hot.collect(), hot.schema)
    counted.unpersist()
    return found


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first row of every key.

    Spark keeps only one row per key and task before it shuffles, so a key that holds
    most rows does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys, order, k: int, rank="rank") -> DataFrame:
    """Keep the first k rows of every key with their rank, cut per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def numbered(df: DataFrame, order, group=(), start=1, out="seq") -> DataFrame:
    """Dense numbers in order, overall or per group, without a single-task window.

    Rows are range-partitioned by group and order, so a large group spans many tasks.
    Each row's number is its place in its partition plus the rows of its group in the
    partitions before; only one carried count per partition is broadcast. The sorted
    rows are checkpointed so that both passes see the same partitions.
    """
    spark = df.sparkSession
    shared_dir(spark)
    group = list(group)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(g) for g in group] + list(order)
    laid = (df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
            .withColumn("_at", F.monotonically_increasing_id())
            .checkpoint(eager=True))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))

    runs = laid.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    if not group:
        carried = (runs.withColumn("_before", F.coalesce(F.sum("_rows").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select("_part", "_from", "_before"))
        placed = laid.join(F.broadcast(carried), "_part")
        number = F.col("_before") + F.col("_at") - F.col("_from") + F.lit(start)
        return placed.withColumn(out, number.cast("long")).drop("_part", "_at", "_from", "_before")

    # Inside one partition rows are sorted, so a group is one run: its place is a local rank.
    local = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_at"))
    carried = (runs.withColumn("_before", F.sum("_rows").over(
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .filter("_before > 0").select("_part", *group, "_before"))
    # Only the first group of a partition can have begun earlier: at most `parts` rows.
    ranked = laid.withColumn("_local", local)
    match = ranked["_part"] == carried["_part"]
    for g in group:
        match = match & ranked[g].eqNullSafe(carried[g])
    placed = ranked.join(F.broadcast(carried), match, "left").select(
        *[ranked[c] for c in df.columns], ranked["_local"], carried["_before"])
    number = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local") - 1 + F.lit(start)
    return placed.withColumn(out, number.cast("long")).drop("_local", "_before")
