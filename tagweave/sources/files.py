"""Lookup tables, lake tables, documents and file listings."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.operators.sizing import lookup_join


def _normal_rows(df: DataFrame, keep=None) -> DataFrame:
    """Header names normalised, cells trimmed, rows without any content dropped."""
    cells = [c for c in df.columns if c != keep]
    named = df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(s.field_name(c)) for c in cells], *[keep] * bool(keep))
    return named.filter(F.coalesce(*[s.blank_to_null(s.field_name(c)) for c in cells]).isNotNull())


def read_lookup_table(spark: SparkSession, path: str, kind="csv", order=False) -> DataFrame:
    """A CSV, TSV, TXT or JSON lookup file as text columns under normalised names.

    With ``order`` a column ``seq`` follows the order of the files' names and of the rows in
    them, however Spark deals the files out; joins that take the first row rely on it.
    """
    if kind == "json":
        raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    else:
        raw = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    at = ["_file", "_block", "_at"] if order else []
    if order:
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_at"))
    inner = [c for c in ("rows", "data", "records") if c in raw.columns and dict(raw.dtypes)[c].startswith("array<struct")]
    if kind == "json" and inner:
        raw = raw.select(*at, F.posexplode(F.col(inner[0])).alias("_pos", "_row")).select(*at, "_pos", "_row.*")
        if order:
            raw = raw.withColumn("_at", F.col("_at") + F.col("_pos"))
        raw = raw.drop("_pos")
    if not order:
        return _normal_rows(raw)
    # Rows before a row in its block take a byte or more each, so block start plus row is in order.
    blocks = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"))
    files = blocks.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")))
    placed = lookup_join(raw, blocks.join(files, "_file"), ["_file", "_block"], "inner")
    seq = F.col("_rank") * F.lit(1 << 44) + F.col("_block") + F.col("_at") - F.col("_first")
    return _normal_rows(placed.withColumn("_seq", seq.cast("long")).drop(*at, "_first", "_rank"), keep="_seq").withColumnRenamed("_seq", "seq")


def read_lake(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """A lake table; days outside the range are not listed or read."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter(F.col("dt") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("dt") <= F.lit(until))
    return df


def read_documents(spark: SparkSession, path: str, pattern="*.{txt,md,csv,tsv}") -> DataFrame:
    """Whole text files with their names."""
    return (spark.read.option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("filename"),
                    F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def content_type(name, content=None):
    """MIME type by leading bytes, then by extension."""
    out = F.lit("application/octet-stream")
    suffix = s.extension(name)
    for ext, mime in fixed.EXTENSION_TYPES.items():
        out = F.when(suffix == ext, mime).otherwise(out)
    if content is None:
        return out
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise(out)
    for prefix, mime in reversed(fixed.FILE_SIGNATURES):
        out = F.when(head.startswith(prefix), mime).otherwise(out)
    return out


def file_profile(files: DataFrame) -> DataFrame:
    """files(path, length, content) to type, extension, size and kind."""
    mime = content_type(F.col("path"), F.col("content"))
    rows = files.select(s.base_name("path").alias("filename"), mime.alias("content_type"),
                        s.extension("path").alias("extension"), F.col("length").alias("size_bytes"))
    return rows.withColumn("file_kind", F.when(F.col("content_type").startswith("image/"), "image")
                           .when(F.col("content_type").contains("pdf") | (F.col("extension") == "pdf"), "pdf")
                           .otherwise("file"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def inventory(files: DataFrame, prefix=None, extensions=tuple(fixed.READING_FILE_EXTENSIONS)) -> DataFrame:
    """Reading files, preferred name prefix first, then newest; the content is not read."""
    rows = files.select(s.base_name("path").alias("name"), "path", F.col("length").alias("bytes"),
                        F.col("modificationTime").alias("mtime"))
    rows = rows.filter(s.extension("name").isin(list(extensions)))
    preferred = F.lower("name").startswith(prefix.lower()) if prefix else F.lit(False)
    return rows.withColumn("preferred", preferred).orderBy(F.desc("preferred"), F.desc("mtime"), "name")
