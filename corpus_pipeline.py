"""The corpus pipeline: documents through the operators of ``tagweave.llm``, stage by stage.

Every stage but the last returns the columns of documents. Each decides on what the stage
before kept, and its result is written as Parquet and read again by the next one.
"""

from pyspark.sql import functions as F

from tagweave.llm import decontamination, language, line_dedup, packing, simhash
from tagweave.llm.common import saved
from tagweave.operators.sizing import lookup_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A language is one of a document's if it holds so large a share of the words; all of a
# document's languages together must hold half of them.
MIN_PART = 0.1
MIN_SHARE = 0.5


def language_id(spark, docs, sf_dir):
    """Documents without a letter go, and those in which no languages hold half of the words.
    A text in several languages stays."""
    found = language.identified(docs, keep=COLUMNS)
    parts = F.filter(F.transform("languages", lambda part: part["share"]), lambda share: share >= MIN_PART)
    held = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (held >= MIN_SHARE)).select(*COLUMNS)


def dedup_lines(spark, docs, sf_dir):
    """Lines that three or more documents hold stay in the largest of them only. Every document
    stays, with the text and length that are left."""
    found = line_dedup.dedup_lines(docs, keep=["text", "lang", "source"])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Of each SimHash component one row stays: that of the smallest id, a row without an id only
    if the component has no other, and of several rows with that id the one of smallest hash.
    Of identical rows one stays."""
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text", "lang", "source", "n_chars"))
    groups = simhash.near_duplicates(rows, keep=["row"])
    counted = groups.groupBy("root", "doc_id", "row").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("s")
    stay = saved(counted.groupBy("root").agg(first).select(
        F.col("s.doc_id").alias("_id"), F.col("s.row").alias("_row"), F.col("s.n").alias("_n")), "stay")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    kept = rows.join(stay.filter("_n = 1"), match, "left_semi").select(*COLUMNS)
    several = stay.filter("_n > 1").select(F.coalesce(F.col("_id").cast("string"), F.lit("none")).alias("_id"), "_row")
    if several.isEmpty():
        return kept
    keyed = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).withColumnRenamed("row", "_row")
    same = lookup_join(keyed, several, ["_id", "_row"], "left_semi", small=False)
    return kept.unionByName(same.dropDuplicates(["_id", "_row"]).select(*COLUMNS))


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.screen(docs, items, keep=COLUMNS).filter(F.size("matches") == 0).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """The documents that are left as pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# Mixture inference, XXH64 fingerprints and tokenizers cannot be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
