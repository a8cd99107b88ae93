"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of distinct line keys, bucketed and sorted by key: the key's 128-bit hash,
the number of documents that hold it and its holder, the largest doc_id. Batches arrive
with falling document ids. The keys of a batch are merge-anti-joined with the runs, which
share their buckets: a key that no run has yet takes its holder from this batch, a known
key only adds to the count. The batch then becomes a run of level 0. Before a level would
hold more than ``fanout`` runs, they are merged into one of the next level.

Defined cases: a text is split at line feeds; null and empty texts are one empty line. Keys
are lines stripped of ASCII white space with A-Z lower-cased. Every row of documents counts
as a document, also when it repeats a doc_id; decisions depend on (key, doc_id) alone. Rows
without a doc_id are neither counted nor changed.
"""

import hashlib
import math
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import HOT_SHARE, as_bytes, saved, text_slices
from tagweave.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 3
FANOUT = 2
# Key rows of all batches per bucket.
BUCKET_ROWS = 1 << 19
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int):
    """Hash of a line's key, or None for one under ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k): every distinct key of every row of documents."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                owners, found = [], []
                for owner, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text"))):
                    own = {line_key(line, min_chars) for line in (text or b"").split(b"\n")} - {None}
                    owners += [owner] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(found, pa.binary())],
                                                 ["doc_id", "k"])

    plain = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                     F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, k binary")


class LineRuns:
    """The runs of one line index, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets
        self.fanout = fanout
        self.levels = [[]]

    def add(self, keys: DataFrame) -> str:
        """Take in the (doc_id, k) rows of a batch whose ids are below those of earlier batches."""
        self._compact()
        batch = keys.groupBy("k").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        batch = batch.repartition(self.buckets, "k")  # one file per bucket, and the runs stay where they are
        known = F.lit(False)
        for at, run in enumerate(self.runs()):
            batch = batch.join(run.select("k", F.lit(True).alias(f"_in_{at}")).hint("merge"), "k", "left")
            known = known | F.col(f"_in_{at}").isNotNull()
        name = self._write(batch.select("k", "n", F.when(~known, F.col("holder")).alias("holder")))
        self.levels[0].append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self) -> DataFrame:
        """(k, n, holder) over all runs."""
        return self._merge(self.runs()) if self.runs() else self.spark.createDataFrame(
            [], "k binary, n long, holder long")

    def close(self) -> None:
        """Forget the tables' names; their files are scratch files of the shared folder."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = [[]]

    def _merge(self, runs: list) -> DataFrame:
        one, *others = runs
        for other in others:
            other = other.selectExpr("k", "n AS _n", "holder AS _holder")
            one = one.join(other, "k", "full").select(
                "k", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
                F.greatest("holder", "_holder").alias("holder"))
        return one

    def _compact(self) -> None:
        """Make room for one more run."""
        for at, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self._merge([self.spark.table(name) for name in level]))
                for name in level:
                    self.spark.sql(f"DROP TABLE {name}")
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # Hashes do not compress, and every file of a codec would hold buffers outside the heap.
        (df.write.format("parquet").option("path", scratch_path(self.spark, name)).option("compression", "uncompressed")
         .bucketBy(self.buckets, "k").sortBy("k").saveAsTable(name))
        return name


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   batches: int = BATCHES) -> DataFrame:
    """(doc_id, drops): for every document that loses lines, the hashes of the keys it loses."""
    spark = docs.sparkSession
    shares = [1 - i / batches for i in range(1, batches)]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = sorted(set(ids.approxQuantile("doc_id", shares, 0.01))) if shares else []
    number = sum((F.when(F.col("doc_id") < F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch_path(spark, "line-keys")
    keys_of(docs, min_chars).withColumn("batch", number).write.option("compression", "uncompressed").parquet(path)
    keys = spark.read.schema("doc_id long, k binary, batch int").parquet(path)

    runs = LineRuns(spark, max(1, math.ceil(keys.count() / BUCKET_ROWS)))
    for batch in range(len(cuts) + 1):
        runs.add(keys.filter(F.col("batch") == batch).select("doc_id", "k"))
    often = saved(runs.merged().filter(F.col("n") >= min_docs), "repeated-lines")
    runs.close()

    # A key's count says how often it meets the join, so hot keys are known beforehand.
    total = often.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot = F.broadcast(often.filter(is_hot).select("k", "holder"))
    cold = often.filter(~is_hot).select("k", "holder")
    pairs = keys.select("doc_id", "k")
    rest = pairs.join(hot.select("k"), "k", "left_anti").join(cold, "k")
    losses = pairs.join(hot, "k").unionByName(rest).filter("doc_id < holder")
    return losses.groupBy("doc_id").agg(F.collect_set("k").alias("drops"))


def dedup_lines(docs: DataFrame, keep: list = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES) -> DataFrame:
    """Drop repeated lines from every document but the largest that holds them.

    Returns doc_id, n_lines, n_dropped, kept_sha256 and the columns of documents named in
    ``keep``; ``text`` among them is the text of the lines kept.
    """
    drops = repeated_lines(docs, min_chars, min_docs, batches)
    own = [c for c in keep if c not in ("doc_id", "text")]
    with_text = "text" in keep
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)

    def run(batches_):
        for part in (p for batch in batches_ for p in text_slices(batch)):
            texts, lines, lost, digests = [], [], [], []
            for text, gone in zip(as_bytes(part.column("text")), part.column("drops").to_pylist()):
                all_lines = (text or b"").split(b"\n")
                kept = all_lines
                if gone:
                    gone = set(gone)
                    kept = [line for line in all_lines if line_key(line, min_chars) not in gone]
                joined = b"\n".join(kept)
                if with_text:
                    texts.append(joined)
                lines.append(len(all_lines))
                lost.append(len(all_lines) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
            new = [pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[part.column(c) for c in own], *new,
                 pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", *own, *["text"] * with_text, "n_lines", "n_dropped", "kept_sha256"])

    types = "".join(f"`{c}` {plain.schema[c].dataType.simpleString()}, " for c in own) + "text string, " * with_text
    return plain.join(drops, "doc_id", "left").mapInArrow(
        run, f"doc_id long, {types}n_lines long, n_dropped long, kept_sha256 string")
