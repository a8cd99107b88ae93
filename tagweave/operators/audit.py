"""Hash-chained audit log that is appended and verified in parallel.

Entries are chained per key (an asset, say). A chain is cut into segments of a fixed number
of entries, which is part of the log's format. Inside a segment every entry carries the hash
of the one before it; a segment starts from a hash made of its chain and its number, so all
segments of a large chain hash in parallel and none can take another one's place. Whoever
appends stores a seal per segment: how far it goes and its last hash. The seals are kept
apart from the log, and verifying compares both: what was edited, added, moved or removed
shows wherever it stood.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.fixed_values import GENESIS_HASH
from tagweave.functions.scalars import text
from tagweave.operators.sizing import lookup_join, numbered
from tagweave.schemas import AUDIT_COLUMNS
from tagweave.sources.commits import Batch, read_table

SEGMENT_ROWS = 1024


def body_of(seq="seq", ts="ts", actor="actor", action="action", payload="payload"):
    """The canonical text of an entry: a JSON array of its fields."""
    return F.to_json(F.array(*[F.coalesce(text(c), F.lit("")) for c in (seq, ts, actor, action, payload)]))


def entry_hash(prev, body):
    return F.sha2(F.concat(prev, body), 256)


def segment_start():
    return F.sha2(F.concat(F.lit(GENESIS_HASH), F.col("chain"), F.lit("#"), F.col("segment").cast("string")), 256)


def _link(rows: DataFrame, segment_rows: int, last: DataFrame = None) -> DataFrame:
    """rows(chain, seq, body, ...) with segment, prev_hash and hash.

    A group holds at most one segment of one chain. ``last`` (chain, last_seq, last_hash)
    continues a segment that earlier entries left open.
    """
    rows = rows.withColumn("segment", F.floor((F.col("seq") - 1) / segment_rows))
    others = [c for c in rows.columns if c not in ("chain", "segment", "seq", "body")]
    folded = rows.groupBy("chain", "segment").agg(
        F.array_sort(F.collect_list(F.struct("seq", "body", *others))).alias("rows"))
    start = segment_start()
    if last is not None:
        folded = lookup_join(folded, last, "chain")
        open_segment = (F.floor(F.col("last_seq") / segment_rows) == F.col("segment")) & (
            F.col("last_seq") % segment_rows != 0)
        start = F.when(F.coalesce(open_segment, F.lit(False)), F.col("last_hash")).otherwise(start)

    def step(hashes, row):
        return F.concat(hashes, F.array(entry_hash(F.element_at(hashes, -1), row["body"])))

    hashes = F.aggregate("rows", F.array(start), step)
    linked = folded.withColumn("hashes", hashes)
    zipped = F.arrays_zip(F.col("rows").alias("row"),
                          F.slice("hashes", F.lit(1), F.size("rows")).alias("prev_hash"),
                          F.slice("hashes", F.lit(2), F.size("rows")).alias("hash"))
    out = linked.select("chain", "segment", F.inline(zipped).alias("row", "prev_hash", "hash"))
    return out.select("chain", "segment", "row.*", "prev_hash", "hash")


def append(entries: DataFrame, order, segment_rows=SEGMENT_ROWS, last: DataFrame = None) -> DataFrame:
    """entries(chain, ts, actor, action, payload) as audit rows, in order per chain."""
    rows = numbered(entries, order, group=["chain"], start=1, out="seq")
    if last is not None:
        rows = lookup_join(rows, last.select("chain", "last_seq"), "chain").withColumn(
            "seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
    rows = rows.select("chain", "seq", "ts", "actor", "action", "payload").withColumn("body", body_of())
    return _link(rows, segment_rows, last).select(*AUDIT_COLUMNS)


def last_entries(audit: DataFrame) -> DataFrame:
    """Where each chain ends, to continue it."""
    return audit.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"))


def seals(audit: DataFrame) -> DataFrame:
    """Of every segment its first and last entry, its entries and its last hash."""
    return audit.groupBy("chain", "segment").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head"))


def newest_seals(sealed: DataFrame) -> DataFrame:
    """One seal per segment out of those written while it grew."""
    return sealed.groupBy("chain", "segment").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max_by("head", "last_seq").alias("head"))


def write_log(entries: DataFrame, order, path: str, segment_rows=SEGMENT_ROWS, batch_id: int = None, owner="batch") -> None:
    """Append entries to the log at a path, in one commit.

    Entries, the seals of the segments that grew and the new ends of their chains are one
    batch. An append that broke off is not there; one that is repeated under its number
    starts from the ends before it and gives the same rows, and no batch reads the history.
    """
    batch = Batch(entries.sparkSession, path, batch_id, owner)
    written = batch.append("entries", append(entries, order, segment_rows, batch.state(["chain"])))
    batch.append("seals", seals(written))
    batch.change(last_entries(written), ["chain"])
    batch.commit()


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the log at a path."""
    return read_table(spark, path, "entries")


def stored_seals(spark: SparkSession, path: str) -> DataFrame:
    """Its seals, the last one of a segment that grew."""
    return newest_seals(read_table(spark, path, "seals"))


def check_links(audit: DataFrame, segment_rows=SEGMENT_ROWS) -> DataFrame:
    """Each row's own hash, its link to the row before in its segment, and that no row
    between them is missing."""
    inside = Window.partitionBy("chain", "segment").orderBy("seq")
    first = F.col("segment") * segment_rows + 1
    before, place = F.lag("hash").over(inside), F.coalesce(F.lag("seq").over(inside) + 1, first)
    rows = audit.withColumn("_before", F.coalesce(before, segment_start())).withColumn("_place", place)
    return (rows.withColumn("hash_ok", F.col("hash") == entry_hash(F.col("prev_hash"), body_of()))
            .withColumn("link_ok", (F.col("prev_hash") == F.col("_before")) & (F.col("seq") == F.col("_place")))
            .withColumn("broken_at", F.when(~(F.col("hash_ok") & F.col("link_ok")), F.least("_place", "seq")))
            .drop("_before", "_place"))


def verify(audit: DataFrame, sealed: DataFrame, segment_rows=SEGMENT_ROWS) -> DataFrame:
    """Per chain whether it is intact, its entries, and the first broken seq.

    ``sealed`` are the stored seals. Chains that only the seals know were removed.
    """
    checked = check_links(audit, segment_rows).groupBy("chain", "segment").agg(
        F.count("*").alias("entries"), F.min("broken_at").alias("broken"), F.max("seq").alias("_last"),
        F.max_by("hash", "seq").alias("_head"))
    both = checked.join(newest_seals(sealed), ["chain", "segment"], "full")
    first = F.col("segment") * segment_rows + 1
    wrong = (F.when(F.col("_last").isNull() | F.col("last_seq").isNull(), first)
             .when(F.col("_last") < F.col("last_seq"), F.col("_last") + 1)
             .when(F.col("_last") > F.col("last_seq"), F.col("last_seq") + 1)
             .when(F.col("_head") != F.col("head"), first))
    # A row that is wrong in itself says more than the seal of its segment.
    at = F.coalesce("broken", wrong)
    return both.groupBy("chain").agg(F.sum(F.coalesce("entries", F.lit(0))).alias("entries"), F.min(at).alias("broken_at")).select(
        "chain", "entries", F.col("broken_at").isNull().alias("valid"), "broken_at")


def newest_entries(audit: DataFrame, n=30) -> DataFrame:
    """The newest audit entries by time, chain and seq."""
    return audit.orderBy(F.desc("ts"), F.desc("chain"), F.desc("seq")).limit(n)
