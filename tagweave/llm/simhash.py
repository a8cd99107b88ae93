"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint takes the majority of every bit over the hashes of its word shingles.
Two fingerprints link when at most three of 64 bits differ. Cut into two segments of 32
bits, one segment of a linked pair differs in at most one bit. So each fingerprint is
indexed under its segments as they are and under every variant of a segment in which one
bit is a wildcard; an equality join on these keys finds every linked pair, and the distance
is verified in the join. Only distinct fingerprints are indexed, so copies cost nothing.

Defined cases: A-Z are lower-cased and words are runs of other characters than white space.
A text without a word (null and empty too) has fingerprint zero and links like any other.
Rows that share a doc_id are one document: their fingerprints are linked, however far apart,
so all of them have one component. Rows without an id are documents of their own, grouped like
any other row, but they never name a component unless no row of the component has an id.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import as_bytes, attach, saved

MAX_BITS = 3
WORDS = 3
SEED = 42
CHUNK = 1 << 20


def shingle_hashes(data: bytes, size: int = WORDS):
    """Arrays of the XXH64 values of all word shingles, a bounded number at a time."""
    carried, start, short = [], 0, True
    while start < len(data):
        end = start + CHUNK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carried + data[start:end].split()
        start = end
        if len(words) >= size:
            short = False
            shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
        carried = words[-(size - 1):] if size > 1 else []
    if short and carried:  # the whole text is shorter than a shingle
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Majority bits over all shingle hashes; bytes.lower() lower-cases A-Z only."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes((text or b"").lower()):
        for part in range(0, len(hashes), 65536):
            some = hashes[part:part + 65536]
            bits = np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprints(docs: DataFrame, keep: list = ()) -> DataFrame:
    """(doc_id, fp) of every document and the columns named in ``keep``; fp is the fingerprint
    as a signed long."""
    def run(batches):
        for batch in batches:
            values = pa.array([fingerprint(t) for t in as_bytes(batch.column("text"))], pa.int64())
            others = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *others, values], ["doc_id", *keep, "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    own = "".join(f", `{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)
    return plain.mapInArrow(run, f"doc_id long{own}, fp long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at most ``max_bits`` (3 or fewer) apart.

    Slot s * 32 + i is segment s with bit i a wildcard; there, a fingerprint with bit 0
    meets one with bit 1. Slots 64 and 65 are the segments as they are. So a pair is found
    once for each segment that differs in at most one bit.

    The index has 66 rows per fingerprint, which Spark does not see when it sizes a side of the
    join: it takes it for as large as the fingerprints and would broadcast it. So both are sorted.
    """
    if not 0 < max_bits <= 3:
        raise ValueError("two segments find at most three differing bits")
    slots = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("slot"))
    slots = slots.selectExpr(
        "fp", "slot", "if(slot < 64, slot % 32, 0) AS bit",
        "if(if(slot < 64, slot div 32, slot - 64) = 0, fp & 4294967295L, shiftrightunsigned(fp, 32)) AS segment")
    keyed = slots.selectExpr(
        "fp", "slot >= 64 AS same", "shiftright(segment, bit) & 1 AS side",
        "shiftleft(CAST(slot AS BIGINT), 32) | if(slot < 64, segment & ~shiftleft(1L, bit), segment) AS key")
    left = keyed.filter("same OR side = 0").selectExpr("key", "fp AS u", "same")
    right = keyed.filter("same OR side = 1").selectExpr("key AS key_", "fp AS v")
    near = f"key = key_ AND bit_count(u ^ v) BETWEEN 1 AND {max_bits} AND (NOT same OR u < v)"
    return left.join(right.hint("merge"), F.expr(near)).select("u", "v")


def shared_ids(prints: DataFrame) -> DataFrame:
    """Edges (u, v) from the fingerprints of one document to the smallest of them."""
    own = prints.filter("doc_id IS NOT NULL")
    several = own.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("rows"))
    several = saved(several.filter("low < high").drop("high"), "several")
    if several.isEmpty():
        return own.limit(0).selectExpr("fp AS u", "fp AS v")
    total = own.count()
    return attach(own, several, "doc_id", "rows", total).filter("fp <> low").selectExpr("fp AS u", "low AS v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node it reaches.

    Alternating large-star and small-star steps end when each component is a star. Every
    step is an aggregation with partial sums and an equality join, and is written.
    """
    edges = saved(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").filter("u <> v").distinct(), "links")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return edges.selectExpr("u AS node", "v AS root").union(edges.selectExpr("v", "v").distinct())
        state = found
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").selectExpr("v AS u", "m AS v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").selectExpr("v AS u", "m AS v")
        edges = saved(moved.union(lowest.selectExpr("u", "m AS v")).distinct(), "links")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, keep: list = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies, root) of every row of documents, and the
    columns named in ``keep``.

    ``component_id`` is the smallest doc_id reachable over links, ``root`` the component's
    smallest fingerprint; ``copies`` counts the rows with the same fingerprint.
    """
    prints = saved(fingerprints(docs, keep), "fingerprints")
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    edges = links(groups.select("fp"), max_bits).union(shared_ids(prints))
    roots = components(edges).withColumnRenamed("node", "fp")
    linked = roots.join(groups.select("fp", "first"), "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(smallest, "root").select("fp", "component_id", "root")
    dim = groups.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id"), "copies", F.coalesce("root", "fp").alias("root"),
        F.col("copies").alias("_rows"))
    joined = attach(prints, saved(dim, "components"), "fp", "_rows", total)
    return joined.select("doc_id", in_hex("fp").alias("fingerprint"), "component_id", "copies", in_hex("root").alias("root"), *keep)


def in_hex(value: str) -> F.Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
