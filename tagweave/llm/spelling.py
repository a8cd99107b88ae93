"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Words of a corpus are counted, and each points to its most frequent near word if that is
frequent enough; following the pointers gives the root of a group of variants.

Two words are one edit apart exactly if their common prefix and common suffix together reach
the longer length minus one. The shorter of such a pair, of length m, shares then its first
or its last half (rounded up from (m - 1) / 2) with the other one. So words are laid in
classes of one half and length m or m + 1; a class is a dense matrix of code points, padded
on the right for prefixes and on the left for suffixes, and is compared block against block.
A pair belongs to the class of its common first half if it has one, so it is found once.

A class larger than a block is cut into blocks by a hash, and each pair of blocks is a tile
of its own, so no task holds a class whole. A tile returns one row per word, with its number
of near words and the best of them; pairs are never written.

Defined cases: null texts hold no words, and a null doc_id is an empty id. Rows that share a
doc_id are read one by one. Words are compared by code points; order is code-point order.
"""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import SLICE_BYTES, attach, saved, text_slices

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
# Of the hashes of a document's words, one in so many drops a code point of its word.
MANGLED = 199
MIN_LENGTH = 6
MIN_COUNT = 5
# A form has at least so many times the occurrences of a word that points to it.
FACTOR = 5
BLOCK = 2048
STRIP = 128
KEPT_WORDS = 200_000


def observed(doc_id: str | None, text: str, mangled: int | None = MANGLED):
    """(word, occurrences) of a text: its runs of letters, some of them with a code point less."""
    lowered = text.encode().lower().decode()  # bytes.lower() changes A-Z only
    found = RUNS.findall(lowered) if len(lowered) < SLICE_BYTES else (m[0] for m in RUNS.finditer(lowered))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(found).items():
        if mangled:
            code = crc32(run.encode(), start)
            if code % mangled == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1:]
        yield run, n


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                mangled: int | None = MANGLED) -> DataFrame:
    """(word, n) of all words with ``min_length`` code points and ``min_count`` occurrences."""
    def run(batches):
        counts = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for part in text_slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in observed(doc_id, text or "", mangled):
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) >= KEPT_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def padded(words: list, width: int, right: bool) -> np.ndarray:
    """Code points of words, one row each, with zeros after (or before) a shorter word."""
    fit = [w.ljust(width, "\0") if right else w.rjust(width, "\0") for w in words]
    return np.frombuffer("".join(fit).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width)


def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal columns from the first one on, for every row of a against every row of b."""
    open_ = np.ones((len(a), len(b)), dtype=bool)
    total = np.zeros((len(a), len(b)), dtype=np.int16)
    for column in range(a.shape[1]):
        open_ &= a[:, column, None] == b[None, :, column]
        total += open_
        if not open_.any():
            break
    return total


def near_pairs(first: list, second: list, half: int, suffixes: bool):
    """Places (i, j) of words one edit apart, or equal; words of ``second`` are as long as those
    of ``first`` or one longer. Among words of a common suffix, those that also share the first
    half are left to the class of that half."""
    longer = len(second[0])
    heads, tails = padded(second, longer, True), padded(second, longer, False)
    for at in range(0, len(first), STRIP):
        some = first[at:at + STRIP]
        head = reach(padded(some, longer, True), heads)
        tail = reach(padded(some, longer, False)[:, ::-1], tails[:, ::-1])
        near = head + tail >= longer - 1
        if suffixes:
            near &= head < half
        i, j = np.nonzero(near)
        yield i + at, j


def compared(words: list, counts: list, blocks: list, low: int, high: int, length: int, suffixes: bool):
    """(word, near words, best near word, its count) of the words of a tile."""
    half = length // 2  # (length - 1) / 2, rounded up
    order = sorted(range(len(words)), key=lambda w: (-counts[w], words[w]))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    n_near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words), dtype=np.int64)

    def of(block, size):
        return [w for w in range(len(words)) if blocks[w] == block and len(words[w]) == size]

    sides = [(of(low, length), of(high, length)), (of(low, length), of(high, length + 1))]
    if low < high:
        sides.append((of(high, length), of(low, length + 1)))
    for first, second in sides:
        if not first or not second:
            continue
        a, b = np.array(first), np.array(second)
        for i, j in near_pairs([words[w] for w in first], [words[w] for w in second], half, suffixes):
            i, j = a[i], b[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            np.add.at(n_near, i, 1)
            np.add.at(n_near, j, 1)
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
    for w in np.nonzero(n_near)[0]:
        chosen = order[best[w]]
        yield words[w], int(n_near[w]), words[chosen], counts[chosen]


def tiles(words: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """(key, low, high, length, suffixes, word, n, block): every word in each tile it is compared in."""
    size = F.length("word")
    roles = F.filter(F.array(size, size - 1), lambda m: m >= min_length)
    members = (words.withColumn("length", F.explode(roles))
               .withColumn("suffixes", F.explode(F.array(F.lit(False), F.lit(True))))
               .withColumn("half", F.expr("length div 2"))
               .withColumn("gram", F.when(F.col("suffixes"), F.expr("right(word, half)")).otherwise(F.expr("left(word, half)")))
               .withColumn("key", F.concat_ws(":", "length", F.col("suffixes").cast("int"), "gram"))
               .select("key", "length", "suffixes", "word", "n"))
    members = saved(members, "members")
    sizes = saved(members.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "classes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    known = attach(members, sizes.withColumn("members", F.col("rows")), "key", "rows", total).filter("members IS NOT NULL")
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    placed = known.withColumn("blocks", blocks).withColumn("block", F.expr("CAST(pmod(xxhash64(word), blocks) AS INT)"))
    met = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      "length", "suffixes", "word", "n", "block")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near, near_n): the number of near words and the most frequent of them."""
    names = ["word", "n_near", "near", "near_n"]

    def run(batches):
        held, key = [], None

        def out():
            if len(held) < 2:
                return []
            _, low, high, length, suffixes = key
            return list(compared([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], low, high, length, suffixes))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

        ready = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "length", "suffixes", "word", "n", "block")]
            for *tile, word, n, place in zip(*columns):
                if tile != key:
                    ready += out()
                    held, key = [], tile
                held.append((word, n, place))
            if len(ready) > 10_000:
                yield batch_of(ready)
                ready = []
        ready += out()
        if ready:
            yield batch_of(ready)

    laid = tiles(words, min_length, block)
    tile = ["key", "low", "high"]
    found = (laid.repartition(*tile).sortWithinPartitions(*tile)
             .mapInArrow(run, "word string, n_near long, near string, near_n long"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.w").alias("near"), (-F.col("b.m")).alias("near_n")))


def roots(pointers: DataFrame) -> DataFrame:
    """(word, root) of every pointer (word, up), by doubling: each round follows twice as many steps.

    Counts grow by FACTOR with each step, so paths are short and the rounds few.
    """
    pointers = saved(pointers.select("word", "up"), "pointers")
    while True:
        ends = pointers.groupBy("up").agg(F.count("*").alias("rows"))
        beyond = ends.join(pointers.select(F.col("word").alias("up"), F.col("up").alias("next")), "up")
        beyond = saved(beyond, "beyond")
        if beyond.isEmpty():
            return pointers.select("word", F.col("up").alias("root"))
        total = beyond.agg(F.sum("rows")).first()[0]
        moved = attach(pointers, beyond.select("up", "next", "rows"), "up", "rows", total)
        pointers = saved(moved.select("word", F.coalesce("next", "up").alias("up")), "pointers")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
             mangled: int | None = MANGLED, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = saved(word_counts(docs, min_length, min_count, mangled), "words")
    near = near_words(words, min_length, block)
    points = F.col("near_n") >= F.lit(factor) * F.col("n")
    pointed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(points, F.col("near")).alias("form"), F.when(points, F.col("near_n")).alias("form_n"))
    pointed = saved(pointed, "forms")
    ends = roots(pointed.filter("form IS NOT NULL").select("word", F.col("form").alias("up")))
    return pointed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
