"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is in a document when the document holds at least ``threshold`` of the item's
distinct word shingles. Items are short and documents long, so Jaccard similarity is useless
at a fixed sketch length: in a partition of items with up to n shingles a document of m
shingles needs a sketch of about m/n minima. Items are therefore partitioned by size into
powers of two. An item of n shingles is indexed by its bottom sketch, the s smallest of its
shingle hashes, where s = n - ceil(threshold * n) + 1; a document that misses fewer than s
shingles shares one of them, so the search loses nothing. The largest hash of a partition's
sketches bounds the hashes that documents are searched with in that partition, a MinHash
sketch that grows with the document. Candidates are verified by exact containment over the
words themselves.

The benchmark is the query set. It is taken in blocks of about ``BLOCK_BYTES`` of text, the
documents are read where they lie, and nothing of theirs is shuffled.

Defined cases: words are runs of letters and digits of the lower-cased text. The words of an
item under five are its one shingle, and documents are searched for it at that size; an item
without a word is never found. Items that share an id are searched each under that id; null
texts are empty. Items without an id are not searched.
"""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import as_bytes, text_slices

WORDS = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"[^\W_]+")
MATCHES = "array<struct<item_id:long,n_shingles:long,n_shared:long,containment:double>>"


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly, so that their order is a random order (MinHash)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return mixed(total)


def misses_allowed(n: int, threshold: float) -> int:
    """Shingles of n that a containing document may lack; exact at decimal thresholds."""
    return n - -(-n * round(threshold * 10_000) // 10_000)


def indexes(items: list, size: int = WORDS, threshold: float = THRESHOLD) -> list:
    """An index of the items with ``size`` words and more, and one for each smaller number of words."""
    by_size = defaultdict(list)
    for item_id, text in items:
        words = WORD.findall((text or "").lower())
        if words:
            by_size[min(size, len(words))].append((item_id, words))
    return [ItemIndex(some, own, threshold) for own, some in sorted(by_size.items())]


def matches(found: list, text: str | None) -> list:
    """The items of all indexes that a text contains, verified."""
    words = WORD.findall((text or "").lower())
    return sorted((m for index in found for m in index.matches(words)), key=lambda m: m["item_id"])


class ItemIndex:
    """The sketches and shingles of a block of items, small enough for every task."""

    def __init__(self, items: list, size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.ids, self.shingles, self.vocabulary = [], [], {}
        partitions = defaultdict(list)
        for item_id, words in items:
            grams = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
            for word in words:
                # Never zero: zero stands for a word that no item holds.
                self.vocabulary.setdefault(word, xxhash.xxh64_intdigest(word.encode()) | 1)
            partitions[len(grams).bit_length()].append(len(self.ids))
            self.ids.append(item_id)
            self.shingles.append(grams)
        self.partitions = []
        for members in partitions.values():
            owners, hashes = [], []
            for item in members:
                rows = np.array([[self.vocabulary[w] for w in g] for g in self.shingles[item]], dtype=np.uint64)
                values = np.sort(np.concatenate([shingle_hashes(r, size) for r in rows]))
                keep = values[:misses_allowed(len(values), threshold) + 1]
                hashes.append(keep)
                owners.append(np.full(len(keep), item))
            hashes, owners = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((hashes[order], owners[order], hashes.max()))

    def candidates(self, hashes: np.ndarray) -> set:
        """Items whose sketch shares a hash with a document's shingles."""
        found = set()
        for sketch, owners, bound in self.partitions:
            own = hashes[hashes <= bound]
            at = np.searchsorted(sketch, own)
            hit = own[sketch[np.minimum(at, len(sketch) - 1)] == own]
            for value in np.unique(hit):
                found.update(owners[np.searchsorted(sketch, value):np.searchsorted(sketch, value, "right")].tolist())
        return found

    def matches(self, words: list) -> list:
        """The items that a text of these words contains, verified."""
        known = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), dtype=np.uint64, count=len(words))
        hashes = shingle_hashes(known, self.size)
        if not len(hashes):
            return []
        # Only runs of words that items hold can be a shingle of an item.
        runs = np.lib.stride_tricks.sliding_window_view(known != 0, self.size).all(axis=1)
        starts = np.flatnonzero(runs)
        found = self.candidates(hashes[starts])
        if not found:
            return []
        own = {tuple(words[i:i + self.size]) for i in starts.tolist()}
        result = []
        for item in sorted(found, key=lambda i: (self.ids[i], i)):
            n, shared = len(self.shingles[item]), len(self.shingles[item] & own)
            if n - shared <= misses_allowed(n, self.threshold):
                result.append({"item_id": self.ids[item], "n_shingles": n, "n_shared": shared, "containment": shared / n})
        return result


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The query set in blocks of about ``block_bytes`` of text."""
    plain = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = plain.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else plain
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def screen(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD,
           keep: list = ()) -> DataFrame:
    """doc_id, the columns named in ``keep`` and ``matches``: the items that each document holds."""
    own = [c for c in keep if c not in ("doc_id", "matches")]
    with_text = "text" in own
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        *[c for c in own if c != "text"])
    plain = plain.withColumn("matches", F.array().cast(MATCHES))
    for block in item_blocks(items):
        state = docs.sparkSession.sparkContext.broadcast([vars(index) for index in indexes(block, size, threshold)])

        def run(batches, state=state):
            found_in = []
            for known in state.value:
                found_in.append(ItemIndex.__new__(ItemIndex))
                vars(found_in[-1]).update(known)
            for batch in batches:
                for part in text_slices(batch):
                    before = part.column("matches")
                    found = [matches(found_in, t) for t in part.column("text").to_pylist()]
                    if pc.any(pc.greater(pc.list_value_length(before), 0)).as_py():
                        found = [old + new for old, new in zip(before.to_pylist(), found)]
                    at = part.schema.get_field_index("matches")
                    yield part.set_column(at, "matches", pa.array(found, before.type))

        plain = plain.mapInArrow(run, plain.schema)
    return plain if with_text else plain.drop("text")


def contaminated(docs: DataFrame, items: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    return screen(docs, items, size, threshold).select("doc_id", F.inline("matches"))
