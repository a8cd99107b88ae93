"""Best-fit packing of tokenised documents by the linear grouping scheme.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths,
at most ``capacity`` numbers, is packed centrally:

1. Pieces over ``capacity * small`` are large. Sorted by length they are cut into groups of
   equal cardinality, and every length is rounded up to the longest of its group.
2. For these few sizes a linear program over the configurations that fit a sequence
   (columns generated by dual prices) says how often each is used. The whole parts are taken.
3. Real lengths take the places of the rounded ones, which frees the rounding error. The
   pieces left over are grouped again, at their real lengths, until no whole part is left.
4. Small pieces and the last few large ones, longest first, go where they fit best.

All of this works on runs of equal sequences, so its cost depends on the number of lengths
and not on the number of pieces. The outcome is a list of slots (length, rank from, rank to
-> sequence, offset), as short, with which every piece finds its place by its rank among the
pieces of its length. Ranks come from counts per task of the written pieces.

Defined cases: a null text is empty and is one piece that holds the end token alone. Every
row of documents is packed, also when it repeats a doc_id or has none.
"""

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import saved, text_slices

CAPACITY = 1024
END = 2
# Shares of the capacity (a quarter or more) up to which a piece is small, and numbers of
# groups; the first packing with the fewest sequences is taken. Small pieces fill what the
# configurations leave free, so it depends on the lengths how many of them should be small.
# Over a half a configuration has one large piece, as in best-fit decreasing; this comes
# last, so it is taken only where it needs fewer sequences than the others.
SCHEMES = ((0.45, 512), (0.25, 256), (0.5, 1024))


def byte_bpe(json_path: str, ranks_path: str, pattern: str):
    """Text to token ids as an array. The ranks hold the tokenizer's own vocabulary and are
    faster to apply; a text that spells a special token goes to the tokenizer itself."""
    import base64

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def pieces_of(docs: DataFrame, tokenizer_files=None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and where the row was made: task and rank, the
    number of pieces of the same length before it in that task."""
    import public_tokenizers as public

    files = tokenizer_files or (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches):
        encode = byte_bpe(*files)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.array([end], dtype="<u4"))
                    data = ids.astype("<u4").tobytes()
                    cut = len(ids) % capacity or capacity
                    for piece, stop in enumerate(range(cut, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity) if piece else 0
                        length = stop - start
                        rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start:4 * stop]), task, seen[length]))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def grouped(counts: dict, groups: int) -> list:
    """Groups of equal cardinality, longest first: [(rounded length, [(length, count), ...])]."""
    total = sum(counts.values())
    result, done = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            group = min(groups - 1, done * groups // total)
            # A group ends where the next one begins; one length may span several.
            room = -(-(group + 1) * total // groups) - done if group < groups - 1 else left
            take = min(left, max(1, room))
            if not result or result[-1][2] != group:
                result.append((length, [], group))
            result[-1][1].append((length, take))
            done += take
            left -= take
    merged = {}
    for rounded, members, _ in result:  # groups rounded to one length are one size
        merged.setdefault(rounded, []).extend(members)
    return list(merged.items())


def dearest_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int):
    """The configuration of highest total price, as a vector of copies.

    Large pieces are over a quarter of the capacity, so a configuration has three at most:
    all pairs are tried, each with the best third piece for its room.
    """
    best_alone = np.zeros(capacity + 1)
    np.maximum.at(best_alone, sizes, prices)
    best_alone = np.maximum.accumulate(best_alone)
    room = capacity - sizes[:, None] - sizes[None, :]
    pair = np.where(room >= 0, prices[:, None] + prices[None, :] + best_alone[np.maximum(room, 0)], -1.0)
    i, j = np.unravel_index(np.argmax(pair), pair.shape)
    copies = np.zeros(len(sizes))
    if pair[i, j] < 0:  # no two fit
        copies[np.argmax(prices)] = 1
        return copies
    copies[i] += 1
    copies[j] += 1
    third = np.flatnonzero((sizes <= room[i, j]) & (prices == best_alone[room[i, j]]) & (prices > 0))
    if len(third):
        copies[third[0]] += 1
    return copies


def configuration_counts(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list:
    """Fewest sequences in the linear relaxation: [(configuration, uses)], uses may be fractions.

    A simplex that generates its columns, begun with one size per sequence.
    """
    columns = [np.eye(len(sizes))[i] * (capacity // size) for i, size in enumerate(sizes)]
    inverse = np.diag(1.0 / (capacity // sizes))
    level = inverse @ wanted
    for _ in range(4 * len(sizes)):
        prices = np.maximum(inverse.sum(axis=0), 0)
        entering = dearest_configuration(prices, sizes, capacity)
        if entering @ prices <= 1 + 1e-6:
            break
        column = inverse @ entering
        ratio = np.where(column > 1e-9, level / np.where(column > 1e-9, column, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        columns[leave] = entering
        pivot = inverse[leave] / column[leave]
        inverse = inverse - np.outer(column, pivot)
        inverse[leave] = pivot
        level = np.maximum(inverse @ wanted, 0)
    return [(c.astype(int), float(x)) for c, x in zip(columns, level) if x > 1e-9]


class Runs:
    """Runs of equal sequences, found by their free room: [free, copies, contents]."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room = [[] for _ in range(capacity + 1)]

    def add(self, copies: int, contents: tuple) -> None:
        if copies:
            self.by_room[self.capacity - sum(contents)].append((copies, contents))

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces of one length, each where the least room is left."""
        for room in range(length, self.capacity + 1):
            fit = room // length
            while self.by_room[room] and count:
                copies, contents = self.by_room[room].pop()
                full = min(copies, count // fit)
                self.add(full, contents + (length,) * fit)
                count -= full * fit
                if full < copies and count:
                    self.add(1, contents + (length,) * count)
                    count, full = 0, full + 1
                self.add(copies - full, contents)
            if not count:
                return
        fit = self.capacity // length
        self.add(count // fit, (length,) * fit)
        if count % fit:
            self.add(1, (length,) * (count % fit))

    def total(self) -> int:
        return sum(copies for run in self.by_room for copies, _ in run)

    def all(self):
        return [run for runs in self.by_room for run in runs]


def pack_histogram(counts: dict, capacity: int, small: float, groups: int) -> Runs:
    """Pack ``counts`` pieces of every length."""
    runs = Runs(capacity)
    runs.add(counts.get(capacity, 0), (capacity,))
    left = {l: c for l, c in counts.items() if small * capacity < l < capacity and c}
    while left:
        sizes = grouped(left, min(groups, -(-sum(left.values()) // 2)))
        rounded = np.array([s for s, _ in sizes])
        wanted = np.array([sum(c for _, c in members) for _, members in sizes])
        used = []
        for need, uses in configuration_counts(rounded, wanted.astype(float), capacity):
            whole = int(min([uses + 1e-6, *(wanted[i] // need[i] for i in np.flatnonzero(need))]))
            if whole:
                used.append((whole, [i for i in range(len(rounded)) for _ in range(need[i])]))
                wanted = wanted - whole * need
        members = [list(m) for _, m in sizes]
        substitute(runs, used, members)
        left = {}
        for length, count in (part for group in members for part in group):
            left[length] = left.get(length, 0) + count
        if not used:
            break
    rest = dict(left)
    for length, count in counts.items():
        if length <= small * capacity:
            rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        runs.best_fit(length, rest[length])
    return runs


def substitute(runs: Runs, used: list, members: list) -> None:
    """Give every configuration real lengths of its groups, the longest that are left."""
    for copies, groups in used:
        while copies:
            taken, step = [], copies
            for g in set(groups):
                # Places of one group in one sequence take neighbours; a run lasts as long as they do.
                places = groups.count(g)
                length, count = members[g][0]
                if count >= places:
                    step = min(step, count // places)
                    taken.append((g, [(length, places)]))
                else:
                    mixed, missing, at = [], places, 0
                    while missing:
                        length, count = members[g][at]
                        mixed.append((length, min(count, missing)))
                        missing -= mixed[-1][1]
                        at += 1
                    step = 1
                    taken.append((g, mixed))
            contents = []
            for g, parts in taken:
                for length, places in parts:
                    contents += [length] * places
                    first, count = members[g][0]
                    members[g][0] = (first, count - places * step)
                    if not members[g][0][1]:
                        members[g].pop(0)
            runs.add(step, tuple(sorted(contents, reverse=True)))
            copies -= step


def slots_of(counts: dict, capacity: int = CAPACITY) -> dict:
    """For every length its slots in order of rank: arrays (first rank, first sequence, offset, per sequence).

    Rank r of a slot that holds p pieces per sequence lies in sequence first + (r - from) // p,
    at offset + length * ((r - from) % p).
    """
    tries = [pack_histogram(counts, capacity, small, groups) for small, groups in SCHEMES]
    best = min(tries, key=Runs.total)
    slots, reached, sequence = {}, {}, 0
    for copies, contents in sorted(best.all(), key=lambda run: run[1], reverse=True):
        offset, at = 0, 0
        while at < len(contents):
            length, places = contents[at], contents.count(contents[at])
            first = reached.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, offset, places))
            reached[length] = first + copies * places
            offset += length * places
            at += places
        sequence += copies
    return {length: np.array(rows, dtype=np.int64).T for length, rows in slots.items()}


def pack(docs: DataFrame, tokenizer_files=None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = saved(pieces_of(docs, tokenizer_files, capacity, end), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = saved(per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(counts, capacity))

    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros_like(lengths), np.zeros_like(lengths)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                first, start, place, per = slots.value[length]
                slot = np.searchsorted(first, ranks[rows], "right") - 1
                within = ranks[rows] - first[slot]
                sequence[rows] = start[slot] + within // per[slot]
                offset[rows] = place[slot] + length * (within % per[slot])
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)],
                                             [*kept.schema.names, "sequence_id", "offset"])

    # One row per length and task of the first pass: it grows with the input and is not broadcast.
    ranked = pieces.join(per_task.select("length", "task", "before").hint("merge"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")
