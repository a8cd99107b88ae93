"""SentencePiece encoding of merge-type vocabularies with a score-ordered agenda.

A text is a chain of symbols, at first its characters. Every adjacent pair that spells a
piece stands on an agenda; the pair of highest score, leftmost of equal ones, is taken,
becomes one symbol, and brings up to two new pairs. What is left is looked up; a symbol that
is no piece is written as its UTF-8 bytes, or as the unknown piece where the model has no
byte pieces.

A merge never reaches over two characters that stand side by side in no piece, so a text is
cut there and each stretch is merged on its own. The cuts of a slice of texts are found in
the array of its characters, and its distinct stretches by Arrow's dictionary. Distinct
stretches are merged once per task, in a store of bounded size: those of one length side by
side, with a row of an agenda matrix each, from which every step takes the best pair of every
row; long ones and those with strange characters by themselves, with a heap as agenda, in
which entries whose symbols have changed since are passed over. The ids of all stretches of
the store stand in one array, from which those of the slice are taken at once. Every row is
checked in its Arrow batch against the sentencepiece library, which also decodes.

Defined cases: null and empty texts have no ids and decode to an empty text. Control,
unknown and byte pieces are never matched in a text. Every row of documents is encoded by
itself; ids of documents keep their type. A stretch of one character repeated n times is
one chain of n symbols.
"""

import heapq
import struct
import sys
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import text_slices

MARK = "▁"
KEPT_WORDS = 400_000
KEPT_IDS = 4_000_000
KEPT_LENGTH = 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2
# No symbol, no rank, and more than any number of pieces.
GONE, NO_RANK, SPAN = -1, 1 << 40, 1 << 31
# Stretches merged side by side.
ROWS = 8192


def fields(data: bytes):
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


class Model:
    """Pieces, scores and rules of a model file whose rules this module follows."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        pieces = [dict(fields(v)) for k, v in message if k == 1]
        trainer = dict(f for k, v in message if k == 2 for f in fields(v))
        normal = dict(f for k, v in message if k == 3 for f in fields(v))
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p[1].decode() for p in pieces]
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("the model's vocabulary is not of the merge type")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("models that map characters or trim white space are not supported")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = MARK if normal.get(3, 1) else ""
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        self.cost = {name: -struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for name, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(names[i][3:5], 16): i for i, kind in enumerate(kinds) if kind == BYTE} if trainer.get(35) else None


class Encoder(dict):
    """Number per stretch of text; ``bounds`` tells where its ids stand in ``held``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.symbols = np.full(sys.maxunicode + 1, GONE, dtype=np.int32)
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        characters = sorted(set(chain.from_iterable(model.ids)))
        self.places = np.zeros(sys.maxunicode + 1, dtype=np.int32)  # 0: in no piece
        self.places[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.joints = np.zeros((len(characters) + 1, len(characters) + 1), dtype=bool)
        sides = np.array([(ord(a), ord(b)) for piece in model.ids for a, b in zip(piece, piece[1:])], dtype=np.int64).reshape(-1, 2)
        self.joints[self.places[sides[:, 0]], self.places[sides[:, 1]]] = True
        rank = {cost: at for at, cost in enumerate(sorted(set(model.cost.values())))}
        made = sorted((left * SPAN + right, rank[model.cost[piece]], i) for piece, i in model.ids.items()
                      for at in range(1, len(piece))
                      if (left := model.ids.get(piece[:at])) is not None and (right := model.ids.get(piece[at:])) is not None)
        self.pairs, self.ranks, self.made = (np.array(c, dtype=np.int64) for c in zip(*[(-1, 0, 0), *made]))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.held, self.bounds = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, words: list) -> None:
        """Merge those of distinct stretches that are not in the store."""
        fresh = list(filterfalse(self.__contains__, words))
        if len(self) + len(fresh) > KEPT_WORDS or len(self.held) > KEPT_IDS:
            self.clear()
            fresh = words
        by_length = {}
        for word in fresh:
            by_length.setdefault(min(len(word), KEPT_LENGTH + 1), []).append(word)
        found = []
        for length, some in by_length.items():
            if length > KEPT_LENGTH:
                found += [self.named(self.merged(word)) for word in some]
                continue
            codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)
            symbols = self.symbols[codes]
            plain = (symbols != GONE).all(axis=1)
            for at in range(0, len(some), ROWS):
                part = plain[at:at + ROWS]
                together = iter(self.merged_together(symbols[at:at + ROWS][part]))
                found += [next(together) if fine else self.named(self.merged(word))
                          for word, fine in zip(some[at:at + ROWS], part)]
        self.update(zip(chain.from_iterable(by_length.values()), range(len(self), len(self) + len(fresh))))
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found))) + len(self.held)
        self.held = np.append(self.held, np.fromiter(chain.from_iterable(found), dtype=np.int32))
        self.bounds = np.append(self.bounds, ends)

    def look_up(self, left: np.ndarray, right: np.ndarray):
        """Rank and piece of pairs of symbols."""
        keys = left.astype(np.int64) * SPAN + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def merged_together(self, start: np.ndarray) -> list:
        """Ids of stretches of one length, given as rows of pieces of one character each.

        ``agenda[r, i]`` ranks the pair of symbol i of row r and the symbol after it. The last
        column stands before the first symbol and after the last one; no pair has a rank there.
        """
        rows, length = start.shape
        symbols = np.full((rows, length + 1), GONE, dtype=np.int32)
        symbols[:, :length] = start
        after = np.tile(np.arange(1, length + 2), (rows, 1))
        before = np.tile(np.arange(-1, length), (rows, 1))
        before[:, 0] = length
        agenda = np.full((rows, length + 1), NO_RANK)
        made = np.zeros((rows, length + 1), dtype=np.int64)
        agenda[:, :length], made[:, :length] = self.look_up(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(rows)
        while len(live):
            left = agenda[live].argmin(axis=1)
            going = agenda[live, left] < NO_RANK
            live, left = live[going], left[going]
            right = after[live, left]
            symbols[live, left] = made[live, left]
            symbols[live, right] = GONE
            agenda[live, right] = NO_RANK
            after[live, left] = follower = after[live, right]
            before[live, follower] = left
            agenda[live, left], made[live, left] = self.look_up(symbols[live, left], symbols[live, follower])
            leader = before[live, left]
            agenda[live, leader], made[live, leader] = self.look_up(symbols[live, leader], symbols[live, left])
        kept = symbols != GONE
        ids, ends = symbols[kept].tolist(), kept.sum(axis=1).cumsum().tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merged(self, word: str) -> list:
        cost, symbols, last = self.model.cost, list(word), len(word)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        agenda = []
        for left in range(last - 1):
            pair = word[left:left + 2]
            if pair in cost:
                agenda.append((cost[pair], left, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, length = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right == last or len(symbols[left]) + len(symbols[right]) != length:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = follower = after[right]
            if follower < last:
                before[follower] = left
                pair = symbols[left] + symbols[follower]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], left, len(pair)))
            if (leader := before[left]) >= 0:
                pair = symbols[leader] + symbols[left]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], leader, len(pair)))
        return list(filter(None, symbols))

    def named(self, symbols: list) -> list:
        """Ids of symbols."""
        ids = []
        for symbol in symbols:
            known = self.model.ids.get(symbol)
            if known is not None:
                ids.append(known)
            elif self.model.bytes is not None:
                ids += [self.model.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.model.unknown)
        return ids

    def cut(self, texts: list):
        """Distinct stretches of all texts together, the one at every place, and every text's first place."""
        marked = [self.model.prefix + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        first = np.cumsum([0, *map(len, marked)])
        places = self.places[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
        starts = np.ones(len(whole) + 1, dtype=bool)
        starts[1:-1] = ~self.joints[places[:-1], places[1:]]
        starts[first] = True
        starts = np.flatnonzero(starts)
        data = whole.encode()
        at = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80), len(data))[starts]
        stretches = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        return stretches.dictionary.to_pylist(), stretches.indices.to_numpy(), np.searchsorted(starts, first)

    def flat(self, texts: list):
        """Ids of all texts, one after the other, and where each text's begin and the last one's end."""
        words, stretches, first = self.cut(texts)
        self.learn(words)
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))[stretches]
        sizes = self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.held[np.arange(ends[-1]) + np.repeat(self.bounds[numbers] - ends[:-1], sizes)]
        bounds = ends[first]
        if self.model.bytes is None:  # unknown characters side by side are one unknown piece
            kept = np.ones(len(ids) + 1, dtype=bool)
            kept[1:-1] = (ids[1:] != self.model.unknown) | (ids[:-1] != self.model.unknown)
            kept[bounds] = True
            ids, bounds = ids[kept[:-1]], (np.cumsum(kept) - 1)[bounds]
        return ids, bounds

    def texts(self, texts: list) -> list:
        """Ids of every text."""
        return as_lists(*self.flat(texts))


def as_lists(ids: np.ndarray, bounds: np.ndarray) -> list:
    """The parts of an array between bounds."""
    ids, bounds = ids.tolist(), bounds.tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def encode(docs: DataFrame, model_path: str = None) -> DataFrame:
    """(doc_id, ids, decoded, agrees) of every row of documents.

    ``decoded`` is the library's reading of ``ids``; ``agrees`` tells that the library
    encodes the text to the same ids.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        import sentencepiece

        encoder = Encoder(Model(model_path))
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, bounds = encoder.flat(texts)
                lists = as_lists(ids, bounds)
                checked = library.encode(texts, num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array(library.decode(lists, num_threads=1), pa.string()),
                     pa.array([a == b for a, b in zip(lists, checked)], pa.bool_())],
                    ["doc_id", "ids", "decoded", "agrees"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def digests(docs: DataFrame, model_path: str = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees): what fixes an encoding."""
    return encode(docs, model_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
