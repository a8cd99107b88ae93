"""SentencePiece encoding, spelling variants and whitening against plain computations."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tagweave.llm import piece_merge, queries, spelling, whitening


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return piece_merge.Encoder(piece_merge.Model(public_tokenizers.path("piece_bpe_32k.model")))


def digest_row(library, doc_id, text):
    ids = library.encode(text or "")
    return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_equal_the_library(spark, sf, documents, edges, library):
    got = queries.QUERIES["op11_sentencepiece"](spark, sf)
    assert got.filter("NOT agrees OR agrees IS NULL").isEmpty()
    want = [digest_row(library, r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    got = piece_merge.digests(edges)
    want = [digest_row(library, r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_pieces_of_hard_texts(library, encoder):
    random.seed(5)
    letters = "ab the▁  \n\t\0é日本語🙂́<s>0x41 ing" + "​"
    texts = ["", " ", "  a", "▁x ▁", "</s><0x41>", "x" * 3000, "日本語" * 500, "a\n\nb\r\n", "é" * 70, " " * 100]
    texts += ["".join(random.choices(letters, k=random.randrange(1, 200))) for _ in range(500)]
    assert encoder.texts(texts) == library.encode(texts)
    for text in texts:
        assert encoder.texts([text])[0] == library.encode(text), text


def test_agenda_order(encoder):
    """The agenda takes the best pair of the whole stretch every time, the leftmost of equal ones."""
    random.seed(6)
    cost = encoder.model.cost
    for _ in range(200):
        symbols = list(piece_merge.MARK + "".join(random.choices("abcdeinorst", k=random.randrange(1, 30))))
        word = "".join(symbols)
        while pairs := [(cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in cost]:
            at = min(pairs)[1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        rows = encoder.symbols[[ord(c) for c in word]].reshape(1, -1)
        assert encoder.merged(word) == symbols and encoder.merged_together(rows) == [[encoder.model.ids[s] for s in symbols]]


def test_a_stretch_is_looked_up_once_per_slice(library):
    class Counting(piece_merge.Encoder):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    encoder = Counting(piece_merge.Model(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["one two three " * 500, "", "three  two\none " * 500]
    assert encoder.texts(texts) == library.encode(texts)
    assert encoder.asked < 50


def test_pieces_after_the_store_was_emptied(library, monkeypatch):
    monkeypatch.setattr(piece_merge, "KEPT_WORDS", 5)
    encoder = piece_merge.Encoder(piece_merge.Model(public_tokenizers.path("piece_bpe_32k.model")))
    for texts in (["one two", "three"], ["two four five six seven eight"], ["one", "日 two"]):
        assert encoder.texts(texts) == library.encode(texts)


def test_unknown_characters_side_by_side_are_one_piece(library):
    model = piece_merge.Model(public_tokenizers.path("piece_bpe_32k.model"))
    spelled, model.bytes = set(model.bytes.values()), None
    texts = ["a\u0e01\u0e02 b\u0e03", "\u0e01", "\u0e01\u0e01 c", "", "plain"]
    want = []
    for ids in library.encode(texts):
        ids = [model.unknown if i in spelled else i for i in ids]
        want.append([i for at, i in enumerate(ids) if i != model.unknown or not at or ids[at - 1] != model.unknown])
    assert any(model.unknown in ids for ids in want)
    assert piece_merge.Encoder(model).texts(texts) == want


def test_pieces_of_text_ids_and_nothing(spark, none):
    rows = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, None)], "doc_id string, text string")
    got = piece_merge.encode(rows).collect()
    assert [r["decoded"] for r in got] == ["one two", "one two", ""] and got[0]["ids"] == got[1]["ids"]
    assert piece_merge.digests(none).count() == 0


def slow_words(rows, mangled):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mangled and h % mangled == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for other in by_length[len(w)] + by_length.get(len(w) + 1, []):
            if (len(other) > len(w) or other > w) and one_edit(w, other):
                near[w].append(other)
                near[other].append(w)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return out


def test_variants_equal_brute_force(spark, sf, documents):
    want = slow_variants(slow_words(documents.select("doc_id", "text").collect(), 199))
    got = queries.QUERIES["op12_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) > 100 and set(map(tuple, got)) == want


@pytest.mark.parametrize("block", [3, 2048])
def test_variants_of_crowded_classes(spark, block):
    """Many words of one half, chains of forms, accents and ties; small blocks make many tiles."""
    random.seed(7)
    base = ["abcdef", "abcxyz", "éabcdef", "zzzzzzz"]
    words = {w: random.choice([5, 25, 125, 625]) for w in base}
    for _ in range(250):
        w = random.choice(list(words))
        at = random.randrange(len(w) + 1)
        w = random.choice([w[:at] + random.choice("abéÀx") + w[at:], w[:at] + random.choice("abéÀx") + w[at + 1:], w[:at] + w[at + 1:]])
        if len(w) >= 6:
            words.setdefault(w, random.choice([4, 5, 6, 25, 125, 625]))
    docs = spark.createDataFrame([(1, " ".join([w] * n)) for w, n in words.items()], "doc_id long, text string")
    kept = slow_words(docs.collect(), None)
    got = spelling.variants(docs, mangled=None, block=block).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == slow_variants(kept)
    assert len(got) == len(kept) and max(r["n_near"] for r in got) > 3


def test_variants_of_edge_rows(spark, edges, none):
    want = slow_variants(slow_words(edges.select("doc_id", "text").collect(), 199))
    got = spelling.variants(edges).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert spelling.variants(none).count() == 0


def slow_whitened(vectors, k=8):
    """Exact statistics in integers and fractions, eigenvectors in double precision."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, total = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, total)] for row in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, deviation, centred @ vectors_[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    ids = [i for i, v in rows.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, deviation, white, explained = slow_whitened([rows[i] for i in ids])
    got = {}
    for r in queries.QUERIES["op13_embedding_whitening"](spark, sf).collect():
        got[r["vec_id"], r["component"]] = r
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
    assert set(got) == {(i, c) for i in ids for c in range(1, 9)}
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    for c in range(8):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(sign * mine - white[:, c]).max() < 1e-8
        assert abs(got[ids[0], c + 1]["explained"] / explained[c] - 1) < 1e-9


def test_whitening_of_edge_rows(spark):
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [1e30, 0.0, 0.0]),
           (6, [1.0]), (7, [])]
    good = [(i % 4 if i else None, [float(i), float(i * i % 7), 3.0]) for i in range(20)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(*r, 0) for r in bad + good], schema).withColumn("x", F.lit("extra")).withColumn("w", F.lit(1))
    got = whitening.whitened(df.repartition(7)).collect()
    n, deviation, white, _ = slow_whitened([v for _, v in good], 2)
    assert n == 20 and len(got) == 40 and {r["component"] for r in got} == {1, 2}  # the third entry never varies
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation)
    assert sorted(round(abs(r["whitened"]), 8) for r in got if r["component"] == 1) == sorted(round(abs(w), 8) for w in white[:, 0])
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, [], 0)]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0


def test_whitening_of_many_tasks_and_large_entries(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(200, 6)) * [1e8, 1e6, 1e3, 1, 1, 0.1]).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(40)
    got = whitening.whitened(df, 3).collect()
    n, deviation, white, explained = slow_whitened(vectors, 3)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(deviation))
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    assert max(abs(abs(first[i]) - abs(white[i, 0])) for i in first) < 1e-7


@pytest.mark.parametrize("case", ["random", "repeated", "graded", "split", "short"])
def test_bidiagonal_solver(case):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 24))
    if case == "repeated":
        a = np.vstack([np.eye(24), -np.eye(24)])
    if case == "graded":
        a = a * np.logspace(0, -12, 24)
    if case == "split":
        a[:, 12:] = 0
    if case == "short":
        a = a[:5]
    r = np.zeros((24, 24))
    reduced = np.linalg.qr(a, mode="r")
    r[:len(reduced)] = reduced
    values, v = whitening.components(r, 24)
    true = np.linalg.svd(r, compute_uv=False) ** 2
    assert len(values) == {"split": 12, "short": 5}.get(case, 24)
    assert np.abs(values / true[:len(values)] - 1).max() < 1e-11
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * values).max() < 1e-12 * values[0]
