"""Language mixtures, quality rules and token counts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import models

from tagweave.llm import language, quality, token_count


def slow_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def test_language_of_held_out_documents(documents):
    truth = {r["doc_id"]: r for r in documents.collect()}
    got = language.identified(documents).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) >= 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and abs(sum(s["share"] for s in r["languages"]) - 1) < 1e-6


def test_language_model_equals_brute_force(documents):
    """Word likelihoods, the one-language case and the mixture of two against plain loops."""
    rows = [r for r in documents.collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = language.learned(documents)
    assert model.languages == sorted({r["lang"] for r in rows})
    table = np.zeros((language.BUCKETS, len(model.languages)))
    for r in rows:
        for word in slow_words(r["text"]):
            for gram in language.trigrams([word])[0]:
                table[gram, model.languages.index(r["lang"])] += 1
    assert np.allclose(model.logs, language.smoothed(table))

    def logs(word):
        return sum(model.logs[g] for g in language.trigrams([word])[0])

    def value(words, shares):
        return sum(np.log(sum(s * np.exp(x) for s, x in zip(shares, logs(w)))) for w in words)

    by_lang = {lang: " ".join(r["text"] for r in rows if r["lang"] == lang)[:1500] for lang in model.languages}
    a, b = model.languages[:2]
    both = by_lang[a] + " " + by_lang[b]
    (best, share, parts), (alone, one, single) = model.infer([both, by_lang[a]])
    assert {n for n, _ in parts} == {a, b} and best in (a, b) and 0.4 < share < 0.75
    assert (alone, one, single) == (a, 1.0, [(a, 1.0)])
    shares = np.array([dict(parts).get(n, 0.0) for n in model.languages])
    words = slow_words(both)
    single = max(value(words, np.eye(len(model.languages))[i]) for i in range(len(model.languages)))
    assert value(words, shares) - single > language.PENALTY * np.log(len(words) + 1)
    grid = max(value(words, [p * (n == a) + (1 - p) * (n == b) for n in model.languages]) for p in np.linspace(0.01, 0.99, 99))
    assert value(words, shares) >= grid - 0.5


def test_language_edges(edges, none):
    got = language.identified(edges, keep=["text", "n_chars"]).collect()
    assert len(got) == edges.count()
    for r in got:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"], r["languages"]) == ("und", 0.0, [])
        else:
            assert r["lang_pred"] in ("de", "en", "es", "fr")
        if r["doc_id"] is None:
            assert r["held_out"] is False
    assert language.identified(none).collect() == []
    unknown = language.identified(edges.withColumn("lang", edges["lang"].substr(9, 1)).drop("lang")
                                  .selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, documents, edges, sf):
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = sorted(((r["doc_id"], *slow_base(r["text"])) for r in whole.collect()), key=repr)
    got = quality.judged(whole, labels).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality.KEEP_PROBABILITY)


def test_quality_of_unseen_labels(spark):
    """Trained without a third of the labels, it finds them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 3 <> 0")
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    got = [r for r in quality.judged(docs, seen).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good = [r["kept"] for r in got if truth[r["doc_id"]] == 1]
    bad = [r["kept"] for r in got if truth[r["doc_id"]] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_hashed_features_equal_loops():
    texts = [b"", b"ab", b"  one two\tone two  one", "äöü ß one".encode(), b"x", b" ", b"abcdefgh one two"]
    blocks = quality.hashed_features(texts)
    alone = [quality.hashed_features([t]) for t in texts]
    for block in range(quality.BLOCKS):
        owner, feature = blocks[block]
        assert [sorted(feature[owner == i].tolist()) for i in range(len(texts))] == [sorted(a[block][1].tolist()) for a in alone]
    words = [len(t.split()) for t in texts]
    assert [len(a[0][1]) for a in alone] == words
    assert [len(a[1][1]) for a in alone] == [max(0, n - 1) for n in words]
    assert [len(a[2][1]) for a in alone] == [max(0, len(t) - 3) for t in texts]
    # Equal words have equal features wherever they stand, different words do not.
    one = quality.hashed_features([b"one"])[0][1][0]
    assert Counter(alone[2][0][1].tolist())[one] == 3 and len(set(alone[2][0][1].tolist())) == 2
    weights = np.random.default_rng(1).normal(size=quality.BLOCKS * quality.BLOCK)
    got = quality.margins(texts, weights)
    for text, margin in zip(texts, got):
        places, values = quality.sparse(text)
        assert abs((weights[places] * values).sum() - margin) < 1e-9


def test_quality_without_labels(spark, edges, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(10, 1, 0), (11, 1, 0), (None, 0, 0), (9, None, 0)], empty.schema)
    for labels in (empty, one_kind):
        got = quality.judged(edges, labels).collect()
        assert len(got) == edges.count() and all(r["kept"] == (not r["base_failed"]) and r["probability"] is None for r in got)
    assert quality.judged(none, empty).collect() == []


def test_platt_recovers_the_curve():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=4000) * 3 + 1
    label = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * margin - 0.5)))).astype(float)
    slope, offset = quality.platt(margin, label)
    assert abs(slope - 0.7) < 0.1 and abs(offset + 0.5) < 0.15


def unigram():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return path, models.Unigram(pieces, 0, True)


def test_token_counts_equal_the_library(documents, edges):
    path, library = unigram()
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text"))

    def slow(text):
        return len(library.tokenize("▁" + text.replace(" ", "▁"))) if text else 0

    want = sorted(((r["doc_id"], len(r["text"] or ""), slow(r["text"])) for r in whole.collect()), key=repr)
    assert sorted(map(tuple, token_counts_of(whole)), key=repr) == want

    counts = token_count.WordCounts(*token_count.vocabulary(path))
    random.seed(4)
    alphabet = "the and ing 日本 é\n  \t▁x🙂ß-=012 ñ̀"
    for _ in range(2000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(1, 50)))
        assert counts.text(text) == slow(text), text


def token_counts_of(docs):
    return token_count.token_counts(docs).collect()


def test_token_ties_and_spanning_pieces():
    """Equal scores keep the piece that starts first; a piece that spans words is not cut."""
    pieces = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "c": -3.0, "bc": -4.0, "▁b▁c": -1.0}
    library = models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False)
    counts = token_count.WordCounts(pieces, -4.0)
    for text in ("ab", "abc", "a", "b c", "ab abc", "a b c ab"):
        assert counts.text(text) == len(library.tokenize("▁" + text.replace(" ", "▁"))), text


def test_token_store_is_bounded(monkeypatch):
    path, _ = unigram()
    whole = token_count.WordCounts(*token_count.vocabulary(path))
    text = " ".join(f"word{i}" for i in range(300)) + " " + "y" * 500
    want = whole.text(text)
    monkeypatch.setattr(token_count, "KEPT_WORDS", 10)
    small = token_count.WordCounts(*token_count.vocabulary(path))
    assert small.text(text) == want and len(small) <= 10


def test_token_counts_with_clashing_columns(edges):
    got = token_counts_of(edges)
    assert len(got) == edges.count() and all(r["n_tokens"] >= (r["n_chars"] > 0) for r in got)


def test_token_counts_of_nothing(none):
    assert token_count.token_counts(none).collect() == []
