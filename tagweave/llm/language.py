"""Language identification as inference of a mixture.

Character trigrams, with word boundaries, are counted per language on labelled rows. A word
of a text has a likelihood under every language, the product over its trigrams, and the text
is a mixture: expectation-maximisation estimates the share of its words that each language
wrote. The set of languages starts with the single best one. The language that raises the
likelihood fastest is added, shares are estimated anew, and it stays if the log-likelihood
gains more than ``PENALTY * log(words)``.

Rows learned from are those with a language whose crc32(doc_id as text) mod 4 is not 2, a
bounded sample of about ``TRAIN_ROWS`` per language chosen by a hash of the id. Counts are
hashed to ``BUCKETS`` trigrams, so the model's size is bounded by the number of languages.

Defined cases: words are runs of letters of the lower-cased text. A text without a letter
(null and empty too) is ``und`` with score 0; without anything to learn from every text is.
Of equally likely languages the first by name wins. Rows without a doc_id are predicted but
neither held out nor learned from. Every row of documents is judged by itself.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import text_slices

UNKNOWN = "und"
BUCKETS = 1 << 16
TRAIN_ROWS = 4000
PRIOR = 1000.0
PENALTY = 3.0
STEPS = 12
# Inference takes some 60 bytes per byte of text.
SLICE = 1 << 20
SHARES = "array<struct<lang:string,share:double>>"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list:
    return WORD.findall(text.lower()) if text else []


def trigrams(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, one per character with its neighbours, and where words start."""
    joined = "\n" + "\n".join(words) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    inside = chars[1:-1] != 10
    key = (chars[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
           ^ chars[2:] * np.uint64(0x165667B19E3779F9))
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return (key[inside] >> np.uint64(48)).astype(np.int64), np.cumsum(lengths) - lengths


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class Model:
    """Log-probabilities of hashed trigrams: one row per bucket, one column per language."""

    def __init__(self, languages: list, logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def word_logs(self, words) -> np.ndarray:
        grams, starts = trigrams(words)
        return np.add.reduceat(self.logs[grams], starts, axis=0)

    def infer(self, texts: list) -> list:
        """[(language, share, [(language, share), ...])] of every text."""
        found = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        result = [(UNKNOWN, 0.0, [])] * len(texts)
        if not sizes.sum() or not self.languages:
            return result
        codes, unique = pd.factorize(np.array([w for own in found for w in own], dtype=object))
        owner = np.repeat(np.arange(len(texts)), sizes)
        letters = np.fromiter(map(has_letter, unique), dtype=bool, count=len(unique))
        if not letters.all():
            owner, codes = owner[letters[codes]], codes[letters[codes]]
        docs, owner, counts = np.unique(owner, return_inverse=True, return_counts=True)
        if not len(docs):
            return result
        shares = self.mixtures(self.word_logs(unique)[codes], owner, counts)
        for doc, share in zip(docs.tolist(), shares):
            best = int(np.argmax(share))
            parts = [(self.languages[i], float(share[i])) for i in np.argsort(-share, kind="stable") if share[i] > 0]
            result[doc] = (self.languages[best], float(share[best]), parts)
        return result

    @staticmethod
    def mixtures(logs: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Shares of every language in every document; rows of ``logs`` are words in document order."""
        starts = np.cumsum(counts) - counts
        alone = np.add.reduceat(logs, starts, axis=0)
        best = np.argmax(alone, axis=1)
        top = logs.max(axis=1)
        odds = np.exp(logs - top[:, None])
        shares = np.zeros(alone.shape)
        shares[np.arange(len(counts)), best] = 1.0
        reached = alone[np.arange(len(counts)), best] - np.add.reduceat(top, starts)

        def expected(odds, owner, starts, shares):
            """Likelihood of every word, and its posterior summed over the documents."""
            weighted = odds * shares[owner]
            likelihood = np.maximum(weighted.sum(axis=1), 1e-300)
            return np.log(likelihood), np.add.reduceat(weighted / likelihood[:, None], starts, axis=0)

        active = np.arange(len(counts))
        for _ in range(logs.shape[1] - 1):
            rows = np.isin(owner, active) if len(active) < len(counts) else np.ones(len(owner), dtype=bool)
            sub_odds, sub_counts = odds[rows], counts[active]
            sub_owner = np.repeat(np.arange(len(active)), sub_counts)
            sub_starts = np.cumsum(sub_counts) - sub_counts
            now = shares[active]
            likelihood = np.maximum((sub_odds * now[sub_owner]).sum(axis=1), 1e-300)
            # The likelihood is concave in the shares: a slope of at most 1 rules a language out.
            slope = np.add.reduceat(sub_odds / likelihood[:, None], sub_starts, axis=0) / sub_counts[:, None]
            slope[now > 0] = 0
            added = np.argmax(slope, axis=1)
            go = slope[np.arange(len(active)), added] > 1
            if not go.any():
                break
            trial = now * 0.5
            trial[np.arange(len(active)), added] = 0.5
            keep = go[sub_owner]
            sub_odds, sub_counts, trial, active = sub_odds[keep], sub_counts[go], trial[go], active[go]
            sub_owner = np.repeat(np.arange(len(active)), sub_counts)
            sub_starts = np.cumsum(sub_counts) - sub_counts
            for _ in range(STEPS):
                _, posterior = expected(sub_odds, sub_owner, sub_starts, trial)
                trial = posterior / sub_counts[:, None]
            logs_now, _ = expected(sub_odds, sub_owner, sub_starts, trial)
            value = np.add.reduceat(logs_now, sub_starts)
            better = value - reached[active] > PENALTY * np.log(sub_counts + 1)
            active = active[better]
            if not len(active):
                break
            shares[active], reached[active] = trial[better], value[better]
        return shares


def learned(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Count trigrams of a bounded sample per language."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2))
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rates = F.lit(0.0)
    for lang, n in rows.items():
        rates = F.when(F.col("lang") == lang, min(1.0, train_rows / n)).otherwise(rates)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    words = [w for t, own in zip(texts, langs) if own == lang for w in words_of(t)]
                    if words:
                        bucket, n = np.unique(trigrams(words)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(n), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())],
                            ["lang", "bucket", "n"])

    counted = usable.filter(drawn < rates).mapInArrow(run, "lang string, bucket int, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    for lang, bucket, n in zip(counts["lang"], counts["bucket"], counts["n"]):
        table[bucket, column[lang]] = n
    return Model(languages, smoothed(table))


def smoothed(table: np.ndarray) -> np.ndarray:
    """Log-probabilities; each language falls back on what all languages have in common."""
    pooled = table.sum(axis=1) + 0.5
    pooled /= pooled.sum()
    return np.log((table + PRIOR * pooled[:, None]) / (table.sum(axis=0) + PRIOR))


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def identified(docs: DataFrame, keep: list = (), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share), languages (all shares) and the columns
    of documents named in ``keep``."""
    model = learned(docs, train_rows)
    state = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    own = [c for c in keep if c not in ("doc_id", "text")]
    with_text = "text" in keep
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    held = F.coalesce(remainder() == 2, F.lit(False)).alias("held_out")
    new = ["lang_pred", "score", "languages"]

    def run(batches):
        model = Model(*state.value)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                found = model.infer(part.column("text").to_pylist())
                shares = [[{"lang": n, "share": s} for n, s in parts] for _, _, parts in found]
                kept = part if with_text else part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    [*kept.schema.names, *new])

    kept = plain if with_text else plain.drop("text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    predicted = plain.mapInArrow(run, f"{types}, lang_pred string, score double, languages {SHARES}")
    return predicted.select("doc_id", held, *new, *[c for c in kept.columns if c != "doc_id"])
