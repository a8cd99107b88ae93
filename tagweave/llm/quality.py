"""Quality rules: base statistics, and a calibrated linear model over hashed n-grams.

Every text has three blocks of hashed features: word unigrams, word bigrams and runs of four
bytes, each with the shares of the block as values, so that a text of any length is one
point. Logistic regression is trained on a bounded sample of about ``TRAIN_ROWS`` labelled
documents, and its margins are turned into probabilities by a logistic curve (Platt) fitted
on another sample of about ``CALIBRATION_ROWS``. Documents are scored where they lie, in
Arrow batches, and kept from a fixed probability of being good.

Defined cases: words are runs of other characters than ASCII white space. Null and empty
texts have no words and fail the base rules. Labels other than 0 and 1 are ignored; a
document with several labels counts with each. Without labels of both kinds there is no
model, the probability is null and the base rules alone decide. Every row of documents is
judged by itself.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import as_bytes, saved, text_slices

# Fixed limits of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
KEEP_PROBABILITY = 0.5
TRAIN_ROWS = 6000
CALIBRATION_ROWS = 3000
BLOCK = 1 << 15
BLOCKS = 3
# Features are shares; this brings them to the scale that the penalty expects.
SCALE = 30.0
PENALTY = 1e-4
STEPS = 40
# Hashing takes some 80 bytes per byte of text.
SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def hashed_features(texts: list) -> list:
    """[(document, feature)] arrays of each block for a list of texts as bytes."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    chars = np.frombuffer(data, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    empty = (np.zeros(0, dtype=np.int64),) * 2
    if not len(chars):
        return [empty] * BLOCKS
    first = np.zeros(len(chars) + 1, dtype=bool)
    first[ends - sizes] = True
    space = np.isin(chars, np.frombuffer(SPACE, dtype=np.uint8))

    # Prefix sums of byte * base^place make the hash of any word a difference.
    powers = np.full(len(chars), BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(len(chars), pow(BASE, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers)])
    starts = np.flatnonzero(~space & (first[:-1] | np.concatenate([[True], space[:-1]])))
    stops = np.flatnonzero(~space & (first[1:] | np.concatenate([space[1:], [True]]))) + 1
    # The end of a text is the start of the next one or of nothing.
    words = mixed((prefix[stops] - prefix[starts]) * back[starts])
    word_owner = owner[starts]
    pairs = np.flatnonzero(word_owner[1:] == word_owner[:-1])
    bigrams = mixed(words[pairs] * np.uint64(BASE) + words[pairs + 1])

    runs = np.zeros(max(0, len(chars) - 3), dtype=np.uint64)
    for i in range(4):
        runs |= chars[i:len(chars) - 3 + i].astype(np.uint64) << np.uint64(8 * i)
    whole = np.flatnonzero(owner[3:] == owner[:-3]) if len(runs) else np.zeros(0, dtype=np.int64)
    runs = mixed((runs[whole] + np.uint64(1)) * np.uint64(BASE))
    blocks = [(word_owner, words), (word_owner[pairs], bigrams), (owner[whole], runs)]
    return [(own, (values % np.uint64(BLOCK)).astype(np.int64) + i * BLOCK) for i, (own, values) in enumerate(blocks)]


def margins(texts: list, weights: np.ndarray) -> np.ndarray:
    """Sum of weight times value over the features of every text."""
    total = np.zeros(len(texts))
    for owner, feature in hashed_features(texts):
        sums = np.bincount(owner, weights=weights[feature], minlength=len(texts))
        total += SCALE * sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    return total


def sparse(text: bytes):
    """One text's features as sorted places and values."""
    places, values = [], []
    for _, feature in hashed_features([text]):
        place, n = np.unique(feature, return_counts=True)
        places.append(place)
        values.append(SCALE * n / max(1, n.sum()))
    return np.concatenate(places), np.concatenate(values)


def base_counts(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        covered = 0  # words before this place are counted
        for at, window in enumerate(windows):
            if often[window] > 1:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def plain_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Verdict:
    """Weights of the linear model and its calibration."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probabilities(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins(texts, self.weights) + self.offset, -500, 500)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve; targets are drawn in by Platt's prior."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    scale = max(float(margin.std()), 1e-9)
    x = np.stack([(margin - margin.mean()) / scale, np.ones(len(margin))])
    fit = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(fit @ x, -500, 500)))
        bend = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, x @ (p - target))
        fit = fit - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(fit[0] / scale), float(fit[1] - fit[0] * margin.mean() / scale)


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
            calibration_rows: int = CALIBRATION_ROWS) -> Verdict | None:
    """Fit and calibrate on labelled rows; None if one kind of label is missing."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.filter("doc_id IS NOT NULL")
    rows = known.count()
    wanted = train_rows + calibration_rows
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = min(1.0, wanted / max(1, rows))
    # Drawn by a hash of the id, so close to the number wanted; the limit bounds the broadcast.
    sample = known.filter(drawn < rate).withColumn("fit", drawn < rate * train_rows / wanted).limit(2 * wanted)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                found = [sparse(t or b"") for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("fit"), pa.array([p for p, _ in found], pa.list_(pa.int32())),
                     pa.array([v for _, v in found], pa.list_(pa.float64()))], ["label", "fit", "places", "values"])

    marked = plain_documents(docs).join(F.broadcast(sample), "doc_id").select("text", "label", "fit")
    rows = saved(marked.mapInArrow(run, "label double, fit boolean, places array<int>, values array<double>"), "quality-rows")
    kinds = rows.groupBy("fit").agg(F.countDistinct("label").alias("n")).collect()
    if {r["fit"]: r["n"] for r in kinds}.get(True, 0) < 2:
        return None
    vector = F.udf(lambda places, values: Vectors.sparse(BLOCKS * BLOCK, places, values), VectorUDT())
    points = rows.select("label", "fit", vector("places", "values").alias("features"))
    fit = LogisticRegression(regParam=PENALTY, maxIter=STEPS, standardization=False).fit(points.filter("fit"))
    weights = fit.coefficients.toArray()
    calibration = fit.transform(points.filter("NOT fit")).select("rawPrediction", "label").collect()
    margin = np.array([r["rawPrediction"][1] - fit.intercept for r in calibration])
    label = np.array([r["label"] for r in calibration])
    if len(set(label.tolist())) < 2:
        return Verdict(weights, 1.0, float(fit.intercept))
    return Verdict(weights, *platt(margin, label))


def judged(docs: DataFrame, labels: DataFrame, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of every document."""
    verdict = trained(docs, labels)
    state = docs.sparkSession.sparkContext.broadcast(verdict and (verdict.weights, verdict.slope, verdict.offset))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def run(batches):
        model = Verdict(*state.value) if state.value else None
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                texts = [t or b"" for t in as_bytes(part.column("text"))]
                counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                good = model.probabilities(texts) if model else np.full(len(texts), np.nan)
                kept = ~failed & (good >= keep_probability) if model else ~failed
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c) for c in counts.T], pa.array(failed),
                     pa.array(good, from_pandas=True), pa.array(kept)], names)

    longs = ", ".join(f"{n} long" for n in names[:6])
    return plain_documents(docs).mapInArrow(run, f"{longs}, base_failed boolean, probability double, kept boolean")
