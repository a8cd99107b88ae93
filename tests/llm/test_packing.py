"""Packing: an exact cover of every document's tokens, close to the fewest sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagweave.llm import packing


def check_cover(rows, texts, capacity=1024):
    """Pieces cover the tokens of all texts, in gapless sequences; returns (sequences, tokens)."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, tokens = [], 0
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        tokens += len(ids)
        first = len(ids) % capacity or capacity
        for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
            start = 0 if piece == 0 else end - capacity
            want.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), tokens


def test_packing_of_documents(documents, edges):
    special = documents.sparkSession.createDataFrame([(7001, "a <|endoftext|> b"), (7002, "<|endoftext|>")], "doc_id long, text string")
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text")).union(special)
    rows = packing.pack(whole.repartition(5)).collect()
    sequences, tokens = check_cover(rows, [tuple(r) for r in whole.collect()])
    assert sequences <= 1.05 * tokens / 1024 + 1


def test_packing_with_clashing_columns(edges, none):
    assert packing.pack(edges).count() >= edges.count()
    assert packing.pack(none).collect() == []


def histogram(values):
    lengths, counts = np.unique(values, return_counts=True)
    return dict(zip(lengths.tolist(), counts.tolist()))


rng = np.random.default_rng(0)
CASES = {
    "uniform": rng.integers(1, 1025, 20_000), "few": rng.integers(1, 1025, 50), "middle": rng.integers(300, 400, 3000),
    "small": rng.integers(1, 60, 5000), "large": rng.integers(600, 1024, 500), "one": np.array([1]), "full": np.array([1024] * 7),
    "thirds": np.array([341] * 999 + [342] * 10), "halves": np.array([512] * 100 + [513] * 100 + [511] * 100),
    "skewed": np.minimum(1024, np.exp(rng.normal(6, 0.8, 20_000)).astype(int) + 1),
}


@pytest.mark.parametrize("name", CASES)
def test_slots_hold_every_rank_once(name):
    counts = histogram(CASES[name])
    slots, used = packing.slots_of(counts), {}
    for length, count in counts.items():
        first, start, offset, per = slots[length]
        assert first[0] == 0 and (np.diff(first) > 0).all()
        ranks = np.arange(count)
        at = np.searchsorted(first, ranks, "right") - 1
        within = ranks - first[at]
        for s, o in zip((start[at] + within // per[at]).tolist(), (offset[at] + length * (within % per[at])).tolist()):
            used.setdefault(s, []).append((o, length))
    total = 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert total == sum(length * count for length, count in counts.items())
    # No more sequences than best-fit decreasing needs, which is close to the bound.
    plain = packing.Runs(1024)
    for length in sorted(counts, reverse=True):
        plain.best_fit(length, counts[length])
    assert len(used) <= plain.total()


def test_groups_have_equal_cardinality():
    counts = histogram(rng.integers(300, 1024, 1000))
    groups = packing.grouped(counts, 10)
    assert sum(c for _, members in groups for _, c in members) == 1000
    for rounded, members in groups:
        assert max(length for length, _ in members) == rounded
    assert all(abs(sum(c for _, c in members) - 100) <= 1 for _, members in groups)


def test_configurations_reach_the_relaxed_optimum():
    """Halves, thirds and mixed pairs: the relaxation is known."""
    for sizes, wanted, best in (([600, 424], [10, 10], 10), ([512], [9], 4.5), ([341, 300], [9, 0], 3),
                                ([700, 400, 300], [6, 4, 8], 8.5)):
        used = packing.configuration_counts(np.array(sizes), np.array(wanted, dtype=float), 1024)
        assert abs(sum(x for _, x in used) - best) < 1e-6
        assert all((np.array(sizes) * c).sum() <= 1024 for c, _ in used)
