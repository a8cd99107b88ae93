"""SimHash near-duplicates, line deduplication and decontamination against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tagweave.llm import decontamination, line_dedup, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (doc_id, fingerprint) -> smallest doc_id reachable, by row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return [ids.get(find(i)) for i in range(len(rows))]


def test_simhash_equals_brute_force(documents, edges):
    texts = documents.select("doc_id", "text").collect() + edges.select("doc_id", "text").collect()
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text"))
    want = [(r["doc_id"], slow_fingerprint(r["text"])) for r in texts]
    reached = slow_components(want)
    got = simhash.near_duplicates(whole).select("doc_id", "fingerprint", "component_id").collect()
    expected = [(d, f"{f:016x}", c) for (d, f), c in zip(want, reached)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_simhash_of_a_document_with_two_texts(spark):
    """A document's own texts are linked, however far apart: 7 reaches 2 over 3."""
    a, c = (" ".join(random.Random(n).choices("abcdefghij", k=60)) for n in (1, 2))
    rows = [(3, a), (7, a), (3, c), (2, c), (None, a), (8, "something else")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 2), (2, 2), (3, 2), (3, 2), (7, 2), (8, 8)]


def test_simhash_with_clashing_columns(edges):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {i for i, r in by_id.items() if r["fingerprint"] == "0" * 16} == {1, 2, 3}
    assert all(by_id[i]["component_id"] == 1 for i in (1, 2, 3)) and by_id[7]["component_id"] == 6


def test_simhash_links_every_pair_within_three_bits(spark):
    random.seed(3)
    values = {random.getrandbits(64) for _ in range(60)}
    for value in list(values):
        for bits in range(1, 6):
            near = value
            for bit in random.sample(range(64), bits):
                near ^= 1 << bit
            values.add(near)
    values |= {0, 1, 7, 15, (1 << 64) - 1, 1 << 63, 7 << 31}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {frozenset((r["u"], r["v"])) for r in simhash.links(nodes).collect()}
    mask = (1 << 64) - 1
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_simhash_index_is_not_broadcast(spark):
    """Few fingerprints have a large index: its size is not that of the fingerprints."""
    nodes = spark.range(200).select(F.xxhash64("id").alias("fp"))
    found = simhash.links(nodes.union(nodes.selectExpr("fp ^ 5")))
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(-20, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    got = dict(simhash.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: -20 for i in range(-20, 41)}, **{i: 100 for i in range(100, 160)}}


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    text = b"a bc  def\tg hijk l" * 50 + b"  \n " * 20 + b"m n"
    whole = simhash.fingerprint(text)
    short = [simhash.fingerprint(t) for t in (b"a b" + b" " * 100, b" " * 30 + b"a", b"")]
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole
    assert [simhash.fingerprint(t) for t in (b"a b" + b" " * 100, b" " * 30 + b"a", b"")] == short


@pytest.mark.parametrize("fn", [simhash.near_duplicates, line_dedup.dedup_lines])
def test_empty_table(none, fn):
    assert fn(none).collect() == []


def slow_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for k in {key(line) for line in (text or "").split("\n")}:
                if len(k) >= 20:
                    held.setdefault(k, []).append(doc_id)
    result = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc_id is None or len(held.get(key(line), [])) < 3 or doc_id == max(held[key(line)])]
        result.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return result


@pytest.mark.parametrize("batches", [1, 4])
def test_lines_equal_brute_force(documents, edges, batches):
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text"))
    want = slow_lines([tuple(r) for r in whole.collect()])
    got = line_dedup.dedup_lines(whole, batches=batches).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_lines_with_clashing_columns(edges):
    got = line_dedup.dedup_lines(edges, keep=["text", "lang"]).collect()
    assert len(got) == edges.count()
    assert {r["doc_id"] for r in got if r["n_dropped"]} == {6, 7, 8}


def test_runs_are_compacted(spark, documents):
    runs = line_dedup.LineRuns(spark, buckets=3)
    keys = line_dedup.keys_of(documents)
    for low, high in ((150, 1000), (100, 150), (50, 100), (0, 50)):
        runs.add(keys.filter(f"doc_id >= {low} AND doc_id < {high}"))
    assert [len(level) for level in runs.levels] == [2, 1]
    want = keys.groupBy("k").agg({"doc_id": "max", "*": "count"}).selectExpr("k", "`count(1)`", "`max(doc_id)`")
    assert sorted(map(tuple, runs.merged().collect())) == sorted(map(tuple, want.collect()))
    runs.close()


def slow_matches(text, items, size=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    own = {k: {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} for k in range(1, size + 1)}
    found = []
    for item_id, item in items:
        w = re.findall(r"[^\W_]+", (item or "").lower())
        k = min(size, len(w))
        grams = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
        if item_id is not None and grams and len(grams & own[k]) * 10 >= 8 * len(grams):
            found.append((item_id, len(grams), len(grams & own[k])))
    return found


def test_containment_equals_brute_force(spark, documents, edges, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    items = [tuple(r) for r in rows] + [(900, None), (901, ""), (902, "one two three four"), (None, "a b c d e f"),
                                        (903, "The quick brown fox jumps over the lazy dog"), (904, "word0 the0 word1 the1 word2"),
                                        (904, "le chat est sur la TABLE, et le chien"), (906, "Some words."),
                                        (907, "chien"), (908, "the quick brown fox"), (909, "never seen words"), (905, "x" * 3000 + " a b c d e")]
    random.seed(5)
    mutated = []
    for n, (_, text) in enumerate(items[:40]):
        words = (text or "").split()
        for _ in range(random.randint(1, 3)):
            if words:
                words[random.randrange(len(words))] = "changed"
        mutated.append((5000 + n, "some words before " * 30 + " ".join(words) + " and after" * 50))
    more = spark.createDataFrame(mutated, "doc_id long, text string")
    whole = documents.select("doc_id", "text").union(edges.select("doc_id", "text")).union(more)
    want = sorted(((r["doc_id"], *m) for r in whole.collect() for m in slow_matches(r["text"], items)), key=repr)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(whole, bench).select("doc_id", "item_id", "n_shingles", "n_shared").collect()
    assert sorted(map(tuple, got), key=repr) == want
    # In blocks of items the result is the same.
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (2000,))
    got = decontamination.contaminated(whole, bench).select("doc_id", "item_id", "n_shingles", "n_shared").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_containment_of_nothing(edges, none):
    items = none.selectExpr("doc_id AS item_id", "text")
    assert decontamination.contaminated(edges, items).collect() == []
    assert decontamination.contaminated(none, edges.selectExpr("doc_id AS item_id", "text")).collect() == []
    kept = decontamination.screen(edges, items, keep=["text", "lang"])
    assert kept.columns == ["doc_id", "text", "lang", "matches"] and kept.count() == edges.count()
