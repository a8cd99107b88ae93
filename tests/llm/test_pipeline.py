"""The registered queries and the corpus pipeline."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check
import corpus_pipeline
from tagweave.llm import queries, simhash
from tests.llm.test_duplicates import slow_components, slow_fingerprint, slow_lines, slow_matches
from tests.llm.test_packing import check_cover


def test_every_operator_has_its_query():
    names = sorted((int(n[2:].split("_")[0]) for n in contract.queries() if n.startswith("op")))
    assert names == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = contract.queries()[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cur.fetchall())


def test_stages_equal_brute_force(spark, sf):
    """Every stage on its own input: the languages that stay, lines, groups, leaks, and the cover."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, "en", "x", None), (9002, "### 123", "en", "x", 7), (9003, "a b c", "en", "x", 5), (9004, "a b c", "en", "x", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", docs["n_chars"])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        texts = [(r["doc_id"], r["text"]) for r in before]
        out = corpus_pipeline.saved(stage(spark, docs, sf), "stage")
        rows = out.collect()
        if name == "language_id":
            assert {r["doc_id"] for r in rows} >= {r["doc_id"] for r in before} - {9001, 9002, 9003, 9004}
            assert not {r["doc_id"] for r in rows} & {9001, 9002}
        elif name == "line_dedup":
            lost = {d: n for d, _, n, _ in slow_lines(texts)}
            assert {r["doc_id"] for r in rows} == set(lost) and any(lost.values())
            for r in rows:
                old = dict(texts)[r["doc_id"]]
                assert old.count("\n") + 1 - lost[r["doc_id"]] == (r["text"].count("\n") + 1 if r["text"] or not lost[r["doc_id"]] else 0)
                assert r["n_chars"] == len(r["text"])
        elif name == "near_dedup":
            roots = slow_components([(d, slow_fingerprint(t)) for d, t in texts])
            assert sorted(r["doc_id"] for r in rows) == sorted(set(roots))
        elif name == "decontaminate":
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, t in texts if not slow_matches(t, items))
        else:
            check_cover(rows, texts)
            return
        assert out.columns == corpus_pipeline.COLUMNS
        assert 0 < len(rows) <= len(before)
        docs = out


def test_pipeline_runs_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), name)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = contract.queries()["pipeline"](spark, sf).select(key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select(key).collect()))


def test_stages_on_edges(spark, sf, edges):
    """Nulls, empty, blank and long texts, repeated rows and clashing extra columns."""
    docs = edges
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), name)
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
    pieces = docs.collect()
    # Without a letter: 1, 2, 3, 5 and a row without an id. 7 copies 6.
    assert {r["doc_id"] for r in pieces} == {None, 4, 6, 8, 9, 10, 11, 12}


def test_one_row_of_every_group_of_copies_stays(spark, sf):
    """Copies that share an id or have none, also identical rows."""
    a, b, c = (" ".join(random.Random(n).choices("abcdefghij", k=60)) for n in (1, 2, 3))
    rows = [(5, a), (None, a), (9, b), (9, b), (9, b), (None, c), (None, c), (4, "another text"), (4, "quite different words here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == corpus_pipeline.COLUMNS
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert [k[0] for k in kept] == [0, 4, 5, 9] and kept[0][1] == c and kept[2:] == [(5, a), (9, b)]


def test_near_dedup_does_not_broadcast_its_index(spark, sf, monkeypatch):
    """From a written table of few fingerprints, as the stage has it."""
    made, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *args: made.append(links(*args)) or made[-1])
    rows = [(i, " ".join(random.Random(i // 2).choices("abcdefghij", k=60)) + " end" * (i % 2)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert got == sorted(set(slow_components([(i, slow_fingerprint(t)) for i, t in rows])))
    assert len(made) == 1 and len(made[0].collect()) > 0
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_text_in_three_languages_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = [r["lang"] for r in docs.groupBy("lang").count().filter("lang IS NOT NULL").orderBy(F.desc("count")).limit(3).collect()]
    words = {}
    for lang, part in zip(langs, (40, 35, 25)):
        found = docs.filter((F.col("lang") == lang) & (F.length("text") > 300)).orderBy("doc_id").select("text").collect()
        words[lang] = [w for r in found for w in r["text"].split()][:2 * part]
    mixed = " ".join(w for own in words.values() for w in own)
    extra = spark.createDataFrame([(9001, mixed, None, "s", len(mixed)), (9002, "12 34 --", None, "s", 8)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(extra), sf).filter("doc_id > 9000").collect()
    assert [r["doc_id"] for r in kept] == [9001]


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
