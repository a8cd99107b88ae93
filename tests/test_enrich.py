import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagweave.operators import enrich as en
from tagweave.operators import lookups as lk
from tagweave.operators import sizing
from tagweave.plans import fixtures as fx

ASSETS = [("A-1", "X", "1 - 9", 1), ("A-1", "Y", "3 - 4", 2), ("B-1", "Z", "1 - 9", 3), ("C-1", "W", "-5 - 10", 4)]
BATCHES = [("X", "late", "P", "2026-01-01", "2026-01-10", 2), ("X", "first", "Q", "2026-01-05", "2026-01-06 12:00", 1),
           ("X", "", "R", "", "", 0), ("Z", "", "P", "2026-01-01", "2026-01-02", 1), ("Z", "full", "P", "2026-02-01", "2026-02-02", 2)]


@pytest.fixture(scope="module")
def lookups(spark):
    assets = spark.createDataFrame(ASSETS, "tag string, asset string, control string, seq long")
    batches = spark.createDataFrame(BATCHES, "asset string, lot string, sku string, start_time string, end_time string, seq long")
    return lk.build_lookups(spark, assets=assets, batches=batches, reference=False)


def run(spark, lookups, rows):
    raw = spark.createDataFrame(rows, "reading_id string, tag string, value double, timestamp string")
    got = en.enrich(en.consume(raw), lookups)
    return {r.reading_id: r for r in got.collect()}


def test_batches_in_time(spark, lookups):
    got = run(spark, lookups, [("in", "A-1", 5.0, "2026-01-02"), ("overlap", "A-1", 5.0, "2026-01-05T10:00:00Z"),
                               ("end", "A-1", 5.0, "2026-01-06 12:00:00"), ("after", "A-1", 5.0, "2026-01-06 12:00:01"),
                               ("out", "A-1", 5.0, "2027-01-01"), ("no time", "A-1", 5.0, ""), ("bad time", "A-1", 5.0, "soon"),
                               ("blank in", "B-1", 5.0, "2026-01-01"), ("blank out", "B-1", 5.0, "2026-06-01")])
    assert {k: (r.batch, r.time_match) for k, r in got.items()} == {
        "in": ("late", "in-window"), "overlap": ("first", "in-window"), "end": ("first", "in-window"), "after": ("late", "in-window"),
        "out": ("first", "outside-window"), "no time": ("first", "uploaded"), "bad time": ("first", "uploaded"),
        "blank in": ("", "in-window"), "blank out": ("full", "outside-window")}


def test_first_asset_row_and_rejects(spark, lookups):
    got = run(spark, lookups, [("one", "A-1", 9.5, "2026-01-02"), ("no tag", "", 1.0, ""), ("no asset", "Q", 1.0, ""),
                               ("no batch", "C-1", -6.0, ""), ("no value", "A-1", None, "")])
    assert len(got) == 5 and got["one"].asset == "X" and (got["one"].status, got["one"].delta, got["one"].zone) == ("OVER", 0.5, "alarm")
    assert got["no tag"].reason == "reading has no tag"
    assert got["no asset"].reason == "tag Q not found in asset model"
    assert got["no batch"].reason == "asset W not found in MES"
    assert got["no value"].reason == "tag A-1 has no numeric value"


def test_built_in_chain_on_the_sample(spark):
    rows = [("a", "TT-1202B", 37.88, "2026-08-14T10:00:02Z"), ("b", "TT-1202B", 38.22, "2026-08-14T10:00:03Z"),
            ("c", "AT-3401", 7.35, "2026-08-14T10:00:02Z"), ("d", "PT-2201", 111.4, "2026-08-14T10:00:02Z"),
            ("e", "CT-5501", 901.0, "2026-08-14T10:00:02Z"), ("f", "MT-6601", 52.4, "2026-08-13T08:00:00")]
    got = run(spark, lk.build_lookups(spark), rows)
    assert {k: (r.zone, r.status, r.delta, r.batch, r.time_match) for k, r in got.items()} == {
        "a": ("alarm", "OVER", 0.38, "OMZ-114", "outside-window"), "b": ("trip", "OVER", 0.72, "OMZ-114", "outside-window"),
        "c": ("alarm", "OVER", 0.15, "OMZ-114", "outside-window"), "d": ("alarm", "OVER", 1.4, "NIS-208", "outside-window"),
        "e": ("alarm", "OVER", 1.0, "WFI-DAILY", "outside-window"), "f": ("control", "OK", 0.0, "MIN-051", "in-window")}


def rows_of(df):
    return sorted(map(str, df.drop("lookup_origin").collect()))


def test_large_lookups_give_the_same(spark, sf, monkeypatch):
    """Without any broadcast of lookups."""
    readings = fx.floor_good(spark, sf)
    want = rows_of(en.enrich(readings, fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS))
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", -1)
    assert rows_of(en.enrich(readings, en.prepare(fx.floor_lookups(spark, sf)), fx.FLOOR_PARAMETERS)) == want


def crowded(spark, n):
    """n windows of asset X, most of them open at once; some of a second, copies, and one before 1970."""
    chance, rows = random.Random(n), []
    for i in range(n):
        start = datetime(2026, 1, 1) + timedelta(seconds=chance.randrange(4000))
        end = start + timedelta(seconds=chance.choice([0, 1, 7, 500, 3000, 9000]))
        rows.append(("X", f"b{i}", "P", str(start), str(end), chance.randrange(n)))
    rows += [("X", "old", "P", "1969-12-31 23:00:00", "1970-01-01 01:00:00", n), (*rows[0][:5], n + 1)]
    assets = spark.createDataFrame(ASSETS, "tag string, asset string, control string, seq long")
    batches = spark.createDataFrame(rows, "asset string, lot string, sku string, start_time string, end_time string, seq long")
    return rows, lk.build_lookups(spark, assets=assets, batches=batches, reference=False)


def test_crowded_windows_cost_no_more_exchanges(spark, monkeypatch):
    """Thousands of windows open at once: the first in file order by brute force, by the plan of a few."""
    exchanges = []
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", -1)
    for n in (5, 5000):
        rows, lookups = crowded(spark, n)
        times = [datetime(2026, 1, 1) + timedelta(seconds=s) for s in range(-5, 14000, 97)] + [datetime(1969, 12, 31, 23, 30), datetime(1970, 1, 1, 2)]
        raw = spark.createDataFrame([(str(t), "A-1", 5.0, str(t)) for t in times], "reading_id string, tag string, value double, timestamp string")
        full = en.enrich(en.consume(raw), en.prepare(lookups))
        got = {r.reading_id: (r.batch, r.time_match) for r in full.select("reading_id", "batch", "time_match").collect()}
        default = min(rows, key=lambda r: r[5])[1]
        for t in map(str, times):
            least = min((r[5] for r in rows if r[3] <= t <= r[4]), default=None)
            names = {r[1] for r in rows if r[5] == least and r[3] <= t <= r[4]}
            assert got[t][1] == ("in-window" if names else "outside-window")
            assert got[t][0] in names if names else rows[[r[1] for r in rows].index(got[t][0])][5] == min(r[5] for r in rows), (t, default)
        exchanges.append(full._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert exchanges[0] == exchanges[1]


def test_snapshots_are_prepared_when_the_version_changes(spark, lookups):
    versions = iter([1, 1, 2, 2, 2, 3])
    held = en.Snapshots(lambda session: lookups, lambda session: next(versions))
    seen = [id(held(spark)) for _ in range(6)]
    assert held.prepared == 3 and seen[0] == seen[1] and seen[2] == seen[4] != seen[5]


def test_enrichment_does_not_shuffle_readings(spark, sf):
    df = en.enrich(fx.floor_good(spark, sf), fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and "CartesianProduct" not in physical and "NestedLoop" not in physical
    assert "Cross" not in plan


def test_lookup_join_with_a_hot_key_and_null_keys(spark):
    fact = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
                                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    dim = fact.filter("k is not null").select("k").distinct().filter("k <> 'k5'").withColumn("d", F.upper("k"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, fact.join(dim, "k", how).collect()))
        assert sorted(map(str, sizing.lookup_join(fact, dim, "k", how, small=False).collect())) == plain


def test_numbering_across_partitions(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    got = sizing.numbered(rows.repartition(5), [F.desc("id")], group=["g"], start=1).toPandas()
    want = got.sort_values("id", ascending=False).groupby("g").cumcount() + 1
    assert (got["seq"] == want.reindex(got.index)).all()
    whole = sizing.numbered(rows.repartition(5), [F.col("id")], start=10).toPandas()
    assert (whole["seq"] == whole["id"] + 10).all()


def test_table_classification_and_active_source(spark):
    tables = spark.createDataFrame([("batch.csv", ["x"]), ("x.csv", ["Tag", "Unit"]), ("x.csv", ["tag"]), ("lab mes", [])],
                                   "filename string, columns array<string>")
    assert [r.kind for r in lk.classify_tables(tables).collect()] == ["mes", "asset", "other", "mes"]
    data = spark.createDataFrame([(1, "mes", 5, True, 1), (2, "mes", 5, False, 9), (3, "mes", 0, True, 10)],
                                 "dataset_id long, kind string, row_count long, persisted boolean, seq long")
    assert [r.dataset_id for r in lk.active_dataset(data).collect()] == [1]
