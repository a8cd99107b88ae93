from pyspark.sql import functions as F

from tagweave.operators import audit as au
from tagweave.operators import enrich, medallion
from tagweave.operators import lookups as lk
from tagweave.operators.dedup import NATURAL_KEY, with_natural_key
from tagweave.plans import fixtures as fx
from tagweave.session import files_version
from tagweave.sources import sinks
from tagweave.streaming import jobs


def test_restart_and_new_files(spark, tmp_path, sf):
    """Stopped and started again, with files added in between, nothing is lost or doubled."""
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "cp"))
    rows = fx.plant_envelopes(spark, sf).persist()
    for part in ("offset < 400", "offset >= 400"):
        sinks.write_log_files(rows.filter(part), log)
        for _ in range(2):
            jobs.stream_bronze(jobs.log_stream(spark, log, 3), out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).select("kafka_offset").orderBy("kafka_offset").collect()
    assert [r[0] for r in got] == [r[0] for r in rows.select("offset").orderBy("offset").collect()]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, sf):
    """Without a checkpoint the same log is read again; offsets are stored once."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    sinks.write_log_files(fx.plant_envelopes(spark, sf), log)
    for n in range(2):
        bronze = medallion.bronze(jobs.log_stream(spark, log, 4))
        jobs.stream_historian(bronze, out, str(tmp_path / f"cp{n}")).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("kafka_offset").distinct().count() == fx.plant(spark, sf).count()


def test_live_state_equals_batch(spark, tmp_path, sf):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = fx.plant_envelopes(spark, sf)
    rows.repartition(5).write.json(log)
    live = medallion.bronze(jobs.log_stream(spark, log, 1)).select("tag", "value", "kafka_offset")
    jobs.stream_latest(live, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.tag: r.kafka_offset for r in jobs.latest_state(spark, out, ["tag"]).collect()}
    assert got == {r[0]: r[1] for r in rows.groupBy("key").agg(F.max("offset")).collect()}


def test_a_change_of_lookups_reaches_the_next_batch(spark, tmp_path):
    """Six batches and two changes of the lookup files: three preparations, each from its batch on."""
    source, assets, out = (str(tmp_path / n) for n in ("in", "assets", "out"))
    rows = spark.range(6).select(F.col("id").cast("string").alias("reading_id"), F.lit("A-1").alias("tag"), F.lit(5.0).alias("value"),
                                 F.lit("2026-01-01").alias("timestamp"))
    held = enrich.Snapshots(lambda session: lk.build_lookups(
        session, assets=session.read.schema("tag string, asset string, control string, seq long").parquet(assets), reference=False,
        batches=session.createDataFrame([(a, "b", "P", 1) for a in "XYZ"], "asset string, lot string, sku string, seq long")),
        lambda session: files_version(session, [assets]))
    for at in range(6):
        if at % 2 == 0:
            spark.createDataFrame([("A-1", "XYZ"[at // 2], "1 - 9", 1)], "tag string, asset string, control string, seq long").write.mode(
                "overwrite").parquet(assets)
        rows.filter(f"reading_id = '{at}'").coalesce(1).write.mode("append").parquet(source)
        stream = enrich.consume(spark.readStream.schema(rows.schema).parquet(source))
        jobs.stream_enriched(stream, held, out, str(tmp_path / "rejects"), str(tmp_path / "cp")).awaitTermination()
    got = {r.reading_id: r.asset for r in spark.read.parquet(out).select("reading_id", "asset").collect()}
    assert got == {str(at): "XYZ"[at // 2] for at in range(6)} and held.prepared == 3


def test_live_chains_stay_valid(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).select((F.col("id") % 3).cast("string").alias("chain"), F.lit("t").alias("ts"), F.lit("a").alias("actor"),
                                  F.lit("x").alias("action"), F.lit("p").alias("payload"), "id")
    for low in (0, 10, 25):
        rows.filter(f"id >= {low} and id < {low + 15 if low else 10}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.stream_audit(stream, out, str(tmp_path / "cp"), [F.col("id")], 4).awaitTermination()
    audit = au.stored_entries(spark, out)
    assert audit.count() == 40
    assert all(r.valid for r in au.verify(audit, au.stored_seals(spark, out), 4).collect())
    cut = audit.filter("not (chain = '0' and segment = 1)")
    assert [r.valid for r in au.verify(cut, au.stored_seals(spark, out), 4).orderBy("chain").collect()] == [False, True, True]


def test_late_first_copies_are_kept(spark, tmp_path, sf):
    """Readings of an earlier month that come after later ones, and copies of both."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = fx.plant_readings(spark, sf)
    early = F.col("ts") < F.lit("2026-08-25").cast("timestamp_ntz")
    for part in (rows.filter(~early), rows.filter(early), rows):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.stream_deduplicated(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == with_natural_key(rows).select(*NATURAL_KEY).distinct().count()


def test_a_first_batch_without_rows(spark, tmp_path):
    """An empty first file leaves a folder without data; the batches after it go on."""
    rows = spark.createDataFrame([("T", 1.0, "2026-08-01 00:00:00"), ("T", 1.0, "2026-08-01 00:00:00"), ("U", 2.0, "")],
                                 "tag string, value double, timestamp string")
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows.limit(0), rows, rows):
        part.coalesce(1).write.mode("append").parquet(path)
        jobs.stream_deduplicated(spark.readStream.schema(rows.schema).parquet(path), out, checkpoint).awaitTermination()
    assert sorted(r.tag for r in spark.read.parquet(out).collect()) == ["T", "U"]
