import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from tagweave.functions import scalars as s
from tagweave.operators import boards, lookups, medallion
from tagweave.plans import fixtures as fx
from tagweave.sources import files, readings, sinks
from tagweave.sources.parameters import BUILT_IN

CLOCK = "2026-08-14T10:00:{:02d}Z"


def sample_rows():
    """Per tag and tick: seven values in control, two in alarm, one in trip out of ten."""
    for tick in range(100):
        for p in BUILT_IN:
            (lo, hi), (_, a), (_, t) = p.control, p.alarm, p.trip
            k = tick % 10
            value = (lo + hi) / 2 if k < 7 else hi + (a - hi) * 0.55 if k < 9 else a + (t - a) * 0.45
            yield p.tag, round(value, 3), p.unit, f"2026-08-14T10:{tick // 60:02d}:{tick % 60:02d}Z"


def write(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body, encoding="utf-8")


def test_delimited_files(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", "﻿Tag;Value;Unit;Time\nTT-1202B;37.9;C;2026-08-14\n;1;x;y\nAT-3401;abc;pH;\n")
    got = {tuple(r) for r in readings.read_delimited(spark, str(folder)).select("tag", "value", "unit", "timestamp").collect()}
    assert got == {("TT-1202B", "37.9", "C", "2026-08-14"), ("AT-3401", "abc", "pH", "")}


def test_title_lines_in_every_file(spark, tmp_path):
    folder = tmp_path / "in"
    for n in range(3):
        write(folder, f"{n}.csv", f"Export {n}\nPlant, night\nx\ntag,value,ts\nTT-1202B,{n},2026-08-14\n")
    got = readings.read_delimited(spark, str(folder))
    assert sorted(r.value for r in got.collect()) == ["0", "1", "2"]


def test_wide_files_come_before_the_long_form(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "w.tsv", "time\tTT-1202B\tph\tunit\n2026-08-14\t37\t\tu\n2026-08-15\t38\t7\tu\n")
    got = {tuple(r) for r in readings.read_delimited(spark, str(folder)).select("tag", "value", "unit", "timestamp").collect()}
    assert got == {("TT-1202B", "37", "u", "2026-08-14"), ("TT-1202B", "38", "u", "2026-08-15"), ("ph", "7", "u", "2026-08-15")}


def test_every_file_has_its_own_layout(spark, tmp_path):
    """Delimiters, title lines, a wide file, a title line that comes again, quoted line breaks."""
    folder = tmp_path / "in"
    write(folder, "a.csv", "Plant 1\nTT-1202B,9,x\nnight\ntag,value,ts\nTT-1202B,1,a\nTT-1202B,9,x\n")
    write(folder, "b.csv", "tag,value,ts\n" + "".join(f"AT-3401,{n},b\n" for n in range(10)))
    write(folder, "c.csv", "Time;Tag;Value;Unit\nc;PT-2201;1,5;bar\n")
    write(folder, "d.csv", "time\tTT-1202B\tph\nd\t37\t\nd\t38\t7\n")
    write(folder, "e.csv", 'tag,value,unit,ts\n"MT-6601",5,"two\nlines, quoted",e\nMT-6601,6,"a ""b""",e\n')
    got = readings.read_delimited(spark, str(folder)).select("tag", "value", "unit", "timestamp").collect()
    want = [("TT-1202B", "1", "", "a"), ("TT-1202B", "9", "", "x"), *[("AT-3401", str(n), "", "b") for n in range(10)],
            ("PT-2201", "1,5", "bar", "c"), ("TT-1202B", "37", "", "d"), ("TT-1202B", "38", "", "d"), ("ph", "7", "", "d"),
            ("MT-6601", "5", "two\nlines, quoted", "e"), ("MT-6601", "6", 'a "b"', "e")]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_quote_within_a_cell_is_text(spark, tmp_path):
    """As csv.reader: an inch mark opens nothing, cells with line breaks do, over block bounds too."""
    body = ['5" pipe', '"two\nlines"', '"a ""b"""', '7" and 9"', '"x\n""y"",\nz"', "plain", '"a"b', '3"']
    text = "tag,value,note\n" + "".join(f"AT-3401,{n},{body[n * n % 7 if n % 5 else 7]}\n" for n in range(400))
    want = sorted((r["value"], r["note"]) for r in csv.DictReader(io.StringIO(text)) if r["note"] != "ab")
    write(tmp_path / "in", "a.csv", text)
    for block in ("128m", "512b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            records = readings.file_records(spark, str(tmp_path / "in"))
            cells = F.from_csv("value", "tag string, value string, note string", {"sep": ",", "escape": '"'})
            got = records.filter("NOT startswith(value, 'tag,')").select(cells.alias("c")).select("c.*").collect()
            read = readings.read_delimited(spark, str(tmp_path / "in")).select("value").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["value"], r["note"]) for r in got if r["note"] != '"a"b') == want
        assert sorted(int(r["value"]) for r in read) == list(range(400))


def test_a_file_without_readings_is_named(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "x.csv", "a,b\n1,2\n")
    with pytest.raises(Exception, match="x.csv"):
        readings.read_delimited(spark, str(folder)).collect()


def test_json_files(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [{"tag": "AT-3401", "value": 7, "timestamp": "2026-08-14"}, {"param": "hum", "value": "50%"}]
    write(folder, "array.json", json.dumps(rows))
    write(folder, "object.json", json.dumps({"rows": rows}))
    got = sorted((r.tag, r.value) for r in readings.read_json(spark, str(folder)).collect())
    assert got == [("AT-3401", "7")] * 2 + [("hum", "50%")] * 2


def test_lookup_tables(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "t.csv", "Tag, Asset-Id ,Control Lo\nA, x ,1\n,,\n , ,\n")
    got = files.read_lookup_table(spark, str(folder))
    assert got.columns == ["tag", "asset_id", "control_lo"] and [tuple(r) for r in got.collect()] == [("A", "x", "1")]
    write(tmp_path / "j", "t.json", json.dumps({"records": [{"Tag": "A", "N o": 1}, {"Tag": " "}]}))
    got = files.read_lookup_table(spark, str(tmp_path / "j"), "json")
    assert [(r.tag, r.n_o) for r in got.collect()] == [("A", "1")]


def test_lookup_rows_in_file_order(spark, tmp_path):
    """The first row of a key is the first by file name and line, whatever the files' sizes."""
    folder = tmp_path / "in"
    write(folder, "a.csv", "tag,asset\nT,first\nU,x\n")
    write(folder, "b.csv", "tag,asset\n" + "".join(f"T,b{n}\nV,v{n}\n" for n in range(3000)))
    write(folder, "c.csv", "tag,asset\nV,late\nT,late\n")
    rows = files.read_lookup_table(spark, str(folder), order=True)
    got = {r.tag: r.asset for r in lookups.first_match(rows, "tag").collect()}
    assert got == {"T": "first", "U": "x", "V": "v0"}
    ordered = [r.asset for r in rows.filter("tag = 'V'").orderBy("seq").collect()]
    assert ordered == [f"v{n}" for n in range(3000)] + ["late"]
    write(tmp_path / "j", "t.json", json.dumps({"rows": [{"tag": "A", "n": i} for i in range(50)]}))
    got = files.read_lookup_table(spark, str(tmp_path / "j"), "json", order=True)
    assert [r.n for r in got.orderBy("seq").collect()] == [str(i) for i in range(50)]


def test_file_profile_and_inventory(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.dat").write_bytes(b"%PDF-1.4")
    (folder / "b.pdf").write_bytes(b"RIFF1234WEBPxx")
    (folder / "c.csv").write_bytes(b"x")
    (folder / "site-d.tsv").write_bytes(b"xy")
    got = {r.filename: (r.content_type, r.file_kind) for r in files.file_profile(files.scan_files(spark, str(folder))).collect()}
    assert got["a.dat"] == ("application/pdf", "pdf") and got["b.pdf"] == ("image/webp", "image")
    assert got["c.csv"] == ("text/csv", "file")
    listed = [r.name for r in files.inventory(files.scan_files(spark, str(folder)), "Site-").collect()]
    assert listed == ["site-d.tsv", "c.csv"]


def test_sample_counts_per_zone(spark, path):
    raw = spark.createDataFrame(list(sample_rows()), "tag string, value double, unit string, timestamp string")
    raw.withColumn("value", F.col("value").cast("string")).write.option("header", True).csv(path)
    packed = medallion.pack(readings.read_delimited(spark, path), "uploaded/CSV")
    numbered = packed.withColumn("row_index", F.monotonically_increasing_id()).withColumn("ts", s.clock_of("timestamp")).withColumn(
        "timestamp", s.canonical_clock("timestamp"))
    counts = boards.zone_counts(boards.observations(numbered, fx.plant_joinable(spark, "-")))
    assert {(r.control, r.alarm, r.trip, r.total) for r in counts.collect()} == {(70, 20, 10, 100)}


def test_historian_insert_can_be_repeated(spark, path):
    rows = spark.range(200).select((F.col("id") % 100).alias("kafka_offset"), F.lit("t").alias("kafka_topic"),
                                   F.floor(F.col("id") / 100).cast("int").alias("kafka_partition"), F.lit("a").alias("tag"))
    for part in (rows.filter("kafka_offset < 60"), rows.filter("kafka_offset > 40"), rows.limit(0), rows):
        sinks.append_historian(part, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 200 == stored.select(*sinks.LOG_POSITION).distinct().count()


def test_records_keep_their_own_position(spark):
    """A log's records: topic, partition and offset come from the record, not from its value."""
    value = json.dumps({"tag": "AT-3401", "value": 7.1, "timestamp": "2026-08-14T10:00:00Z", "offset": 99, "partition": 9})
    row = (bytearray(b"AT-3401"), bytearray(value.encode()), "plant", 2, 17, "2026-08-14 10:00:01", [("content-type", bytearray(b"json"))])
    schema = ("key binary, value binary, topic string, partition int, offset long, timestamp string, "
              "headers array<struct<key:string,value:binary>>")
    records = spark.createDataFrame([row, (None, bytearray(b"not json"), "plant", 2, 18, None, None)], schema)
    got = medallion.from_records(records).orderBy("offset").collect()
    assert (got[0].topic, got[0].partition, got[0].offset, got[0].key) == ("plant", 2, 17, "AT-3401")
    assert got[0].value.value == 7.1 and got[0].headers == {"content-type": "json"}
    assert got[1].offset == 18 and got[1].value.tag is None
    bronze = medallion.bronze(medallion.from_records(records)).collect()
    assert [(r.kafka_topic, r.kafka_partition, r.kafka_offset) for r in bronze] == [("plant", 2, 17), ("plant", 2, 18)]


def test_day_layout_is_pruned(spark, path):
    rows = spark.range(50).select("id", F.concat(F.lit("2026-08-1"), (F.col("id") % 5).cast("string")).alias("dt"))
    sinks.write_days(rows, path)
    one = files.read_lake(spark, path, "2026-08-12", "2026-08-12")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 10 and "PartitionFilters: [isnotnull(dt" in plan
