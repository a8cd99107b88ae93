"""Queries of the sources and sinks (S, K)."""

from pyspark.sql import functions as F

from tagweave.functions import scalars as s
from tagweave.operators import medallion, versions
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import query, table
from tagweave.schemas import BRONZE_COLUMNS, GOLD_COLUMNS, SILVER_COLUMNS
from tagweave.sources import files, readings, sinks
from tagweave.sources import parameters as dims
from tagweave.streaming import jobs

WIRE_CLOCK = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
CLOCK = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("s01_delimited_scan", fx.sql(
    f"SELECT reading_id, tag, value, 'raw' AS unit, {WIRE_CLOCK} AS \"timestamp\" FROM plant WHERE k >= 3", "plant"))
def s01(spark, sf):
    """Semicolon files with quoted cells; rows with a blank tag are dropped."""
    path = fx.scratch(spark, "delimited")
    rows = fx.plant_raw(spark, sf).join(fx.plant(spark, sf).select("reading_id", "k"), "reading_id")
    (rows.select("reading_id", F.when(F.col("k") >= 3, F.col("tag")).alias("Tag"), F.col("value").alias("Value"),
                 F.col("unit").alias("Unit"), F.col("timestamp").alias("Time"))
     .withColumnRenamed("reading_id", "Reading ID").write.option("header", True).option("sep", ";").csv(path))
    got = readings.read_delimited(spark, path)
    return got.select("reading_id", "tag", s.lenient_number("value").alias("value"), "unit", "timestamp")


@query("s02_json_scan", fx.sql(
    f"SELECT reading_id, tag, value, {WIRE_CLOCK} AS \"timestamp\" FROM plant", "plant"))
def s02(spark, sf):
    """One JSON document per 500 readings, under the key ``readings``."""
    path = fx.scratch(spark, "json")
    raw = fx.plant_raw(spark, sf).withColumn("doc", F.floor(F.col("row_index") / 500))
    docs = raw.groupBy("doc").agg(F.to_json(F.struct(F.collect_list(
        F.struct("reading_id", "tag", "value", "timestamp")).alias("readings"))).alias("value"))
    docs.repartition("doc").write.partitionBy("doc").text(path)
    got = readings.read_json(spark, path + "/*")
    return got.select("reading_id", "tag", F.col("value").cast("double").alias("value"), "timestamp")


PACK_TOKENS = """
SELECT reading_id, row_index, k, ts,
       CASE WHEN k < 5 THEN 'nothing known' WHEN k < 30 THEN upper(p_short) WHEN k < 60 THEN p.param ELSE p.p_tag END AS token,
       CASE WHEN k >= 95 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS text_value, value, p.param, p_short, p_unit,
       p_asset, p_topic_line
FROM plant r JOIN params p ON r.param = p.param"""


def _pack_rows(spark, sf):
    """Readings whose tag is a tag, an id or a name, some unknown, some without a number."""
    names = dims.parameter_frame(spark).select("param", "p_short", "p_tag")
    rows = fx.plant(spark, sf).join(F.broadcast(names), "param")
    token = (F.when(F.col("k") < 5, "nothing known").when(F.col("k") < 30, F.upper("p_short"))
             .when(F.col("k") < 60, F.col("param")).otherwise(F.col("p_tag")))
    value = F.when(F.col("k") >= 95, "abc").otherwise(F.col("value").cast("string"))
    return rows.select("reading_id", "row_index", token.alias("tag"), value.alias("value"), F.lit("").alias("unit"),
                       s.clock_text("ts").alias("timestamp"), F.lit("floor.csv").alias("filename"))


@query("s03_inline_rows", fx.sql(f"""
SELECT reading_id, row_index, token AS tag, round(value, 3) AS value, p_unit AS unit, 'GOOD' AS quality, {CLOCK} AS "timestamp",
       concat('plant/file/floor-', md5('floor.csv'), '/', token) AS uns_topic, 'uploaded/CSV' AS source, param, p_asset AS asset, p_short AS name,
       token AS file_tag FROM t WHERE k >= 5 AND k < 95""", "plant", "params", t=PACK_TOKENS))
def s03(spark, sf):
    packed = medallion.pack(_pack_rows(spark, sf), "uploaded/CSV")
    return packed.select("reading_id", "row_index", "tag", "value", "unit", "quality", "timestamp", "uns_topic", "source",
                         "param", "asset", "name", "file_tag")


@query("s04_header_detection", fx.sql(
    f"SELECT tag, value, {WIRE_CLOCK} AS \"timestamp\" FROM plant", "plant"))
def s04(spark, sf):
    """One folder of files with three title lines before the header, files with another
    delimiter and none, and wide files."""
    path = fx.scratch(spark, "mixed")
    raw = fx.plant_raw(spark, sf).join(fx.plant(spark, sf).select("reading_id", "k"), "reading_id")
    raw = raw.withColumn("part", F.floor(F.col("row_index") / 2000))
    titled = raw.filter("k < 40")
    body = titled.select("part", (F.col("row_index") + 4).alias("line"),
                         F.concat_ws(",", "tag", F.col("value").cast("string"), "timestamp").alias("value"))
    titles = F.array(F.concat(F.lit("Export "), F.col("part").cast("string")), F.lit("Plant 1"),
                     F.lit("Shift B, night"), F.lit("tag,value,timestamp"))
    heads = titled.select("part").distinct().select("part", F.posexplode(titles).alias("line", "value"))
    lines = heads.withColumn("line", F.col("line").cast("long")).unionByName(body)
    (lines.repartition("part").sortWithinPartitions("part", "line").select("part", "value")
     .write.partitionBy("part").text(f"{path}/titled"))
    (raw.filter("k >= 40 AND k < 70").select(F.col("timestamp").alias("Time"), F.col("tag").alias("Tag"), F.col("value").alias("Reading"))
     .write.option("header", True).option("sep", ";").csv(f"{path}/semicolon"))
    tags = [F.when(F.col("tag") == p.tag, F.col("value")).alias(p.tag) for p in dims.BUILT_IN]
    raw.filter("k >= 70").select("timestamp", *tags).write.option("header", True).option("sep", "\t").csv(f"{path}/wide")
    got = readings.read_delimited(spark, path)
    return got.select("tag", s.lenient_number("value").alias("value"), "timestamp")


@query("s05_wide_to_long", fx.sql("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "timestamp", tag, max(value) AS value
FROM plant GROUP BY 1, 2""", "plant"))
def s05(spark, sf):
    """Hours by one column per tag, written wide and read back long."""
    path = fx.scratch(spark, "wide")
    hour = F.concat(F.substring(s.clock_text("ts"), 1, 13), F.lit(":00:00"))
    wide = fx.plant(spark, sf).groupBy(hour.alias("Date Time")).pivot(
        "tag", [p.tag for p in dims.BUILT_IN]).agg(F.max("value"))
    wide.write.option("header", True).csv(path)
    got = readings.read_delimited(spark, path)
    return got.select("timestamp", "tag", s.lenient_number("value").alias("value"))


@query("s06_lookup_table_scan", """
SELECT CAST(s_suppkey AS VARCHAR) AS supplier_key, s_name AS supplier_name, CAST(s_acctbal AS VARCHAR) AS acct_bal FROM supplier""")
def s06(spark, sf):
    """Headers with spaces, hyphens and capitals; rows without content are dropped."""
    path = fx.scratch(spark, "lookup")
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("Supplier Key"), F.concat(F.lit(" "), "s_name").alias("Supplier-Name"),
        F.col("s_acctbal").cast("string").alias("ACCT BAL"))
    empty = rows.select(*[F.lit(" ").alias(c) for c in rows.columns])
    rows.unionByName(empty).write.option("header", True).csv(path)
    return files.read_lookup_table(spark, path)


@query("s07_lake_scan", fx.sql(f"""
SELECT strftime(ts, '%Y-%m-%d') AS dt, tag, count(*) AS n_rows, round(sum(value), 6) AS total
FROM plant WHERE ts >= TIMESTAMP '2026-08-20' AND ts < TIMESTAMP '2026-08-25' GROUP BY 1, 2""", "plant"))
def s07(spark, sf):
    """Five days of a Bronze table; the other days are pruned by folder."""
    path = sinks.land_bronze(fx.plant_envelopes(spark, sf), fx.scratch(spark, "lake"))
    rows = files.read_lake(spark, path, "2026-08-20", "2026-08-24")
    return rows.groupBy(F.col("dt").cast("string").alias("dt"), "tag").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 6).alias("total"))


@query("s08_event_log_stream", fx.sql(f"""
SELECT row_index AS "offset", CAST(pos % 3 AS BIGINT) AS "partition", tag AS "key", value, r.param, {WIRE_CLOCK} AS "timestamp"
FROM plant r JOIN params p ON r.param = p.param""", "plant", "params"))
def s08(spark, sf):
    """Envelopes read back from log files as a stream."""
    log = sinks.write_log_files(fx.plant_envelopes(spark, sf), fx.scratch(spark, "log"))
    out, checkpoint = fx.scratch(spark, "log-out"), fx.scratch(spark, "log-cp")
    stream = jobs.log_stream(spark, log).select(
        "offset", F.col("partition").cast("long").alias("partition"), "key", "value.value", "value.param", "value.timestamp")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


def _document_files(spark, sf):
    """All documents in one text file per source, in order of their ids."""
    path = fx.scratch(spark, "texts")
    docs = table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return path


def _source():
    return F.regexp_extract("path", "source=([^/]+)", 1)


@query("s09_text_documents", """
SELECT source, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS digest, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def s09(spark, sf):
    """Text files, read whole."""
    got = files.read_documents(spark, _document_files(spark, sf))
    return got.select(_source().alias("source"), F.md5(F.regexp_replace("text", "\n$", "")).alias("digest"),
                      F.length("text").cast("long").alias("chars"))


@query("s10_file_profile", """
WITH f AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN '%PDF-1.7 ' WHEN 'fr' THEN 'GIF89a' ELSE '' END AS head,
  CASE lang WHEN 'en' THEN 'bin' WHEN 'de' THEN 'csv' WHEN 'es' THEN 'md' ELSE 'dat' END AS ext, text FROM documents)
SELECT concat('doc', CAST(doc_id AS VARCHAR), '.', ext) AS filename, ext AS extension,
  CASE lang WHEN 'en' THEN 'application/pdf' WHEN 'fr' THEN 'image/gif' WHEN 'de' THEN 'text/csv'
       WHEN 'es' THEN 'text/markdown' ELSE 'application/octet-stream' END AS content_type,
  CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'image' ELSE 'file' END AS file_kind,
  strlen(concat(head, text)) AS size_bytes FROM f""")
def s10(spark, sf):
    """Type by leading bytes, then extension."""
    docs = table(spark, sf, "documents")
    head = F.when(F.col("lang") == "en", "%PDF-1.7 ").when(F.col("lang") == "fr", "GIF89a").otherwise("")
    ext = F.when(F.col("lang") == "en", "BIN").when(F.col("lang") == "de", "CSV").when(F.col("lang") == "es", "md").otherwise("dat")
    content = F.concat(head, F.col("text")).cast("binary")
    rows = docs.select(F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
                       content.alias("content"), F.octet_length(content).cast("long").alias("length"))
    got = files.file_profile(rows)
    return got.withColumn("filename", F.concat(s.stem("filename"), F.lit("."), "extension"))


@query("s11_file_inventory", """
SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, TRUE AS preferred FROM documents GROUP BY 1""")
def s11(spark, sf):
    """Files on disk with size, preferred prefix first; content is not read."""
    listing = files.inventory(files.scan_files(spark, _document_files(spark, sf)), prefix="PART-")
    return listing.select(_source().alias("source"), "bytes", "preferred")


@query("s12_parameter_dimension", fx.sql("""
SELECT p.param, p_name AS name, p_unit AS unit, c_lo, c_hi, a_lo, a_hi, t_lo, t_hi, drivers, count(*) AS n_rows
FROM plant r JOIN params p ON r.param = p.param GROUP BY ALL""", "plant", "params"))
def s12(spark, sf):
    """Every reading against the parameter catalogue."""
    rows = fx.plant(spark, sf).join(F.broadcast(dims.parameter_frame(spark)), "param")
    bands = [F.col(f"p_{k}_{e}").alias(f"{k[0]}_{e}") for k in ("control", "alarm", "trip") for e in ("lo", "hi")]
    return rows.groupBy("param", F.col("p_name").alias("name"), F.col("p_unit").alias("unit"), *bands,
                        F.array_join(F.slice("p_drivers", 1, 3), " ").alias("drivers")).agg(F.count("*").alias("n_rows"))


BRONZE_SQL = f"""
SELECT row_index AS kafka_offset, 'scada.telemetry' AS kafka_topic, CAST(pos % 3 AS INTEGER) AS kafka_partition,
       tag, value, 'raw' AS unit, {WIRE_CLOCK} AS ts_raw,
       CASE WHEN coalesce(quality, '') = '' THEN 'GOOD' ELSE quality END AS quality, r.param, p_asset AS asset, '' AS name,
       concat('plant/', r.param) AS uns_topic, 'wire' AS source, '' AS filename, 'bronze' AS medallion_zone,
       strftime(ts, '%Y-%m-%d') AS dt, ts, p_unit
FROM plant r JOIN params p ON r.param = p.param"""
BRONZE_LIST = ", ".join(BRONZE_COLUMNS)
SILVER_SQL = """
SELECT tag, param, asset, value, p_unit AS unit, date_trunc('second', ts) AS ts, upper(quality) AS quality, uns_topic, source,
       kafka_offset AS bronze_offset, 'silver' AS medallion_zone, 1 AS schema_version
FROM bronze WHERE upper(quality) <> 'BAD'"""


def _bronze(spark, sf):
    return medallion.bronze(fx.plant_envelopes(spark, sf))


@query("k01_bronze_landing", fx.sql(f"SELECT {BRONZE_LIST}, dt FROM bronze", "plant", "params", bronze=BRONZE_SQL))
def k01(spark, sf):
    path = sinks.land_bronze(fx.plant_envelopes(spark, sf), fx.scratch(spark, "bronze"))
    return spark.read.parquet(path).select(*BRONZE_COLUMNS, F.col("dt").cast("string").alias("dt"))


@query("k02_silver_write", fx.sql(SILVER_SQL, "plant", "params", bronze=BRONZE_SQL))
def k02(spark, sf):
    path = sinks.write_silver(_bronze(spark, sf), fx.scratch(spark, "silver"))
    return spark.read.parquet(path).select(*SILVER_COLUMNS)


@query("k03_gold_write", fx.sql("""
SELECT tag, param, asset, value, unit, ts, quality, uns_topic, source, bronze_offset, 'reading' AS grain,
       'contextualize' AS ready_for, 'gold' AS medallion_zone, 'pending' AS context_status FROM silver""",
                                "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def k03(spark, sf):
    path = sinks.write_gold(medallion.silver(_bronze(spark, sf)), fx.scratch(spark, "gold"))
    return spark.read.parquet(path).select(*GOLD_COLUMNS)


@query("k04_idempotent_historian", fx.sql("""
SELECT kafka_partition, kafka_offset, tag, value, ts_raw FROM bronze
UNION ALL SELECT kafka_partition + 3, kafka_offset, tag, value, ts_raw FROM bronze""", "plant", "params", bronze=BRONZE_SQL))
def k04(spark, sf):
    """Two batches, the second doubled, and once more; the same offsets occur in other partitions.

    Every position of the log is stored once.
    """
    path = fx.scratch(spark, "historian")
    rows = _bronze(spark, sf)
    again = rows.withColumn("kafka_partition", F.col("kafka_partition") + fx.LOG_PARTITIONS)
    sinks.append_historian(rows.filter(F.col("param") == "temp"), path)
    sinks.append_historian(rows.unionByName(rows).unionByName(again), path)
    sinks.append_historian(again.unionByName(rows), path)
    return spark.read.parquet(path).select("kafka_partition", "kafka_offset", "tag", "value", "ts_raw")


@query("k05_event_append", fx.sql(
    "SELECT param, zone, status, 'gold' AS medallion_zone, count(*) AS n_rows FROM plant_flat GROUP BY ALL", "plant_flat"))
def k05(spark, sf):
    path = fx.scratch(spark, "events")
    sinks.append_events(fx.plant_events(spark, sf).drop("lookup_origin"), path)
    return spark.read.parquet(path).groupBy("param", "zone", "status", "medallion_zone").agg(F.count("*").alias("n_rows"))


@query("k06_envelope_producer", fx.sql(f"""
SELECT row_index AS "offset", CAST(pos % 3 AS BIGINT) AS "partition", 'scada.telemetry' AS topic, tag AS "key", r.param,
       p_asset AS asset, reading_id, 'application/json' AS content_type,
       CASE WHEN coalesce(quality, '') = '' THEN 'GOOD' ELSE quality END AS quality, {WIRE_CLOCK} AS "timestamp"
FROM plant r JOIN params p ON r.param = p.param""", "plant", "params"))
def k06(spark, sf):
    """Envelopes as log records, and back through the columns in which a log's reader gives them."""
    records = medallion.log_records(fx.plant_envelopes(spark, sf), "topic", "partition", "offset", "timestamp")
    got = medallion.from_records(records)
    return got.select("offset", F.col("partition").cast("long").alias("partition"), "topic", "key", "value.param", "value.asset",
                      "value.reading_id", F.col("headers")["content-type"].alias("content_type"), "value.quality", "timestamp")


def datasets(spark, sf):
    """Orders as saved versions: the customer is the slot, the order number the version."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("dataset_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slot"),
                    F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("saved_at"),
                    (F.col("o_orderstatus") != "P").alias("persisted"))


def dataset_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").cast("long").alias("seq"),
                     F.col("l_partkey").alias("part"), F.col("l_quantity").alias("value"))


@query("k07_save_version", """
SELECT o_orderkey AS dataset_id, concat('c', CAST(o_custkey AS VARCHAR)) AS slot,
       o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_active FROM orders""")
def k07(spark, sf):
    """Finished versions, then the pending ones appended; the newest of a slot is active."""
    all_versions, rows = datasets(spark, sf), dataset_rows(spark, sf)
    saved, _ = versions.add_version(all_versions.filter("persisted"), rows.limit(0),
                                    all_versions.filter(~F.col("persisted")), rows)
    return versions.with_active_flag(saved).select("dataset_id", "slot", "is_active")


@query("k08_load_active", """
WITH a AS (SELECT o_custkey, max(o_orderkey) AS id FROM orders GROUP BY 1)
SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS slot, id AS dataset_id, CAST(l_linenumber AS BIGINT) AS seq,
       l_partkey AS part, l_quantity AS value FROM a JOIN lineitem ON l_orderkey = id""")
def k08(spark, sf):
    return versions.load_active(datasets(spark, sf), dataset_rows(spark, sf)).select(
        "slot", "dataset_id", "seq", "part", "value")


@query("k09_delete_slot", """
WITH d AS (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS slot, count(*) AS deleted_datasets, CAST(sum(coalesce(n, 0)) AS BIGINT) AS deleted_readings
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM d) GROUP BY 1""")
def k09(spark, sf):
    """Delete the slots of one market segment and report what went."""
    slots = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slot"))
    return versions.delete_slot(datasets(spark, sf), dataset_rows(spark, sf), slots)[2]


@query("k09_delete_all", """
SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS slot, count(*) AS deleted_datasets, CAST(sum(coalesce(n, 0)) AS BIGINT) AS deleted_readings,
       CAST(0 AS BIGINT) AS kept
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def k09_all(spark, sf):
    """Delete every slot; nothing is kept."""
    kept, kept_rows, counts = versions.delete_slot(datasets(spark, sf), dataset_rows(spark, sf))
    left = kept.agg(F.count("*").alias("n")).unionAll(kept_rows.agg(F.count("*"))).agg(F.sum("n")).scalar()
    return counts.withColumn("kept", left)


@query("k10_board_export", fx.sql("""
SELECT reading_id, "timestamp", param, CAST(value AS VARCHAR) AS value, spec, CAST(delta AS VARCHAR) AS delta, batch,
       mes_window, lab_note_ref, zone AS board FROM plant_flat WHERE zone <> 'control'""", "plant_flat"))
def k10(spark, sf):
    """The excursion export, one folder per zone, read back."""
    path = fx.scratch(spark, "export")
    rows = fx.plant_events(spark, sf).filter(F.col("zone") != "control")
    sinks.export_board(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.select("reading_id", "timestamp", "param", "value", "spec", "delta", "batch", "mes_window",
                       "lab_note_ref", "board")


@query("k11_upsert_latest", """
SELECT concat('u', CAST(user_id AS VARCHAR)) AS "key", arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1""")
def k11(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "event_type", "value",
        F.col("event_id").alias("updated_at"))
    return versions.upsert_latest(rows)


@query("k12_lake_export", fx.sql("""
SELECT tag, CAST(value AS VARCHAR) AS value, unit, strftime(ts, '%Y-%m-%d') AS day, CAST(bronze_offset AS VARCHAR) AS bronze_offset
FROM silver""", "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def k12(spark, sf):
    lake = sinks.write_silver(_bronze(spark, sf), fx.scratch(spark, "silver"))
    path = sinks.export_table(spark, lake, fx.scratch(spark, "silver-csv"))
    return spark.read.option("header", True).csv(path).select(
        "tag", "value", "unit", F.substring("ts", 1, 10).alias("day"), "bronze_offset")


@query("k13_append_turns", """
SELECT row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) AS id, concat('agent-', CAST(conv_id AS VARCHAR)) AS agent, role AS source,
       text AS query, concat('[{"ref":"', role, '"}]') AS hits FROM conversations""")
def k13(spark, sf):
    """Two appends; the second goes on after the first."""
    order = [F.col("conv_id"), F.col("turn")]
    path = fx.scratch(spark, "turns")
    for part in (0, 1):
        new = versions.append_turns(turns(spark, sf).filter(F.col("conv_id") % 2 == part), order, sinks.existing(spark, path))
        new.write.mode("append").parquet(path)
    return spark.read.parquet(path).select("id", "agent", "source", "query", "hits")


def turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit("agent-"), F.col("conv_id").cast("string")).alias("agent"),
                    F.col("role").alias("source"), F.col("text").alias("query"), F.col("text").alias("answer"),
                    F.array(F.struct(F.col("role").alias("ref"))).alias("hits"))

