"""Queries of the joins, windows, aggregations, orders and unions (J, W, A, T, U1) and boards."""

from pyspark.sql import functions as F

from tagweave.functions import scalars as s
from tagweave.operators import audit as au
from tagweave.operators import boards as bd
from tagweave.operators import dedup, enrich, lookups, medallion, versions
from tagweave.operators.sizing import lookup_join, numbered
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import query, run_view, table
from tagweave.plans.scan_queries import (BRONZE_SQL, CLOCK, PACK_TOKENS, SILVER_SQL, WIRE_CLOCK, _bronze, _pack_rows,
                                         dataset_rows, datasets, turns)
from tagweave.sources import parameters as dims

# ---------------------------------------------------------------- joins


@query("j01_asset_join", fx.sql("""
SELECT reading_id, r.tag, a.asset, a.line FROM floor_good r LEFT JOIN floor_assets a ON r.tag = a.tag""",
                                "floor_good", "floor_assets"))
def j01(spark, sf):
    rows = enrich.join_assets(fx.floor_good(spark, sf), fx.floor_joinable(spark, sf))
    return rows.select("reading_id", "tag", F.col("a_asset").alias("asset"), F.col("a_line").alias("line"))


@query("j02_batch_temporal_join", fx.sql("""
SELECT reading_id, asset, batch, product, phase, start_ts, end_ts, shift, time_match FROM floor_placed WHERE asset IS NOT NULL""",
                                         "floor_placed"))
def j02(spark, sf):
    lk = fx.floor_joinable(spark, sf)
    rows = enrich.join_batches(enrich.join_assets(fx.floor_good(spark, sf), lk), lk).filter("a_asset is not null")
    return rows.select("reading_id", F.col("a_asset").alias("asset"), "batch", "product", "phase",
                       F.col("start").alias("start_ts"), F.col("end").alias("end_ts"),
                       F.col("operator_shift").alias("shift"), "time_match")


@query("j03_material_join", fx.sql("""
SELECT reading_id, r.product, material_no, family, grade FROM floor_placed r LEFT JOIN floor_materials m ON r.product = m.product""",
                                   "floor_placed", "floor_materials"))
def j03(spark, sf):
    lk = fx.floor_joinable(spark, sf)
    rows = enrich.join_materials(enrich.join_batches(enrich.join_assets(fx.floor_good(spark, sf), lk), lk), lk)
    return rows.select("reading_id", "product", "material_no", "family", "grade")


@query("j04_calibration_join", fx.sql("""
SELECT reading_id, r.tag, CAST(calibration_age_days AS BIGINT) AS calibration_age_days, lab_note_ref
FROM floor_good r LEFT JOIN floor_calibrations c ON r.tag = c.tag""", "floor_good", "floor_calibrations"))
def j04(spark, sf):
    rows = enrich.join_calibrations(fx.floor_good(spark, sf), fx.floor_joinable(spark, sf))
    return rows.select("reading_id", "tag", F.col("calibration_age_days").cast("long").alias("calibration_age_days"), "lab_note_ref")


def floor_enriched(spark, sf):
    return enrich.enrich(fx.floor_good(spark, sf), fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS)


@query("j05_enrichment_chain", fx.sql(f"""
SELECT reading_id, {CLOCK} AS "timestamp", r.param, r.tag, value, p_unit AS unit, status, zone, delta, asset, line, batch,
       r.product, phase, shift AS operator_shift, concat(start_ts, ' → ', end_ts) AS mes_window, material_no, grade,
       CAST(calibration_age_days AS BIGINT) AS calibration_age_days, time_match
FROM floor_placed r LEFT JOIN floor_materials m ON r.product = m.product LEFT JOIN floor_calibrations c ON r.tag = c.tag
WHERE reason IS NULL""", "floor_placed", "floor_materials", "floor_calibrations"))
def j05(spark, sf):
    """The whole chain on 100 tags: overlaps, gaps, missing products, calibrations and batches."""
    events = enrich.events_of(floor_enriched(spark, sf))
    return events.select(
        "reading_id", "timestamp", "param", "tag", "value", "unit", "status", "zone", "delta", "asset", "line", "batch",
        "product", "phase", "operator_shift", "mes_window", "material_no", "grade",
        F.col("calibration_age_days").cast("long").alias("calibration_age_days"), "time_match")


@query("j05_scale_enrichment", """
WITH b AS (SELECT p_brand, min(p_type) AS product FROM part GROUP BY 1)
SELECT concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR)) AS reading_id, CAST(l_partkey AS VARCHAR) AS tag, l_quantity AS value,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "timestamp", p.p_brand AS asset, p_type AS line, b.product,
  CASE WHEN l_quantity > 45 THEN 'OVER' WHEN l_quantity < 5 THEN 'UNDER' ELSE 'OK' END AS status,
  CASE WHEN l_quantity BETWEEN 5 AND 45 THEN 'control' WHEN l_quantity > 2 AND l_quantity < 48 THEN 'alarm' ELSE 'trip' END AS zone,
  concat(p.p_brand, '-', CAST(CASE WHEN inside THEN year(l_shipdate) ELSE (SELECT min(year(l_shipdate)) FROM lineitem) END AS VARCHAR)) AS batch,
  CASE WHEN inside THEN 'in-window' ELSE 'outside-window' END AS time_match
FROM (SELECT *, l_shipdate BETWEEN make_timestamp(year(l_shipdate), 1, 15, 0, 0, 0) AND make_timestamp(year(l_shipdate), 12, 15, 0, 0, 0) AS inside FROM lineitem)
JOIN part p ON l_partkey = p_partkey JOIN b ON b.p_brand = p.p_brand""")
def j05_scale(spark, sf):
    """The chain over line items, whose asset table grows with the data."""
    events = enrich.events_of(enrich.enrich(fx.scale_readings(spark, sf), fx.scale_lookups(spark, sf), fx.SCALE_PARAMETERS))
    return events.select("reading_id", "tag", "value", "timestamp", "asset", "line", "product", "status", "zone", "batch", "time_match")


@query("j06_reject_stream", fx.sql(f"""
SELECT reading_id, tag, {CLOCK} AS "timestamp", reason FROM floor_placed WHERE reason IS NOT NULL
UNION ALL SELECT concat('N-', CAST(kafka_offset AS VARCHAR)), CASE WHEN k < 50 THEN '' ELSE tag END, {CLOCK},
  CASE WHEN k < 50 THEN 'reading has no tag' ELSE concat('tag ', tag, ' has no numeric value') END FROM floor""", "floor_placed"))
def j06(spark, sf):
    """Rejects of the floor, and of the same readings without tag or value."""
    rows = fx.floor(spark, sf)
    broken = rows.select(F.concat(F.lit("N-"), F.col("kafka_offset").cast("string")).alias("reading_id"), "row_index",
                         F.when(F.col("k") < 50, "").otherwise(F.col("tag")).alias("tag"), "param",
                         F.when(F.col("k") < 50, F.col("value")).alias("value"), "ts", "quality", s.clock_text("ts").alias("timestamp"))
    everything = fx.floor_good(spark, sf).unionByName(broken)
    full = enrich.enrich(everything, fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS)
    return enrich.rejects_of(full)


def _overridden(spark):
    """Uploads for two of five tags and one of their assets; the rest is built in."""
    assets = spark.createDataFrame([("TT-1202B", "BR-99", "L9", "36 - 39"), ("AT-3401", "BR-12", "", ""),
                                    ("TT-1202B", "BR-00", "late copy", "1 - 2")],
                                   "tag string, asset string, line string, control string")
    batches = spark.createDataFrame([("BR-99", "U-1", "Own", "2026-08-20 00:00", "2026-08-25 23:59:59", 1),
                                     ("FIL-07", "", "", "2026-08-14", "2026-08-15", 2),
                                     ("CR-A1", "", "Mine", "", "", 3)],
                                    "asset string, batch string, product string, start string, end string, seq long")
    return lookups.build_lookups(spark, assets=assets, batches=batches)


@query("j07_source_fallback", fx.sql("""
SELECT reading_id, tag, CASE WHEN param = 'temp' THEN 'BR-99' ELSE p_asset END AS asset,
       CASE WHEN param IN ('temp', 'ph') THEN 'upload' ELSE 'reference' END AS asset_origin,
       CASE WHEN param IN ('temp', 'press', 'hum') THEN 'upload' ELSE 'reference' END AS mes_origin,
       CASE WHEN param = 'temp' THEN CASE WHEN value > 39 THEN 'OVER' WHEN value < 36 THEN 'UNDER' ELSE 'OK' END ELSE status END AS status,
       zone FROM plant_graded""", "plant_graded"))
def j07(spark, sf):
    """Status follows the uploaded band, the zone the parameter's own; they may disagree."""
    events = enrich.events_of(enrich.enrich(fx.plant_readings(spark, sf), _overridden(spark)))
    return events.select("reading_id", "tag", "asset", F.col("lookup_origin.asset").alias("asset_origin"),
                         F.col("lookup_origin.mes").alias("mes_origin"), "status", "zone")


@query("j08_blank_batch_fill", fx.sql("""
SELECT reading_id, CASE param WHEN 'temp' THEN 'U-1' WHEN 'ph' THEN 'OMZ-114' WHEN 'press' THEN 'NIS-208' WHEN 'cond' THEN 'WFI-DAILY' ELSE 'MIN-051' END AS batch,
       CASE param WHEN 'temp' THEN 'Own' WHEN 'ph' THEN 'Omez' WHEN 'press' THEN 'Nise' WHEN 'cond' THEN 'WFI' ELSE 'Mine' END AS product,
       CASE WHEN param = 'hum' THEN 'uploaded' WHEN date_trunc('second', ts) BETWEEN lo AND hi THEN 'in-window' ELSE 'outside-window' END AS time_match
FROM (SELECT *, CASE param WHEN 'temp' THEN TIMESTAMP '2026-08-20 00:00:00' WHEN 'ph' THEN TIMESTAMP '2026-08-13 06:00:00' WHEN 'press' THEN TIMESTAMP '2026-08-14 00:00:00' ELSE TIMESTAMP '2026-08-13 00:00:00' END AS lo,
      CASE param WHEN 'temp' THEN TIMESTAMP '2026-08-25 23:59:59' WHEN 'ph' THEN TIMESTAMP '2026-08-13 18:00:00' WHEN 'press' THEN TIMESTAMP '2026-08-15 00:00:00' ELSE TIMESTAMP '2026-08-13 23:59:00' END AS hi FROM plant)""", "plant"))
def j08(spark, sf):
    """Uploaded rows without a batch take the built-in batch, and its product if they have none."""
    events = enrich.events_of(enrich.enrich(fx.plant_readings(spark, sf), _overridden(spark)))
    return events.select("reading_id", "batch", "product", "time_match")


def _catalogue(spark, sf):
    """Saved versions with their row counts; the arrival order is the version number."""
    rows = dataset_rows(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("row_count"))
    return datasets(spark, sf).join(rows, "dataset_id").withColumn("seq", F.col("dataset_id"))


@query("j09_active_source", """
WITH d AS (SELECT o_orderkey, o_orderpriority AS kind, o_orderstatus <> 'P' AS persisted FROM orders
           WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 a AS (SELECT kind, arg_max(o_orderkey, o_orderkey + CASE WHEN persisted THEN 1000000000000 ELSE 0 END) AS id FROM d GROUP BY 1)
SELECT kind, id AS dataset_id, l_partkey AS part, l_quantity AS value FROM a JOIN lineitem ON l_orderkey = id""")
def j09(spark, sf):
    """Per kind one version: saved before unsaved, then the newest; joined to its rows."""
    chosen = lookups.active_dataset(_catalogue(spark, sf)).select("dataset_id", "kind")
    return lookup_join(dataset_rows(spark, sf), chosen, "dataset_id", "inner").select("kind", "dataset_id", "part", "value")


@query("j10_decompose_sql", fx.sql("""
SELECT r.reading_id, r.value, a.asset, m.batch, s.material_no FROM floor r JOIN floor_assets a ON r.tag = a.tag
JOIN floor_batches m ON a.asset = m.asset AND r.ts BETWEEN CAST(m.start_ts AS TIMESTAMP) AND CAST(m.end_ts AS TIMESTAMP)
JOIN floor_materials s ON m.product = s.product""", "floor", "floor_assets", "floor_batches", "floor_materials"))
def j10(spark, sf):
    batches = run_view(spark, sf, fx.FLOOR_BATCHES, "events").withColumn(
        "start", F.col("start_ts").cast("timestamp_ntz")).withColumn("end", F.col("end_ts").cast("timestamp_ntz"))
    return enrich.decompose_join(fx.floor(spark, sf), run_view(spark, sf, fx.FLOOR_ASSETS, "events"), batches,
                                 spark.sql(fx.FLOOR_MATERIALS))


@query("j11_enrichment_trace", fx.sql("""
SELECT reading_id, unnest(CASE WHEN reason IS NULL THEN ['A', 'B.1', 'B.2', 'B.3', 'B.4', 'C', 'D']
   WHEN asset IS NULL THEN ['A'] ELSE ['A', 'B.1'] END) AS step,
   unnest(CASE WHEN reason IS NULL THEN [ts_text, asset, concat(batch, ' / ', product), material_no, CAST(calibration_age_days AS VARCHAR),
     concat(status, ' / ', zone), reading_id] WHEN asset IS NULL THEN [ts_text] ELSE [ts_text, asset] END) AS key_out
FROM (SELECT r.*, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, material_no, calibration_age_days FROM floor_placed r
      LEFT JOIN floor_materials m ON r.product = m.product LEFT JOIN floor_calibrations c ON r.tag = c.tag)""",
                                      "floor_placed", "floor_materials", "floor_calibrations"))
def j11(spark, sf):
    steps = enrich.trace(floor_enriched(spark, sf)).select("reading_id", F.inline("trace"))
    return steps.select("reading_id", "step", "key_out")


# ---------------------------------------------------------------- windows


def _gold(spark, sf):
    return medallion.gold(medallion.silver(_bronze(spark, sf)))


@query("w01_latest_by_time", fx.sql("""
SELECT tag, param, asset, value, unit, ts, quality, bronze_offset FROM silver
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY ts DESC NULLS LAST, bronze_offset DESC) = 1""",
                                    "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def w01(spark, sf):
    return medallion.latest_by_time(_gold(spark, sf))


def _three_sources(spark, sf):
    """Every plant reading from the floor file, again from the stream, again from the lake."""
    rows = fx.plant_readings(spark, sf)

    def copy(rank, prefix):
        return rows.withColumn("source_rank", F.lit(rank)).withColumn("source", F.lit(prefix)).withColumn(
            "reading_id", F.regexp_replace("reading_id", "^E", prefix))

    return copy(2, "L").unionByName(copy(1, "S")).unionByName(copy(0, "F"))


@query("w02_keep_first_reading", fx.sql("""
SELECT concat('F-', CAST(event_id AS VARCHAR)) AS reading_id, tag, value, 'F' AS source FROM plant
QUALIFY row_number() OVER (PARTITION BY tag, round(value, 4), date_trunc('second', ts) ORDER BY row_index) = 1""", "plant"))
def w02(spark, sf):
    kept = dedup.keep_first_reading(_three_sources(spark, sf), [F.col("source_rank"), F.col("row_index")])
    return kept.select("reading_id", "tag", "value", "source")


@query("w03_keep_first_id", fx.sql("""
SELECT concat(tag, '/', CAST(k AS VARCHAR)) AS reading_id, kafka_offset, asset, status FROM floor_placed WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY tag, k ORDER BY kafka_offset) = 1""", "floor_placed"))
def w03(spark, sf):
    """Ids that repeat: the first enriched event of each id stays; rejected copies take no id."""
    rows = fx.floor_good(spark, sf).join(fx.floor(spark, sf).select("reading_id", "k"), "reading_id")
    rows = rows.withColumn("reading_id", F.concat_ws("/", "tag", F.col("k").cast("string"))).drop("k")
    full = enrich.enrich(rows, fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS)
    kept = dedup.keep_first_id(enrich.events_of(full), [F.col("row_index")])
    return kept.select("reading_id", F.col("row_index").alias("kafka_offset"), "asset", "status")


@query("w04_first_match_per_key", """
SELECT p_brand AS tag, arg_min(p_type, p_partkey) AS asset, min(p_partkey) AS seq FROM part GROUP BY 1""")
def w04(spark, sf):
    """A lookup with many rows per key answers with the first in file order."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("asset"),
                                            F.col("p_partkey").alias("seq"))
    return lookups.first_match(parts, "tag")


@query("w05_sequence_assignment", """
SELECT event_id, 8400 + row_number() OVER (ORDER BY ts, event_id) AS "offset",
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_index FROM events""")
def w05(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "event_type")
    order = [F.col("ts"), F.col("event_id")]
    ranked = numbered(numbered(rows, order, start=8401, out="offset"), order, group=["event_type"], out="row_index")
    return ranked.select("event_id", "offset", "row_index")


def audit_source(spark, sf):
    """Events as audit entries, one chain per user."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("chain"), s.clock_text("ts").alias("ts"),
                    F.lit("system").alias("actor"), F.col("event_type").alias("action"), F.col("props").alias("payload"), "event_id")


AUDIT_SEGMENT = 16
AUDIT_SQL = f"""
SELECT CAST(user_id AS VARCHAR) AS chain, CAST((s - 1) // {AUDIT_SEGMENT} AS BIGINT) AS segment, s AS seq, event_type AS action,
       to_json([CAST(s AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S'), 'system', event_type, props])::VARCHAR AS body
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)"""
AUDIT_FOLD_SQL = """
SELECT chain, segment, unnest(seqs) AS seq, unnest(range(1, len(seqs) + 1)) AS i, bodies FROM (
  SELECT chain, segment, list(seq ORDER BY seq) AS seqs, list(body ORDER BY seq) AS bodies FROM e GROUP BY 1, 2)"""
AUDIT_HASH_SQL = f"""
SELECT chain, segment, seq,
       list_reduce(list_prepend(sha256(concat('{'0' * 64}', chain, '#', segment)), bodies[1:i - 1]), lambda h, b: sha256(concat(h, b))) AS prev_hash,
       list_reduce(list_prepend(sha256(concat('{'0' * 64}', chain, '#', segment)), bodies[1:i]), lambda h, b: sha256(concat(h, b))) AS hash FROM f"""


def audit_log(spark, sf):
    return au.append(audit_source(spark, sf), [F.col("event_id")], AUDIT_SEGMENT)


@query("w06_audit_link_check", fx.sql("SELECT chain, seq, prev_hash, hash, TRUE AS ok FROM h",
                                      e=AUDIT_SQL, f=AUDIT_FOLD_SQL, h=AUDIT_HASH_SQL))
def w06(spark, sf):
    checked = au.check_links(audit_log(spark, sf), AUDIT_SEGMENT)
    return checked.select("chain", "seq", "prev_hash", "hash", (F.col("hash_ok") & F.col("link_ok")).alias("ok"))


@query("w07_replay_schedule", fx.sql("""
SELECT row_number() OVER (PARTITION BY param ORDER BY ts, row_index) - 1 AS tick, param, reading_id, value FROM plant""", "plant"))
def w07(spark, sf):
    """The order in which the stored readings of a parameter are to be played."""
    return dedup.replay_order(fx.plant_readings(spark, sf), [F.col("ts"), F.col("row_index")]).select("tick", "param", "reading_id", "value")


# ---------------------------------------------------------------- aggregations


def _first_readings(spark, sf):
    seen = bd.observations(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf))
    return dedup.keep_first_reading(seen, [F.col("row_index")])


COUNTS_SQL = """
SELECT p.param, p.p_tag AS tag, p.p_short AS short, p.p_unit AS unit, count(CASE WHEN zone = 'control' THEN 1 END) AS control,
       count(CASE WHEN zone = 'alarm' THEN 1 END) AS alarm, count(CASE WHEN zone = 'trip' THEN 1 END) AS trip, count(zone) AS total
FROM params p LEFT JOIN plant_first r ON r.param = p.param GROUP BY ALL"""


@query("a01_zone_counts", fx.sql(COUNTS_SQL, "plant_first"))
def a01(spark, sf):
    return bd.zone_counts(_first_readings(spark, sf))


EVENTS = "SELECT *, row_index AS seq FROM plant_flat"


@query("a02_status_counts", fx.sql("""
SELECT count(CASE status WHEN 'OK' THEN 1 END) AS ok, count(CASE status WHEN 'OVER' THEN 1 END) AS "over",
       count(CASE status WHEN 'UNDER' THEN 1 END) AS "under", count(*) AS total_events FROM n""", "plant_flat", n=EVENTS))
def a02(spark, sf):
    return bd.status_counts(fx.plant_events(spark, sf))


@query("a03_dashboard", fx.sql("""
SELECT p.param, p_name AS name, p_unit AS unit, p_asset AS asset, c_lo AS spec_lo, c_hi AS spec_hi, arg_max(value, seq) AS value,
       coalesce(arg_max(status, seq), '—') AS status, arg_max(batch, seq) AS batch, arg_max(product, seq) AS product,
       arg_max(zone, seq) AS zone, count(CASE WHEN status <> 'OK' THEN 1 END) AS excursions
FROM params p LEFT JOIN n ON n.param = p.param GROUP BY ALL""", "params", "plant_flat", n=EVENTS))
def a03(spark, sf):
    return bd.dashboard(fx.plant_events(spark, sf))


@query("a04_zone_table_counts", fx.sql("""
SELECT 'silver' AS lake, count(*) AS n_rows, count(DISTINCT tag) AS n_tags FROM silver
UNION ALL SELECT 'bronze', count(*), count(DISTINCT tag) FROM bronze""", "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def a04(spark, sf):
    rows = _bronze(spark, sf)
    return medallion.zone_counts(medallion.silver(rows)).withColumn("lake", F.lit("silver")).unionByName(
        medallion.zone_counts(rows).withColumn("lake", F.lit("bronze")))


@query("a05_file_catalogue", fx.sql(f"""
SELECT u, param, count(*) AS n_rows, min(tag) AS tag, 'raw' AS unit, concat('plant/', param) AS topic,
       arg_min(value, row_index) AS first_value, arg_max(value, row_index) AS last_value,
       arg_min({WIRE_CLOCK}, row_index) AS first_ts, arg_max({WIRE_CLOCK}, row_index) AS last_ts FROM plant GROUP BY ALL""", "plant"))
def a05(spark, sf):
    """Per file (the events of a user group) and parameter."""
    raw = fx.plant_raw(spark, sf).join(fx.plant(spark, sf).select("reading_id", "u"), "reading_id")
    raw = raw.withColumn("file_unit", F.lit("")).withColumn("file_ts", F.lit(None).cast("string")).withColumn("file_tag", F.col("tag"))
    return bd.file_catalogue(raw, ["u", "param"])


@query("a06_rows_per_parameter", fx.sql("""
SELECT p.param, count(CASE WHEN value > 90 THEN 1 END) AS n_rows FROM params p LEFT JOIN plant r ON r.param = p.param GROUP BY ALL""",
                                        "plant", "params"))
def a06(spark, sf):
    """Parameters without any row above 90 show 0."""
    return bd.rows_per_parameter(fx.plant(spark, sf).filter("value > 90"))


@query("a07_store_statistics", fx.sql("""
SELECT 'historian' AS store, count(*) AS n_rows, max(kafka_offset) AS latest_offset FROM bronze
UNION ALL SELECT 'gold_lake', count(*), max(bronze_offset) FROM silver
UNION ALL SELECT 'gold', count(*), NULL FROM plant_flat""", "plant", "params", "plant_flat", bronze=BRONZE_SQL, silver=SILVER_SQL))
def a07(spark, sf):
    rows = _bronze(spark, sf)
    return medallion.store_statistics(historian=rows, gold_lake=medallion.gold(medallion.silver(rows)),
                                      gold=fx.plant_events(spark, sf))


@query("a08_parse_report", fx.sql("""
SELECT unnest(['raw', 'kept', 'skipped']) AS item, NULL AS tag,
       unnest([count(*), count(CASE WHEN k >= 5 AND k < 95 THEN 1 END), count(CASE WHEN k < 5 OR k >= 95 THEN 1 END)]) AS n_rows, NULL AS first_at FROM t
UNION ALL SELECT 'unknown', concat('tag ', CAST(u AS VARCHAR)), count(*), min(row_index) FROM plant WHERE k < 5 GROUP BY u""", "plant", "params", t=PACK_TOKENS))
def a08(spark, sf):
    """Twenty different unknown tags, each with its rows and where it came first."""
    rows = _pack_rows(spark, sf).join(fx.plant(spark, sf).select("reading_id", "u"), "reading_id")
    tag = F.when(F.col("tag") == "nothing known", F.concat(F.lit("tag "), F.col("u").cast("string"))).otherwise(F.col("tag"))
    return medallion.parse_report(rows.withColumn("tag", tag))


@query("a10_chart_series", fx.sql("""
SELECT param AS agent, unnest(['Trip', 'Alarm', 'In-spec']) AS label, unnest([trip, alarm, control]) AS value FROM c
UNION ALL SELECT 'escalation', short, trip + alarm FROM c""", "plant_first", c=COUNTS_SQL))
def a10(spark, sf):
    return bd.chart_series(bd.zone_counts(_first_readings(spark, sf)))


@query("a11_latest_by_arrival", fx.sql("""
SELECT tag, value, bronze_offset, (SELECT count(*) FROM silver) AS n_rows FROM silver
QUALIFY row_number() OVER (PARTITION BY tag ORDER BY bronze_offset DESC) = 1""", "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def a11(spark, sf):
    gold = _gold(spark, sf)
    newest = medallion.latest_by_arrival(gold)
    return newest.select("tag", "value", "bronze_offset", gold.agg(F.count("*")).scalar().alias("n_rows"))


@query("a12_lake_mapping", fx.sql("""
SELECT count(CASE WHEN reason IS NULL THEN 1 END) AS mapped, count(reason) AS failed, count(*) AS tags, (SELECT count(*) FROM floor_placed) AS lake_rows
FROM (SELECT * FROM floor_placed QUALIFY row_number() OVER (PARTITION BY tag ORDER BY kafka_offset DESC) = 1)""", "floor_placed"))
def a12(spark, sf):
    lake = fx.floor_good(spark, sf).withColumn("bronze_offset", F.col("row_index"))
    return bd.lake_mapping(lake, fx.floor_joinable(spark, sf), fx.FLOOR_PARAMETERS)["summary"]


@query("a14_distinct_keys", fx.sql("SELECT DISTINCT tag FROM floor ORDER BY tag", "floor"))
def a14(spark, sf):
    return bd.distinct_keys(fx.floor(spark, sf))


@query("a15_retention", fx.sql("""
SELECT kafka_partition, kafka_offset, tag, value, ts_raw FROM bronze WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM plant) - 14""",
                               "plant", "params", bronze=BRONZE_SQL))
def a15(spark, sf):
    """What a store keeps that holds the last fourteen days."""
    kept = bd.retained(_bronze(spark, sf), F.col("ts_raw").try_cast("timestamp_ntz"), 14)
    return kept.select("kafka_partition", "kafka_offset", "tag", "value", "ts_raw")


CATALOGUE_SQL = """
SELECT slot, kind, o_orderkey AS dataset_id, persisted, coalesce(n, 0) AS n_rows, CAST(coalesce(b, 0) AS BIGINT) AS n_bytes,
       CASE WHEN n IS NULL THEN '' WHEN returned > 0 THEN 'part, returned' ELSE 'part' END AS columns, coalesce(n, 0) > 0 AS loaded
FROM (SELECT *, o_orderstatus <> 'P' AS persisted FROM (SELECT *, o_orderpriority AS kind, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority ELSE concat('c', CAST(o_custkey AS VARCHAR)) END AS slot FROM orders)
      QUALIFY row_number() OVER (PARTITION BY slot ORDER BY o_orderkey DESC) = 1)
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(length(CAST(l_partkey AS VARCHAR)) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS b,
                  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("a16_source_catalogue", CATALOGUE_SQL)
def a16(spark, sf):
    """Every fifth customer's datasets have no slot and go under their kind; returned items have a second column."""
    data = datasets(spark, sf).withColumn("slot", F.when(F.substring("slot", 2, 20).cast("long") % 5 != 0, F.col("slot")))
    items = table(spark, sf, "lineitem")
    part = F.create_map(F.lit("part"), F.col("l_partkey").cast("string"))
    both = F.map_concat(part, F.create_map(F.lit("returned"), F.col("l_returnflag")))
    rows = items.select(F.col("l_orderkey").alias("dataset_id"), F.when(F.col("l_returnflag") == "R", both).otherwise(part).alias("payload"))
    return bd.source_catalogue(data, rows)


@query("a16_source_totals", f"""
SELECT count(CASE WHEN persisted THEN 1 END) AS saved_count, count(CASE WHEN loaded THEN 1 END) AS loaded_count FROM ({CATALOGUE_SQL})""")
def a16_totals(spark, sf):
    return bd.catalogue_totals(a16(spark, sf))


# ---------------------------------------------------------------- orders and limits


@query("t01_excursion_order", fx.sql("""
SELECT param, "timestamp", reading_id, row_number() OVER (ORDER BY param, "timestamp", reading_id) AS place FROM plant_flat
WHERE zone <> 'control'""", "plant_flat"))
def t01(spark, sf):
    """The board in its order; the place is assigned after sorting."""
    events = fx.plant_events(spark, sf).filter("zone <> 'control'").select("param", "timestamp", "reading_id")
    order = [F.coalesce(s.text(c), F.lit("")) for c in ("param", "timestamp", "reading_id")]
    return numbered(bd.board_order(events), order, out="place")


@query("t02_newest_historian_rows", fx.sql("""
SELECT kafka_partition, kafka_offset, tag, value FROM bronze
ORDER BY date_trunc('second', ts) DESC NULLS LAST, kafka_topic DESC, kafka_partition DESC, kafka_offset DESC LIMIT 50""", "plant", "params", bronze=BRONZE_SQL))
def t02(spark, sf):
    return bd.newest_log_rows(_bronze(spark, sf), 50).select("kafka_partition", "kafka_offset", "tag", "value")


@query("t03_newest_gold_events", fx.sql("""
(SELECT 'all' AS kind, reading_id, param FROM plant_flat ORDER BY row_index DESC LIMIT 50)
UNION ALL (SELECT 'press', reading_id, param FROM plant_flat WHERE param = 'press' ORDER BY row_index DESC LIMIT 50)""", "plant_flat"))
def t03(spark, sf):
    events = fx.plant_events(spark, sf)
    return (bd.newest_events(events, 50).select(F.lit("all").alias("kind"), "reading_id", "param")
            .unionByName(bd.newest_events(events, 50, "press").select(F.lit("press").alias("kind"), "reading_id", "param")))


@query("t04_newest_excursions", fx.sql("""
SELECT reading_id, status, zone, delta FROM n WHERE status <> 'OK' ORDER BY seq DESC LIMIT 10""", "plant_flat", n=EVENTS))
def t04(spark, sf):
    return bd.newest_excursions(fx.plant_events(spark, sf)).select("reading_id", "status", "zone", "delta")


@query("t06_newest_versions_turns", """
(SELECT 'version' AS kind, CAST(o_orderkey AS VARCHAR) AS name FROM orders ORDER BY o_orderkey DESC LIMIT 10)
UNION ALL SELECT 'turn', concat(CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) FROM
 (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 3""")
def t06(spark, sf):
    """Ten newest versions; the three newest turns of every agent."""
    newest = versions.newest_versions(datasets(spark, sf), 10).select(
        F.lit("version").alias("kind"), F.col("dataset_id").cast("string").alias("name"))
    kept = versions.newest_turns(turns(spark, sf).withColumn("id", F.col("turn")), 3)
    return newest.unionByName(kept.select(F.lit("turn").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("name")))


@query("t06_newest_audit_entries", """
SELECT CAST(user_id AS VARCHAR) AS chain, s AS seq, event_type AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, CAST(user_id AS VARCHAR) DESC, s DESC LIMIT 30""")
def t06_audit(spark, sf):
    return au.newest_entries(audit_log(spark, sf), 30).select("chain", "seq", "action")


# ---------------------------------------------------------------- unions and boards


@query("u01_priority_union", fx.sql("""
SELECT param AS asked, concat(CASE param WHEN 'temp' THEN 'F' WHEN 'press' THEN 'S' ELSE 'L' END, '-', CAST(row_index AS VARCHAR)) AS reading_id,
       value FROM plant_first""", "plant_first"))
def u01(spark, sf):
    """The file holds temp, the stream temp and press; the other parameters are only in the lake."""
    rows = _three_sources(spark, sf).drop("source_rank")

    def of(source, *params):
        return rows.filter((F.col("source") == source) & (F.col("param").isin(*params) if params else F.lit(True)))

    floor_rows, stream_rows, lake_rows = of("F", "temp"), of("S", "temp", "press"), of("L")
    out = None
    for p in dims.BUILT_IN:
        got = dedup.priority_union(floor_rows, stream_rows, lake_rows, param=p.param, tag=p.tag)
        got = got.select(F.lit(p.param).alias("asked"), "reading_id", "value")
        out = got if out is None else out.unionByName(got)
    return out


@query("d01_observation_run", fx.sql("""
SELECT reading_id, param, value, zone AS scenario, status, batch, time_match FROM plant_flat SEMI JOIN plant_first USING (row_index)
WHERE param = 'press' AND zone = 'trip'""", "plant_flat", "plant_first"))
def d01(spark, sf):
    run = bd.observation_run(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf), "press", "trip", [F.col("row_index")])
    return run["events"].select("reading_id", "param", "value", "scenario", "status", "batch", "time_match")


@query("d01_all_observation_runs", fx.sql("""
SELECT reading_id, param, value, zone AS scenario, status, batch, time_match FROM plant_flat SEMI JOIN plant_first USING (row_index)""",
                                          "plant_flat", "plant_first"))
def d01_all(spark, sf):
    run = bd.all_observation_runs(_three_sources(spark, sf), fx.plant_joinable(spark, sf),
                                  [F.col("source_rank"), F.col("row_index")], zones=bd.ZONES)
    events = run["events"].withColumn("reading_id", F.regexp_replace("reading_id", "^F", "E"))
    return events.select("reading_id", "param", "value", "scenario", "status", "batch", "time_match")


@query("d02_excursion_board", fx.sql(f"""
SELECT {fx.FLAT_SQL}, zone AS scenario FROM plant_flat SEMI JOIN plant_first USING (row_index) WHERE zone <> 'control'""",
                                     "plant_flat", "plant_first"))
def d02(spark, sf):
    """Trip and alarm events of three overlapping sources."""
    board = bd.excursion_board(_three_sources(spark, sf), fx.plant_joinable(spark, sf), [F.col("source_rank"), F.col("row_index")])
    events = board["events"].withColumn("reading_id", F.regexp_replace("reading_id", "^F", "E"))
    return fx.comparable(events)


@query("d02_board_totals", fx.sql("""
SELECT count(CASE zone WHEN 'trip' THEN 1 END) AS trip, count(CASE zone WHEN 'alarm' THEN 1 END) AS alarm, count(*) AS total
FROM plant_first WHERE zone <> 'control'""", "plant_first"))
def d02_totals(spark, sf):
    board = bd.excursion_board(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf), [F.col("row_index")])
    return bd.board_totals(board["events"])


SCENARIO_SQL = "SELECT * FROM plant_flat QUALIFY row_number() OVER (PARTITION BY param, zone ORDER BY row_index DESC) = 1"


@query("d03_scenario_run", fx.sql("SELECT reading_id, param, zone, \"timestamp\", value, status, batch FROM s", "plant_flat", s=SCENARIO_SQL))
def d03(spark, sf):
    """The newest reading of every parameter and zone, in context."""
    events = bd.scenario_events(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf))
    return events.select("reading_id", "param", "zone", "timestamp", "value", "status", "batch")


@query("d04_parameter_board", fx.sql("""
SELECT reading_id, param, zone AS scenario, zone, value, status, FALSE AS fallback FROM f WHERE zone <> 'control'
UNION ALL SELECT l.reading_id, p.param, z.zone, l.zone, l.value, l.status, TRUE FROM params p CROSS JOIN (VALUES ('alarm'), ('trip')) z(zone)
JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY param ORDER BY row_index DESC) = 1) l ON l.param = p.param
WHERE (p.param, z.zone) NOT IN (SELECT (param, zone) FROM f)""", "plant_flat", "plant_first", "params",
                                     f="SELECT * FROM plant_flat SEMI JOIN plant_first USING (row_index)"))
def d04(spark, sf):
    """All excursions; a parameter without one in a zone would show its newest reading there."""
    board = bd.parameter_board(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf), [F.col("row_index")])
    return board.select("reading_id", "param", "scenario", "zone", "value", "status", "fallback")


@query("d05_decompose_reading", fx.sql("""
SELECT reading_id, tag, value, asset, batch, material_no FROM plant_flat WHERE reading_id =
 (SELECT arg_max(reading_id, row_index) FROM plant_first WHERE param = 'cond' AND zone = 'alarm')""", "plant_flat", "plant_first"))
def d05(spark, sf):
    """The newest conductivity alarm, looked up by its id."""
    readings, lk, order = fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf), [F.col("row_index")]
    run = bd.observation_run(readings, lk, "cond", "alarm", order)
    newest = run["observations"].filter("scenario = 'alarm'").agg(F.max_by("reading_id", "row_index")).first()[0]
    got = bd.decompose(readings, lk, "cond", "alarm", newest or "", order)
    return got.select("reading_id", "tag", "value", "asset", "batch", "material_no")


