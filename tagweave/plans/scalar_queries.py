"""Queries of the projections, filters and scalar functions (P)."""

from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import bands, text
from tagweave.functions import scalars as s
from tagweave.operators import boards as bd
from tagweave.operators import dedup, enrich, lookups, medallion
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import query, run_view, table
from tagweave.plans.scan_queries import (BRONZE_SQL, CLOCK, PACK_TOKENS, SILVER_SQL, WIRE_CLOCK, _bronze,
                                         _pack_rows)
from tagweave.schemas import SILVER_COLUMNS
from tagweave.sources import parameters as dims


@query("p01_lenient_number", fx.sql("""
SELECT kafka_offset, CASE WHEN k < 20 THEN value WHEN k < 40 THEN 1100.5 + u WHEN k < 50 THEN NULL WHEN k < 60 THEN NULL
   WHEN k < 70 THEN NULL WHEN k < 75 THEN -value WHEN k < 80 THEN 1000 + CAST(u AS DOUBLE) + 100 ELSE value END AS number FROM floor""", "floor"))
def p01(spark, sf):
    v = F.col("value").cast("string")
    u = (F.col("u") + 100).cast("string")
    raw = (F.when(F.col("k") < 20, F.concat(F.lit(" "), v, F.lit("% ")))
           .when(F.col("k") < 40, F.concat(F.lit("1,"), u, F.lit(".5"))).when(F.col("k") < 50, F.lit("  "))
           .when(F.col("k") < 60, F.concat(v, F.lit("d"))).when(F.col("k") < 70, F.lit("abc"))
           .when(F.col("k") < 75, F.concat(F.lit("-"), v)).when(F.col("k") < 80, F.concat(F.lit("1_"), u)).otherwise(v))
    return fx.floor(spark, sf).select("kafka_offset", s.lenient_number(raw).alias("number"))


@query("p02_canonical_clock", fx.sql(f"""
SELECT kafka_offset, CASE WHEN k < 60 THEN {CLOCK} WHEN k < 75 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
   WHEN k < 90 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE concat('shift ', CAST(u AS VARCHAR)) END AS clock FROM floor""", "floor"))
def p02(spark, sf):
    clock = s.clock_text("ts")
    tee = F.replace(clock, F.lit(" "), F.lit("T"))
    raw = (F.when(F.col("k") < 15, F.concat(tee, F.lit("Z"))).when(F.col("k") < 30, F.concat(tee, F.lit("+05:30")))
           .when(F.col("k") < 45, F.concat(clock, F.lit(".917 UTC"))).when(F.col("k") < 60, F.concat(clock, F.lit("-0800")))
           .when(F.col("k") < 75, F.concat(F.substring(clock, 1, 16), F.lit(" UTC"))).when(F.col("k") < 90, F.substring(clock, 1, 10))
           .otherwise(F.concat(F.lit(" shift  "), F.col("u").cast("string"))))
    return fx.floor(spark, sf).select("kafka_offset", s.canonical_clock(raw).alias("clock"))


@query("p03_canonical_value", fx.sql("""
SELECT kafka_offset, round(value / 7, 4) AS value4, CASE WHEN k < 50 THEN printf('%.4f', round(value, 4)) ELSE 'n/a' END AS text4
FROM floor""", "floor"))
def p03(spark, sf):
    raw = F.when(F.col("k") < 50, F.concat(F.col("value").cast("string"), F.lit(" %"))).otherwise(F.lit(" n/a "))
    return fx.floor(spark, sf).select("kafka_offset", s.canonical_value(F.col("value") / 7).alias("value4"),
                                      s.canonical_value_text(raw).alias("text4"))


@query("p04_alias_resolution", fx.sql(
    "SELECT reading_id, token, CASE WHEN k >= 5 THEN param END AS param FROM t", "plant", "params", t=PACK_TOKENS))
def p04(spark, sf):
    rows = medallion.resolve_parameter(_pack_rows(spark, sf), "tag", "param")
    return rows.select("reading_id", F.col("tag").alias("token"), "param")


@query("p05_key_normalisation", """
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS match_key,
       replace(replace(lower(trim(concat(' ', c_mktsegment, ' No-', CAST(c_nationkey AS VARCHAR)))), ' ', '_'), '-', '_') AS field_key
FROM customer""")
def p05(spark, sf):
    raw = F.concat(F.lit(" "), "c_mktsegment", F.lit(" No-"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", s.match_key("c_name").alias("match_key"),
                                               s.field_key(raw).alias("field_key"))


@query("p06_reading_contract", fx.sql(f"""
SELECT reading_id, row_index, p_tag AS tag, round(value, 3) AS value, 'raw' AS unit, 'GOOD' AS quality, {WIRE_CLOCK} AS "timestamp",
       concat('plant/', p_topic_line, '/', p_asset, '/', p.param) AS uns_topic, 'edge' AS source, p.param, p_asset AS asset,
       p_short AS name FROM plant r JOIN params p ON r.param = p.param""", "plant", "params"))
def p06(spark, sf):
    """Live readings: topic by line, asset and parameter."""
    raw = fx.plant_raw(spark, sf).withColumn("value", F.col("value").cast("string"))
    return medallion.pack(raw, "edge").select("reading_id", "row_index", "tag", "value", "unit", "quality", "timestamp",
                                              "uns_topic", "source", "param", "asset", "name")


@query("p07_file_annotation", fx.sql(f"""
SELECT filename, tag, row_number() OVER (PARTITION BY filename ORDER BY row_index) AS row_index, {WIRE_CLOCK} AS file_ts,
       'raw' AS file_unit, concat('plant/file/', stem, '-', md5(filename), '/', tag) AS uns_topic,
       concat(stem, '-', md5(filename), '-', printf('%04d', row_number() OVER (PARTITION BY filename ORDER BY row_index))) AS reading_id
FROM (SELECT *, concat('line ', u, '.csv') AS filename, concat('line_', u) AS stem FROM plant)""", "plant"))
def p07(spark, sf):
    raw = fx.plant_raw(spark, sf).join(fx.plant(spark, sf).select("reading_id", "u"), "reading_id")
    raw = raw.withColumn("filename", F.concat(F.lit("line "), F.col("u").cast("string"), F.lit(".csv")))
    raw = raw.withColumn("at", F.col("row_index")).withColumn("reading_id", F.lit("")).withColumn(
        "file_tag", F.lit(None).cast("string")).withColumn("file_unit", F.lit("")).withColumn("file_ts", F.lit(""))
    return medallion.annotate_file_rows(raw, [F.col("at")]).select(
        "filename", "tag", "row_index", "file_ts", "file_unit", "uns_topic", "reading_id")


@query("p08_topic_path", fx.sql("""
SELECT reading_id, concat('plant/', p_topic_line, '/', p_asset, '/', p.param) AS live,
       concat('plant/file/', substr(concat('Export_', repeat('x', u), '_', CAST(event_id AS VARCHAR), repeat('y', 40)), 1, 48), '-',
         md5(concat('C:\\in\\Export ', repeat('x', u), '#', CAST(event_id AS VARCHAR), repeat('y', 40), '.csv')), '/', tag) AS file
FROM plant r JOIN params p ON r.param = p.param""", "plant", "params"))
def p08(spark, sf):
    lines = F.coalesce(*[F.when(F.col("p_asset") == a, F.lit(x)) for a, x in fixed.ASSET_TOPIC_LINE.items()])
    rows = fx.plant(spark, sf).join(F.broadcast(dims.parameter_frame(spark)), "param")
    name = F.concat(F.lit("C:\\in\\Export "), F.expr("repeat('x', u)"), F.lit("#"), F.col("event_id").cast("string"),
                    F.lit("y" * 40 + ".csv"))
    return rows.select("reading_id", s.plant_topic(lines, "p_asset", "param").alias("live"), s.file_topic(name, "tag").alias("file"))


@query("p09_silver_conform", fx.sql(SILVER_SQL, "plant", "params", bronze=BRONZE_SQL))
def p09(spark, sf):
    return medallion.silver(_bronze(spark, sf)).select(*SILVER_COLUMNS)


@query("p10_quality_filter", fx.sql("""
SELECT upper(CASE WHEN coalesce(quality, '') = '' THEN 'GOOD' ELSE quality END) AS quality, param, count(*) AS n_rows,
       round(sum(value), 6) AS total FROM floor_good GROUP BY ALL""", "floor_good"))
def p10(spark, sf):
    good = fx.floor(spark, sf).filter(medallion.usable())
    return good.groupBy(medallion.quality_of("quality").alias("quality"), "param").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 6).alias("total"))


@query("p11_catalogue_fill", fx.sql("""
SELECT reading_id, CASE WHEN k < 50 THEN p.param ELSE 'given' END AS param, CASE WHEN k < 70 THEN p_asset ELSE 'A-1' END AS asset,
       p_unit AS unit FROM plant r JOIN params p ON r.param = p.param
UNION ALL SELECT reading_id, '' AS param, '' AS asset, '' AS unit FROM floor""", "plant", "params", "floor"))
def p11(spark, sf):
    """Blank fields from the tag; an unknown tag gives blanks and loses its unit."""
    known = fx.plant(spark, sf).select(
        "reading_id", "tag", F.when(F.col("k") < 50, "").otherwise("given").alias("param"),
        F.when(F.col("k") < 70, F.lit(None)).otherwise("A-1").alias("asset"), F.lit("furlong").alias("unit"))
    unknown = fx.floor(spark, sf).select("reading_id", "tag", F.lit("").alias("param"), F.lit("").alias("asset"),
                                         F.lit("furlong").alias("unit"))
    return medallion.fill_from_catalogue(known.unionByName(unknown)).select("reading_id", "param", "asset", "unit")


@query("p12_gold_projection", fx.sql("""
SELECT tag, value, ts, bronze_offset, 'reading' AS grain, 'contextualize' AS ready_for, 'gold' AS medallion_zone,
       'pending' AS context_status FROM silver""", "plant", "params", bronze=BRONZE_SQL, silver=SILVER_SQL))
def p12(spark, sf):
    return medallion.gold(medallion.silver(_bronze(spark, sf))).select(
        "tag", "value", "ts", "bronze_offset", "grain", "ready_for", "medallion_zone", "context_status")


@query("p13_lake_row_contract", fx.sql(f"""
SELECT tag, CASE WHEN k < 50 THEN value ELSE value + 1 END AS value, CASE WHEN k < 30 THEN '' ELSE {CLOCK} END AS "timestamp",
       CASE WHEN k < 30 THEN NULL ELSE date_trunc('second', ts) END AS ts,
       CASE WHEN k < 10 THEN 'gold-lake' ELSE 'lake' END AS source, reading_id FROM plant""", "plant"))
def p13(spark, sf):
    rows = fx.plant(spark, sf).select(
        "tag", "reading_id", F.when(F.col("k") < 50, F.col("value")).alias("value"), (F.col("value") + 1).alias("val"),
        F.when(F.col("k") >= 60, F.col("ts")).alias("ts"),
        F.when(F.col("k") >= 30, F.concat(s.clock_text("ts"), F.lit("Z"))).alias("ts_raw"),
        F.when(F.col("k") < 10, " ").otherwise("lake").alias("source"))
    return medallion.as_reading(rows).select("tag", "value", "timestamp", "ts", "source", "reading_id")


@query("p14_reading_id", fx.sql(f"""
SELECT event_id, CASE WHEN k < 30 THEN concat('id', CAST(u AS VARCHAR))
   WHEN k < 60 THEN concat('a_rather_long_file_name_', '-', md5(concat('a rather long file name, exported ', u, '.csv')), '-', printf('%04d', event_id // 100))
   ELSE concat('R-', md5(concat(tag, '|', printf('%.4f', value), '|', {CLOCK}))) END AS reading_id FROM plant""", "plant"))
def p14(spark, sf):
    given = F.when(F.col("k") < 30, F.concat(F.lit(" id"), F.col("u").cast("string")))
    number = F.when(F.col("k") < 60, F.floor(F.col("event_id") / 100))
    name = F.concat(F.lit("a rather long file name, exported "), F.col("u").cast("string"), F.lit(".csv"))
    return fx.plant(spark, sf).select("event_id", s.reading_id(
        given, name, number, F.col("tag"), F.col("value"),
        s.clock_text("ts")).alias("reading_id"))


@query("p15_natural_key", fx.sql(
    f"SELECT tag AS key_tag, round(value, 4) AS key_value, {CLOCK} AS key_time, count(*) AS n_rows FROM plant GROUP BY ALL", "plant"))
def p15(spark, sf):
    return dedup.with_natural_key(fx.plant_readings(spark, sf)).groupBy(*dedup.NATURAL_KEY).agg(F.count("*").alias("n_rows"))


@query("p16_observations", fx.sql("""
SELECT reading_id, tag, param, value, p_unit AS unit, p_asset AS asset, upper(quality_text) AS quality, zone AS scenario
FROM (SELECT *, CASE WHEN coalesce(quality, '') = '' THEN 'GOOD' ELSE quality END AS quality_text FROM plant_graded)""", "plant_graded"))
def p16(spark, sf):
    """Every other parameter is named by the tag only or by the row's parameter only."""
    rows = fx.plant_readings(spark, sf)
    by_tag = F.col("param").isin("temp", "press")
    rows = rows.withColumn("tag", F.when(by_tag | (F.col("param") == "hum"), F.col("tag")).otherwise("")).withColumn(
        "param", F.when(by_tag, F.lit(None)).otherwise(F.col("param")))
    unknown = fx.floor_good(spark, sf)
    seen = bd.observations(rows.unionByName(unknown), fx.plant_joinable(spark, sf))
    return seen.select("reading_id", "tag", "param", "value", "unit", "asset", F.upper("quality").alias("quality"), "scenario")


def _graded(spark, sf):
    """Floor readings with their parameter's bands as columns."""
    catalogue = dims.parameter_frame(spark, fx.FLOOR_PARAMETERS)
    return fx.floor_good(spark, sf).join(F.broadcast(catalogue), "param")


def _status():
    return bands.status_of(F.col("value"), F.col("p_control_lo"), F.col("p_control_hi"))


@query("p17_status", fx.sql("SELECT reading_id, status FROM floor_graded", "floor_graded"))
def p17(spark, sf):
    return _graded(spark, sf).select("reading_id", _status().alias("status"))


@query("p18_zone", fx.sql("SELECT reading_id, zone FROM floor_graded", "floor_graded"))
def p18(spark, sf):
    pairs = [(F.col(f"p_{k}_lo"), F.col(f"p_{k}_hi")) for k in bd.ZONES]
    return _graded(spark, sf).select("reading_id", bands.zone_of(F.col("value"), *pairs).alias("zone"))


@query("p19_delta", fx.sql("SELECT reading_id, delta FROM floor_graded", "floor_graded"))
def p19(spark, sf):
    delta = bands.delta_of(_status(), F.col("value"), F.col("p_control_lo"), F.col("p_control_hi"))
    return _graded(spark, sf).select("reading_id", delta.alias("delta"))


@query("p20_band_parser", """
SELECT p_partkey, CASE WHEN p_size % 6 = 5 THEN NULL WHEN p_size % 6 = 3 THEN -CAST(p_size AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS lo,
       CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_retailprice END AS hi FROM part""")
def p20(spark, sf):
    lo, hi, form = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.col("p_size") % 6
    raw = (F.when(form == 0, F.concat_ws(" – ", lo, hi)).when(form == 1, F.concat_ws(",", lo, hi))
           .when(form == 2, F.concat_ws(" ; ", lo, hi)).when(form == 3, F.concat(F.lit("-"), lo, F.lit(" - "), hi))
           .when(form == 4, F.concat_ws("/", lo, hi)).otherwise(F.concat(F.lit("about "), hi)))
    band = bands.parse_band(raw)
    return table(spark, sf, "part").select("p_partkey", band[0].alias("lo"), band[1].alias("hi"))


@query("p21_band_resolution", """
WITH b AS (SELECT s_suppkey AS k, CASE WHEN k % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) ELSE s_nationkey + 1.5::DOUBLE END AS c_lo,
             CASE WHEN k % 2 = 0 THEN abs(s_acctbal) ELSE abs(s_acctbal) + 1.5 END AS c_hi FROM supplier),
 w AS (SELECT *, CASE WHEN c_hi = c_lo THEN CAST(1 AS DOUBLE) ELSE abs(c_hi - c_lo) END AS w FROM b)
SELECT k AS s_suppkey, c_lo, c_hi, CASE WHEN k % 3 = 0 THEN -5::DOUBLE WHEN k % 5 <> 0 THEN -7::DOUBLE ELSE c_lo - w * 0.5 END AS a_lo,
  CASE WHEN k % 3 = 0 THEN 5::DOUBLE WHEN k % 5 <> 0 THEN 7::DOUBLE ELSE c_hi + w * 0.5 END AS a_hi,
  CASE WHEN k % 7 = 0 THEN -9::DOUBLE WHEN k % 4 <> 0 THEN -11::DOUBLE ELSE c_lo - w END AS t_lo,
  CASE WHEN k % 7 = 0 THEN 9::DOUBLE WHEN k % 4 <> 0 THEN 11::DOUBLE ELSE c_hi + w END AS t_hi FROM w""")
def p21(spark, sf):
    """Bands of the asset, else of the parameter, else widened from the control band."""
    k, lo, hi = F.col("s_suppkey"), F.col("s_nationkey").cast("double"), F.abs("s_acctbal")

    def when(given, value):
        return F.when(given, F.lit(value) if isinstance(value, float) else value)

    rows = table(spark, sf, "supplier").select(
        k, when(k % 2 == 0, F.array(lo, hi)).alias("a_control"), when(k % 3 == 0, F.array(F.lit(-5.0), F.lit(5.0))).alias("a_alarm"),
        when(k % 7 == 0, F.array(F.lit(-9.0), F.lit(9.0))).alias("a_trip"), (lo + 1.5).alias("p_control_lo"), (hi + 1.5).alias("p_control_hi"),
        when(k % 5 != 0, -7.0).alias("p_alarm_lo"), when(k % 5 != 0, 7.0).alias("p_alarm_hi"),
        when(k % 4 != 0, -11.0).alias("p_trip_lo"), when(k % 4 != 0, 11.0).alias("p_trip_hi"))
    pairs = dict(zip("cat", bd.resolved_bands()))
    return rows.select("s_suppkey", *[pairs[b][i].alias(f"{b}_{e}") for b in "cat" for i, e in enumerate(("lo", "hi"))])


@query("p22_scenario_value", fx.sql("""
SELECT param, zone, arg_max(value, row_index) AS value, max(row_index) AS row_index FROM plant_graded GROUP BY ALL""", "plant_graded"))
def p22(spark, sf):
    """A value that stands for each zone: the newest reading in it."""
    newest = bd.zone_examples(bd.observations(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf)))
    return newest.select("param", F.col("scenario").alias("zone"), "value", "row_index")


@query("p23_flat_events", fx.sql(f"SELECT {fx.FLAT_SQL} FROM plant_flat", "plant_flat"))
def p23(spark, sf):
    return fx.comparable(enrich.flatten(fx.plant_events(spark, sf)))


@query("p24_merged_view", fx.sql("""
SELECT tag, status, asset, line, batch, product, operator_shift, time_match, material_no, spec_source, calibration_age_days,
       'reference' AS origin, reading_id FROM plant_flat""", "plant_flat"))
def p24(spark, sf):
    merged = enrich.merged_view(fx.plant_events(spark, sf))
    return merged.select("tag", "status", "asset_model.asset", "asset_model.line", "mes.batch", "mes.product",
                         "mes.operator_shift", "mes.time_match", "sap.material_no", "sap.spec_source",
                         F.col("rdbms.calibration_age_days").cast("long").alias("calibration_age_days"),
                         F.col("rdbms.origin").alias("origin"), "event.reading_id")


@query("p25_source_normalisers", fx.sql("""
SELECT 'asset' AS kind, tag AS "key", concat(asset, '|', param, '|', tag, '|', line) AS body FROM floor_assets
UNION ALL SELECT 'mes', asset, concat(batch, '|', product, '|', start_ts, '|', shift) FROM floor_batches
UNION ALL SELECT 'sap', CAST(p_partkey AS VARCHAR), concat(p_brand, '|', p_type) FROM part
UNION ALL SELECT 'rdbms', tag, concat(CAST(calibration_age_days AS VARCHAR), '|', lab_note_ref) FROM floor_calibrations""",
                                    "floor_assets", "floor_batches", "floor_calibrations"))
def p25(spark, sf):
    """The four normalisers on tables with other headers, padding and blank keys."""
    assets = run_view(spark, sf, fx.FLOOR_ASSETS, "events").select(F.col("tag").alias("file_tag"), "asset", "param", "line")
    batches = run_view(spark, sf, fx.FLOOR_BATCHES, "events").select(
        F.concat(F.lit(" "), "asset").alias("equipment"), F.col("batch").alias("lot_no"), F.lit(" ").alias("batch"),
        F.col("product").alias("sku"), "start_ts", "end_ts", F.col("shift").alias("crew"), "seq")
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product"),
                                            F.col("p_brand").alias("material"), F.col("p_type").alias("family"))
    parts = parts.unionByName(parts.withColumn("product", F.lit("  ")))
    ages = run_view(spark, sf, fx.FLOOR_CALIBRATIONS, "events").withColumn(
        "calibration_age_days", F.concat(F.col("calibration_age_days").cast("string"), F.lit(".0"))).withColumnRenamed(
        "lab_note_ref", "lab_note")

    def body(df, kind, key, *cols):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"),
                         F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("body"))

    return (body(lookups.normalise_assets(assets, fx.FLOOR_PARAMETERS).withColumn("name", F.col("tag")),
                 "asset", "tag", "asset", "parameter", "name", "line")
            .unionByName(body(lookups.normalise_batches(batches), "mes", "asset", "batch", "product", "start", "operator_shift"))
            .unionByName(body(lookups.normalise_materials(parts), "sap", "product", "material_no", "family"))
            .unionByName(body(lookups.normalise_calibrations(ages), "rdbms", "tag", "calibration_age_days", "lab_note_ref")))


def _scores_sql():
    """Score per kind of a table named by a text, with the text's words as its columns."""
    out = []
    for kind, words in fixed.TABLE_NAME_WORDS.items():
        named = " OR ".join(f"contains(name, '{w}')" for w in words)
        columns = ", ".join(f"'{c}'" for c in fixed.TABLE_COLUMNS[kind])
        out.append(f"(CASE WHEN {named} THEN 6 ELSE 0 END + len(list_intersect(columns, [{columns}])))")
    return "[" + ", ".join(out) + "]"


@query("p26_table_classifier", f"""
WITH t AS (SELECT doc_id, lower(text) AS name, list_transform(string_split(concat(text, ' unit ', source, ' tag'), ' '), lambda c: replace(replace(lower(trim(c)), ' ', '_'), '-', '_')) AS columns FROM documents),
 s AS (SELECT doc_id, {_scores_sql()} AS scores FROM t)
SELECT doc_id, CASE WHEN list_max(scores) >= 2 THEN {list(fixed.TABLE_NAME_WORDS)}[list_position(scores, list_max(scores))] ELSE 'other' END AS kind,
       CAST(list_max(scores) AS BIGINT) AS score FROM s""")
def p26(spark, sf):
    """Tables named by a whole document, with its words as columns."""
    words = F.split(F.concat("text", F.lit(" unit "), "source", F.lit(" tag")), " ")
    tables = table(spark, sf, "documents").select("doc_id", F.col("text").alias("filename"), words.alias("columns"))
    return lookups.classify_tables(tables).select("doc_id", "kind", "score")


def _type_sql(name):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({name}, '{w}')" for w in words) + f" THEN '{kind}'"
                              for kind, words in fixed.DOCUMENT_TYPES) + " ELSE 'OTHER' END"


@query("p27_document_classifier", f"""
SELECT doc_id, {_type_sql('lower(text)')} AS by_name, CASE WHEN source IN ('src1', 'src2') THEN upper(source) WHEN source = 'src3' THEN 'MASTER_INDEX'
  ELSE {_type_sql('lower(text)')} END AS by_kind FROM documents""")
def p27(spark, sf):
    """The whole text stands for the file name; some sources state a kind."""
    kind = F.when(F.col("source").isin("src1", "src2"), F.col("source")).when(F.col("source") == "src3", "Master-Index").when(
        F.col("source") == "src4", "Auto").otherwise("")
    return table(spark, sf, "documents").select("doc_id", text.document_type("text").alias("by_name"),
                                                text.document_type("text", kind).alias("by_kind"))


@query("p28_slug", """
WITH f AS (SELECT c_custkey, concat(c_mktsegment, ' (', CAST(c_nationkey AS VARCHAR), ').', CASE WHEN c_acctbal < 5000 THEN 'csv' ELSE 'tsv' END) AS filename FROM customer),
 n AS (SELECT lower(filename) AS name, min(c_custkey) AS first FROM f GROUP BY 1),
 g AS (SELECT *, trim(regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first, name) AS i FROM g)
SELECT c_custkey, filename, CASE WHEN i = 1 THEN slug ELSE concat(slug, '_', CAST(i AS VARCHAR)) END AS slot FROM f JOIN r ON lower(filename) = name""")
def p28(spark, sf):
    c = table(spark, sf, "customer")
    name = F.concat("c_mktsegment", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")."),
                    F.when(F.col("c_acctbal") < 5000, "csv").otherwise("tsv"))
    return lookups.unique_slots(c.select("c_custkey", name.alias("filename")), "c_custkey").select("c_custkey", "filename", "slot")


def _guess_sql():
    """The score of every parameter in a text, written the long way."""
    words = f"string_split(trim(regexp_replace(low, '{text.SPACE}+', ' ', 'g')), ' ')"
    scores = ", ".join(
        f"CASE WHEN contains(low, '{p.short.lower()}') OR contains(low, '{p.name.lower()}') THEN 2 ELSE 0 END + CASE WHEN contains(low, '{p.tag.lower()}') THEN 2 ELSE 0 END"
        f" + CASE WHEN list_contains({words}, '{p.param}') THEN 1 ELSE 0 END" for p in sorted(dims.BUILT_IN, key=lambda p: p.param, reverse=True))
    names = sorted((p.param for p in dims.BUILT_IN), reverse=True)
    return f"SELECT doc_id, [{scores}] AS scores, {names} AS names FROM t"


@query("p29_parameter_guess", f"""
WITH t AS (SELECT doc_id, lower(concat(text, CASE lang WHEN 'en' THEN ' The reactor temperature, TT-1202B, and the pressure.'
   WHEN 'fr' THEN ' Pressure against conductivity here.' WHEN 'de' THEN ' temp hum ' ELSE '' END)) AS low FROM documents), s AS ({_guess_sql()})
SELECT doc_id, CASE WHEN list_max(scores) > 0 THEN names[list_position(scores, list_max(scores))] END AS param FROM s""")
def p29(spark, sf):
    """Whole documents, most with a sentence that names a parameter; ties go to the greater id."""
    words = (F.when(F.col("lang") == "en", " The reactor temperature, TT-1202B, and the pressure.")
             .when(F.col("lang") == "fr", " Pressure against conductivity here.").when(F.col("lang") == "de", " temp hum ").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", text.guess_parameter(F.concat("text", words), dims.BUILT_IN).alias("param"))


@query("p30_driver_slice", fx.sql("SELECT reading_id, drivers FROM plant_graded", "plant_graded"))
def p30(spark, sf):
    return fx.plant_events(spark, sf).select("reading_id", F.array_join("drivers", " ").alias("drivers"))


@query("p31_chart_intent", """
SELECT conv_id, turn, role = 'user' AND regexp_matches(lower(concat(text, ' Plot it')), 'chart|distribution|histogram|bar graph|plot|severity|how many trip|how many alarm')
   OR role <> 'user' AND regexp_matches(lower(text), 'chart|distribution|histogram|bar graph|plot|severity|how many trip|how many alarm') AS chart
FROM conversations""")
def p31(spark, sf):
    asked = F.when(F.col("role") == "user", F.concat("text", F.lit(" Plot it"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.wants_chart(asked).alias("chart"))


@query("p32_parameter_filter", fx.sql("""
SELECT 'one' AS kind, param, count(*) AS n_rows FROM plant WHERE param = 'press' GROUP BY ALL
UNION ALL SELECT 'all', param, count(*) FROM plant GROUP BY ALL
UNION ALL SELECT 'present', param, 1 FROM (SELECT DISTINCT param FROM plant WHERE value > 90)""", "plant"))
def p32(spark, sf):
    rows = fx.plant_readings(spark, sf)

    def counted(kind, df):
        return df.groupBy(F.lit(kind).alias("kind"), "param").agg(F.count("*").alias("n_rows"))

    present = dedup.present_parameters(rows.filter("value > 90"), dims.parameter_frame(spark))
    return (counted("one", dedup.of_parameter(rows, "press", "PT-2201"))
            .unionByName(counted("all", dedup.of_parameter(rows, "all")))
            .unionByName(present.select(F.lit("present").alias("kind"), "param", F.lit(1).cast("long").alias("n_rows"))))
