"""Views over the supplied tables, and their SQL for the twin queries.

Two plants are derived from ``events``. ``floor`` has 100 tags, its own five parameters
and uploaded lookup tables that leave some readings unmatched. ``plant`` carries the five
built-in parameters and tags, so the built-in lookup tables, passages and remedies apply.
The SQL of a view is the same text for Spark and for the twin where both can run it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.operators import enrich, lookups, medallion
from tagweave.plans.registry import run_view, table
from tagweave.session import scratch_path
from tagweave.sources import parameters as dims
from tagweave.sources.parameters import Parameter

FLOOR_PARAMETERS = (
    Parameter("click", "Click rate", "Click", "c", "click", "", (5.0, 70.0), (2.0, 140.0), (1.0, 230.0), []),
    Parameter("error", "Error rate", "Error", "e", "error", "", (5.0, 60.0), (2.5, 145.0), (1.0, 240.0), []),
    Parameter("purchase", "Purchase rate", "Purchase", "p", "purchase", "", (4.0, 65.0), (2.0, 140.0), (1.0, 225.0), []),
    Parameter("signup", "Signup rate", "Signup", "s", "signup", "", (6.0, 75.0), (2.5, 150.0), (1.0, 235.0), []),
    Parameter("view", "View rate", "View", "v", "view", "", (5.0, 68.0), (3.0, 145.0), (1.5, 210.0), []),
)

# ---------------------------------------------------------------- floor: 100 tags

EVENTS_K = """
SELECT event_id, ts, user_id, event_type, value, props,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(user_id % 20 AS INT) AS u
FROM {events}
"""

FLOOR = f"""
SELECT event_id AS kafka_offset, event_id AS row_index,
       concat('E-', CAST(event_id AS STRING)) AS reading_id,
       concat(event_type, '-', CAST(u AS STRING)) AS tag, event_type AS param,
       concat('AS-', CAST(u AS STRING)) AS asset_hint, u, k, value, ts,
       CASE WHEN k < 5 THEN 'BAD' WHEN k < 10 THEN '' WHEN k < 15 THEN 'bad'
            WHEN k < 20 THEN NULL ELSE 'good' END AS quality
FROM ({EVENTS_K}) e
"""

# The asset table lacks AS-7, the batch table lacks AS-19: their readings are rejected.
FLOOR_ASSETS = f"""
SELECT tag, max(asset_hint) AS asset, max(param) AS param, concat('Line ', CAST(max(u) AS STRING)) AS line
FROM ({FLOOR}) r WHERE asset_hint <> 'AS-7' GROUP BY tag
"""

FLOOR_DAYS = f"""
SELECT u AS n, CAST(ts AS DATE) AS day, CAST(extract(DAY FROM min(ts)) AS INT) AS d
FROM ({FLOOR}) r WHERE u < 19 GROUP BY u, CAST(ts AS DATE)
"""

# One long batch per asset and day (blank for AS-3) and a short one inside it that comes first.
FLOOR_BATCHES = f"""
SELECT concat('AS-', CAST(n AS STRING)) AS asset,
       CASE WHEN n = 3 THEN '' ELSE concat('B-', CAST(n AS STRING), '-', CAST(d AS STRING)) END AS batch,
       concat('P', CAST((n + d) % 7 AS STRING)) AS product, 'run' AS phase,
       concat(CAST(day AS STRING), ' 02:00:00') AS start_ts,
       concat(CAST(day AS STRING), ' 22:00:00') AS end_ts,
       concat('S', CAST(d % 3 AS STRING)) AS shift, CAST((n * 100 + d) * 2 AS BIGINT) AS seq
FROM ({FLOOR_DAYS}) a
UNION ALL
SELECT concat('AS-', CAST(n AS STRING)) AS asset,
       concat('BX-', CAST(n AS STRING), '-', CAST(d AS STRING)) AS batch,
       'P6' AS product, 'hold' AS phase,
       concat(CAST(day AS STRING), ' 10:00:00') AS start_ts,
       concat(CAST(day AS STRING), ' 14:00:00') AS end_ts,
       'SX' AS shift, CAST((n * 100 + d) * 2 - 1 AS BIGINT) AS seq
FROM ({FLOOR_DAYS}) b
"""

FLOOR_MATERIALS = """
SELECT * FROM (VALUES ('P0', 'M-0000', 'F0', 'USP'), ('P1', 'M-0001', 'F1', 'USP'), ('P2', 'M-0002', 'F0', 'USP'),
                      ('P3', 'M-0003', 'F1', 'USP'), ('P4', 'M-0004', 'F0', 'USP')) v(product, material_no, family, grade)
"""

FLOOR_CALIBRATIONS = f"""
SELECT tag, max(u) AS calibration_age_days, concat('LAB-', max(param)) AS lab_note_ref
FROM ({FLOOR}) r WHERE u < 15 GROUP BY tag
"""

# ---------------------------------------------------------------- plant: the built-in tags

LOG_PARTITIONS = 3

def _case(column: str, pairs) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"


_EVENT_OF = dict(zip(["click", "error", "purchase", "signup", "view"], dims.BUILT_IN))

PLANT = f"""
SELECT event_id, event_id AS row_index, concat('E-', CAST(event_id AS STRING)) AS reading_id, k, u,
       {_case('event_type', [(e, f"'{p.param}'") for e, p in _EVENT_OF.items()])} AS param,
       {_case('event_type', [(e, f"'{p.tag}'") for e, p in _EVENT_OF.items()])} AS tag,
       round({_case('event_type', [(e, f"CAST({p.trip[0]} AS DOUBLE)") for e, p in _EVENT_OF.items()])}
             + {_case('event_type', [(e, f"CAST({p.trip[1] - p.trip[0]} AS DOUBLE)") for e, p in _EVENT_OF.items()])}
               * (value / (value + CAST(35 AS DOUBLE))), 3) AS value,
       ts + INTERVAL '955' DAY AS ts,
       CASE WHEN k < 5 THEN 'BAD' WHEN k < 10 THEN '' WHEN k < 15 THEN 'bad'
            WHEN k < 20 THEN NULL ELSE 'good' END AS quality
FROM ({EVENTS_K}) e
"""


def floor(spark: SparkSession, sf: str) -> DataFrame:
    return run_view(spark, sf, FLOOR, "events")


def floor_good(spark, sf) -> DataFrame:
    """Floor readings that pass the quality filter, ready for enrichment."""
    rows = floor(spark, sf).filter(medallion.usable())
    return rows.select("reading_id", "row_index", "tag", "param", "value", "ts", "quality",
                       s.clock_text("ts").alias("timestamp"))


def floor_lookups(spark, sf) -> lookups.Lookups:
    """Uploaded tables of the floor; bands are given as text to be parsed."""
    bands = spark.createDataFrame(
        [(p.param, *[f"{lo} - {hi}" for lo, hi in (p.control, p.alarm, p.trip)]) for p in FLOOR_PARAMETERS],
        "param string, control string, alarm string, trip string")
    assets = run_view(spark, sf, FLOOR_ASSETS, "events").join(F.broadcast(bands), "param")
    return lookups.build_lookups(
        spark, assets=assets, batches=run_view(spark, sf, FLOOR_BATCHES, "events"),
        materials=spark.sql(FLOOR_MATERIALS), calibrations=run_view(spark, sf, FLOOR_CALIBRATIONS, "events"),
        parameters=FLOOR_PARAMETERS, reference=False)


_PREPARED = {}


def _prepared(kind, spark, sf, make):
    """Lookups are shaped and measured once per session and folder."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        _PREPARED[key] = enrich.prepare(make())
    return _PREPARED[key]


def floor_joinable(spark, sf) -> enrich.Joinable:
    return _prepared("floor", spark, sf, lambda: floor_lookups(spark, sf))


def plant(spark, sf) -> DataFrame:
    return run_view(spark, sf, PLANT, "events")


def plant_readings(spark, sf) -> DataFrame:
    """Plant readings ready for enrichment."""
    return plant(spark, sf).select("reading_id", "row_index", "tag", "param", "value", "ts", "quality",
                                   s.clock_text("ts").alias("timestamp"))


def plant_joinable(spark, sf) -> enrich.Joinable:
    return _prepared("plant", spark, sf, lambda: lookups.build_lookups(spark))


def plant_events(spark, sf) -> DataFrame:
    """Plant readings through the enrichment chain, with the arrival order as seq."""
    events = enrich.events_of(enrich.enrich(plant_readings(spark, sf), plant_joinable(spark, sf)))
    return events.withColumnRenamed("row_index", "seq")


def plant_raw(spark, sf) -> DataFrame:
    """Plant readings as they come off the wire: clock text with T and Z, unit, topic."""
    rows = plant(spark, sf)
    clock = F.concat(F.replace(s.clock_text("ts"), F.lit(" "), F.lit("T")), F.lit("Z"))
    partition = F.coalesce(*[F.when(F.col("param") == p.param, i % LOG_PARTITIONS) for i, p in enumerate(dims.BUILT_IN)])
    return rows.select("reading_id", "row_index", "tag", "param", "value", "quality", clock.alias("timestamp"),
                       F.lit("raw").alias("unit"), F.lit("wire").alias("source"),
                       F.concat(F.lit("plant/"), "param").alias("uns_topic"),
                       partition.alias("partition"), F.col("row_index").alias("offset"))


def plant_envelopes(spark, sf) -> DataFrame:
    """The plant's log: a tag always goes to the same partition, and its offsets have gaps."""
    return medallion.envelopes(plant_raw(spark, sf))


SCALE_PARAMETERS = (Parameter("qty", "Quantity", "Quantity", "pcs", "qty", "", (5.0, 45.0), (2.0, 48.0), (1.0, 50.0), []),)


def scale_readings(spark, sf) -> DataFrame:
    """Line items as readings: the part is the tag, the ship date the time."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("reading_id"),
                     F.col("l_partkey").cast("string").alias("tag"), F.lit("qty").alias("param"),
                     F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("ts"),
                     s.clock_text("l_shipdate").alias("timestamp"))


def scale_lookups(spark, sf) -> lookups.Lookups:
    """Parts as the asset table, which grows with the data; a batch per brand and year."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("tag"), F.col("p_brand").alias("asset"), F.lit("qty").alias("param"),
        F.col("p_type").alias("line"))
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    brands = part.groupBy("asset").agg(F.min("line").alias("product"))
    spans = years.agg(F.collect_set("y")).scalar()
    batches = brands.select("asset", "product", F.explode(spans).alias("y")).select(
        "asset", F.concat_ws("-", "asset", "y").alias("batch"), "product",
        F.concat(F.col("y").cast("string"), F.lit("-01-15")).alias("start_ts"),
        F.concat(F.col("y").cast("string"), F.lit("-12-15")).alias("end_ts"), F.col("y").cast("long").alias("seq"))
    return lookups.build_lookups(spark, assets=part, batches=batches, parameters=SCALE_PARAMETERS, reference=False)


def documents(spark, sf) -> DataFrame:
    """Documents as saved files; line breaks are doubled so that lines become paragraphs."""
    docs = table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                       F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
                       F.col("lang").alias("kind"), F.col("doc_id").alias("seq"))


def whole_documents(spark, sf) -> DataFrame:
    """Every document as one chunk, its language as the parameter."""
    docs = table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("id"), F.lit("OTHER").alias("type"),
                       F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("ref"), F.col("lang").alias("param"),
                       "text", F.col("doc_id").alias("seq"), F.lit(1).cast("long").alias("piece"))


def questions(spark, sf) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                        F.when(F.col("item_id") % 5 == 4, "es").otherwise("en").alias("param"))


def scratch(spark, name) -> str:
    return scratch_path(spark, name)


# ---------------------------------------------------------------- SQL of the twin queries

def _values(rows, columns) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


def _parameter_sql(parameters) -> str:
    return _values([(i, p.param, p.name, p.short, p.unit, p.tag, p.asset, dims.line_of(p.asset),
                     dims.topic_line_of(p.asset), *map(float, p.control), *map(float, p.alarm),
                     *map(float, p.trip), " ".join(p.drivers[:3]), (p.drivers or [""])[0])
                    for i, p in enumerate(parameters)],
                   "pos, param, p_name, p_short, p_unit, p_tag, p_asset, p_line, p_topic_line, c_lo, c_hi, "
                   "a_lo, a_hi, t_lo, t_hi, drivers, driver")


def _graded(source, parameters) -> str:
    """Status, zone and delta in SQL, written the long way."""
    return f"""
    SELECT r.*, p.p_name, p.p_short, p.p_unit, p.p_tag, p.p_asset, p.p_line, p.drivers, p.driver,
           p.c_lo, p.c_hi, p.a_lo, p.a_hi, p.t_lo, p.t_hi, p.pos,
           CASE WHEN value > c_hi THEN 'OVER' WHEN value < c_lo THEN 'UNDER' ELSE 'OK' END AS status,
           CASE WHEN value >= c_lo AND value <= c_hi THEN 'control'
                WHEN value > a_lo AND value < a_hi THEN 'alarm' ELSE 'trip' END AS zone,
           CASE WHEN value > c_hi THEN round(value - c_hi, 3)
                WHEN value < c_lo THEN round(c_lo - value, 3) ELSE CAST(0 AS DOUBLE) END AS delta
    FROM {source} r JOIN {parameters} p ON r.param = p.param"""


PARTS = {
    "floor": FLOOR.replace("{events}", "events"),
    "floor_good": "SELECT * FROM floor WHERE value IS NOT NULL AND upper(coalesce(quality, 'GOOD')) <> 'BAD'",
    "floor_params": _parameter_sql(FLOOR_PARAMETERS),
    "floor_assets": FLOOR_ASSETS.replace("{events}", "events"),
    "floor_batches": FLOOR_BATCHES.replace("{events}", "events"),
    "floor_materials": FLOOR_MATERIALS,
    "floor_calibrations": FLOOR_CALIBRATIONS.replace("{events}", "events"),
    "floor_graded": _graded("floor_good", "floor_params"),
    "floor_hit": """
        SELECT r.kafka_offset, min(m.seq) AS seq
        FROM floor_good r JOIN floor_assets a ON r.tag = a.tag JOIN floor_batches m ON m.asset = a.asset
         AND date_trunc('second', r.ts) BETWEEN CAST(m.start_ts AS TIMESTAMP) AND CAST(m.end_ts AS TIMESTAMP)
        GROUP BY 1""",
    "floor_default": """
        SELECT asset, coalesce(min(CASE WHEN batch <> '' THEN seq END), min(seq)) AS seq
        FROM floor_batches GROUP BY 1""",
    "floor_placed": """
        SELECT r.*, a.asset, a.line, m.batch, m.product, m.phase, m.start_ts, m.end_ts, m.shift,
               CASE WHEN a.asset IS NULL THEN concat('tag ', r.tag, ' not found in asset model')
                    WHEN d.asset IS NULL THEN concat('asset ', a.asset, ' not found in MES') END AS reason,
               CASE WHEN d.asset IS NULL THEN NULL WHEN h.seq IS NOT NULL THEN 'in-window'
                    ELSE 'outside-window' END AS time_match
        FROM floor_graded r LEFT JOIN floor_assets a ON r.tag = a.tag
        LEFT JOIN floor_hit h ON r.kafka_offset = h.kafka_offset
        LEFT JOIN floor_default d ON a.asset = d.asset
        LEFT JOIN floor_batches m ON m.asset = a.asset AND m.seq = coalesce(h.seq, d.seq)""",
    "plant": PLANT.replace("{events}", "events"),
    "params": _parameter_sql(dims.BUILT_IN),
    "batches": _values(fixed.BATCHES, "asset, batch, product, phase, start_ts, end_ts, shift"),
    "materials": _values(fixed.MATERIALS, "product, material_no, family, grade, equipment, spec_source"),
    "plant_graded": _graded("plant", "params"),
    "plant_first": """
        SELECT * FROM plant_graded QUALIFY row_number() OVER (
            PARTITION BY tag, round(value, 4), date_trunc('second', ts) ORDER BY row_index) = 1""",
    "plant_flat": """
        SELECT g.row_index, g.reading_id, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", g.param, p_short AS short,
               p_name AS name, g.tag, g.value, p_unit AS unit, status, zone, delta,
               concat(CAST(c_lo AS VARCHAR), ', ', CAST(c_hi AS VARCHAR)) AS spec, p_asset AS asset,
               p_name AS asset_name, p_line AS line, b.batch, b.product, b.phase, b.shift AS operator_shift,
               concat(b.start_ts, ' → ', b.end_ts) AS mes_window, m.material_no, m.family, m.grade, m.equipment,
               m.spec_source, CAST(12 AS BIGINT) AS calibration_age_days, '2026-08-01' AS probe_calibration_date,
               '2026-07-20' AS last_maintenance,
               concat('LAB-', upper(g.param), '-2026-0', CAST(pos + 1 AS VARCHAR)) AS lab_note_ref,
               CASE WHEN date_trunc('second', g.ts) BETWEEN CAST(b.start_ts AS TIMESTAMP) AND CAST(b.end_ts AS TIMESTAMP)
                    THEN 'in-window' ELSE 'outside-window' END AS time_match, g.drivers, g.driver, g.ts
        FROM plant_graded g JOIN batches b ON g.p_asset = b.asset JOIN materials m ON b.product = m.product""",
}

NEEDS = {
    "floor_good": ["floor"], "floor_graded": ["floor_good", "floor_params"],
    "floor_hit": ["floor_good", "floor_assets", "floor_batches"], "floor_default": ["floor_batches"],
    "floor_placed": ["floor_graded", "floor_assets", "floor_hit", "floor_default", "floor_batches"],
    "plant_graded": ["plant", "params"], "plant_first": ["plant_graded"],
    "plant_flat": ["plant_graded", "batches", "materials"],
}


def sql(body: str, *parts: str, **extra: str) -> str:
    """A twin query: the named view definitions (and what they need), then the body."""
    order = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    ctes = [f"{name} AS ({PARTS[name]})" for name in order]
    ctes += [f"{name} AS ({text})" for name, text in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


FLAT_SQL = ("reading_id, \"timestamp\", param, short, name, tag, value, unit, status, zone, delta, spec, asset, "
            "asset_name, line, batch, product, phase, operator_shift, mes_window, material_no, family, grade, "
            "equipment, spec_source, calibration_age_days, probe_calibration_date, last_maintenance, lab_note_ref")


def comparable(flat: DataFrame) -> DataFrame:
    """Flat events with arrays as text and whole numbers as long, for the comparison."""
    return (flat.withColumn("spec", F.array_join(F.transform("spec", lambda x: x.cast("string")), ", "))
            .withColumn("calibration_age_days", F.col("calibration_age_days").cast("long")))
