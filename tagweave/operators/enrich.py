"""The enrichment chain: tag -> asset -> batch in time -> material, and calibration."""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import bands
from tagweave.functions import scalars as s
from tagweave.operators.lookups import Lookups
from tagweave.operators.sizing import lookup_join, stored, stored_all
from tagweave.schemas import FLAT_COLUMNS
from tagweave.sources import parameters as dims

# An asset's times are cut into at most so many pages.
MAX_PAGES = 10_000
BATCH_FIELDS = ["batch", "product", "phase", "start", "end", "operator_shift"]


@dataclass
class Joinable:
    """Lookup tables in the shape the joins need, with their measured size class."""

    assets: DataFrame
    batch_by_asset: DataFrame
    batch_windows: DataFrame
    materials: DataFrame
    calibrations: DataFrame
    small: dict


def prepare(lookups: Lookups) -> Joinable:
    """Shape the lookups and write them once per job; their files tell which may be broadcast."""
    assets = lookups.assets.select(
        "tag", F.col("asset").alias("a_asset"), F.col("parameter").alias("a_param"),
        F.col("name").alias("a_name"), F.col("unit").alias("a_unit"), F.col("control").alias("a_control"),
        F.col("alarm").alias("a_alarm"), F.col("trip").alias("a_trip"), F.col("line").alias("a_line"),
        F.col("origin").alias("a_origin"))
    materials = lookups.materials.select(
        "product", "material_no", "family", "grade", "equipment", "spec_source",
        F.col("origin").alias("s_origin"))
    calibrations = lookups.calibrations.select(
        "tag", "probe_calibration_date", "calibration_age_days", "drift_mv", "last_maintenance",
        "lab_note_ref", F.col("origin").alias("r_origin"))
    tables, small = stored_all({"assets": assets, "materials": materials, "calibrations": calibrations,
                                "batches": _timed(lookups.batches)})
    timed = tables.pop("batches")
    alive = timed.filter("to_s >= from_s")
    most, longest = alive.groupBy("asset").agg(F.count("*").alias("n"), F.max(F.col("to_s") - F.col("from_s") + 1).alias("s")).agg(
        F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.max("s"), F.lit(1))).first()
    pages = min(math.ceil(math.sqrt(2 * most)), MAX_PAGES)
    levels = longest.bit_length() - 1
    shaped, sizes = stored_all({"batch_by_asset": batch_by_asset(timed, pages), "nodes": window_nodes(alive, levels)})
    by_asset, nodes = shaped["batch_by_asset"], shaped["nodes"]
    steps = first_open(alive, nodes, levels, sizes["nodes"])
    windows, small["batch_windows"] = stored(batch_windows(steps, by_asset, sizes["batch_by_asset"]), "batch-windows")
    small["batch_by_asset"] = sizes["batch_by_asset"]
    return Joinable(**tables, batch_by_asset=by_asset, batch_windows=windows, small=small)


class Snapshots:
    """Lookups for a stream, loaded and prepared again only when their version has changed.

    ``version`` is asked before every micro-batch, and before loading: a change that comes
    while lookups are loaded is seen by the next micro-batch.
    """

    def __init__(self, load, version):
        self.load, self.version = load, version
        self.prepared, self._seen, self._held = 0, None, None

    def __call__(self, spark) -> Joinable:
        seen = self.version(spark)
        if self._held is None or seen != self._seen:
            loaded = self.load(spark)
            self._held = loaded if isinstance(loaded, Joinable) else prepare(loaded)
            self._seen = seen
            self.prepared += 1
        return self._held


def _timed(batches: DataFrame) -> DataFrame:
    return (batches.withColumn("from_s", s.epoch_second(s.clock_of("start")))
            .withColumn("to_s", s.epoch_second(s.clock_of("end"))))


def batch_by_asset(timed: DataFrame, pages: int) -> DataFrame:
    """J2 build side: one row per asset.

    It carries the batch used outside every window (the first one with a batch, else the
    first) and the times at which its pages begin: quantiles of the times at which windows
    open and close, so that no page holds much more than its share of them.
    """
    facts = F.struct(*BATCH_FIELDS, "from_s", "to_s")
    rank = F.struct(F.when(F.col("has_batch"), 0).otherwise(1), F.col("seq"))
    turns = F.when(F.col("to_s") >= F.col("from_s"), F.array(F.col("from_s"), F.col("to_s") + 1))
    rows = timed.withColumn("_turn", F.explode_outer(turns))
    shares = [i / pages for i in range(1, pages)]
    none = F.array().cast("array<bigint>")
    starts = F.array_distinct(F.percentile_approx("_turn", shares, MAX_PAGES)) if shares else F.any_value(none)
    return rows.groupBy(F.col("asset").alias("a_asset")).agg(
        F.min_by(facts, rank).alias("b_default"), F.first("origin").alias("b_origin"),
        F.coalesce(starts, F.any_value(none)).alias("b_starts"))


def window_nodes(alive: DataFrame, levels: int) -> DataFrame:
    """The first window in file order per asset and node of time.

    A node of a level is a stretch of 2^level seconds; a window is laid out as the few nodes, at most
    two of a level, that make it up.
    """
    low, high = "shiftright(from_s + shiftleft(1L, l) - 1, l)", "shiftright(to_s + 1, l)"
    nodes = F.expr(f"""filter(flatten(transform(sequence(0, {levels}), l -> array(
        named_struct('level', l, 'node', {low}, 'used', {low} < {high} AND {low} % 2 <> 0),
        named_struct('level', l, 'node', {high} - 1, 'used', {low} < {high} AND {high} % 2 <> 0)))), n -> n.used)""")
    window = F.struct("seq", "from_s", "to_s", *BATCH_FIELDS)
    placed = alive.select(F.col("asset").alias("a_asset"), window.alias("w"), F.inline(nodes))
    return placed.groupBy("a_asset", "level", "node").agg(F.min("w").alias("w"))


def first_open(alive: DataFrame, nodes: DataFrame, levels: int, small: bool) -> DataFrame:
    """Per asset and time at which a window opens or closes: the first window in file order
    that is open from then to the next such time, null if none is."""
    turns = alive.select(F.col("asset").alias("a_asset"), F.explode(F.array(F.col("from_s"), F.col("to_s") + 1)).alias("at")).distinct()
    probes = turns.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(at, level)"))
    return lookup_join(probes, nodes, ["a_asset", "level", "node"], "left", small).groupBy("a_asset", "at").agg(F.min("w").alias("w"))


def _page(starts, at):
    return F.size(F.filter(starts, lambda start: start <= at))


def batch_windows(steps: DataFrame, by_asset: DataFrame, small: bool) -> DataFrame:
    """J2 build side: the steps of an asset and page as one array in order of time.

    A reading finds its page in the row of its asset and probes one row of steps, however many
    windows are open at once. An asset of n windows has about sqrt(2n) pages of about as
    many steps, so neither array grows with the table; beyond MAX_PAGES pages grow.
    """
    placed = lookup_join(steps, by_asset.select("a_asset", "b_starts"), "a_asset", "inner", small)
    return placed.groupBy("a_asset", _page("b_starts", F.col("at")).alias("b_page")).agg(
        F.array_sort(F.collect_list(F.struct("at", "w"))).alias("b_windows"))


def join_assets(readings: DataFrame, lk: Joinable) -> DataFrame:
    """Asset and limits by tag, at most one match."""
    return lookup_join(readings, lk.assets, "tag", "left", lk.small["assets"])


def join_batches(readings: DataFrame, lk: Joinable) -> DataFrame:
    """The batch running on the asset at the reading's time.

    The first window in file order that holds the time wins; without one the asset's
    default batch is kept and flagged. No reading is dropped here.
    """
    placed = lookup_join(readings, lk.batch_by_asset, "a_asset", "left", lk.small["batch_by_asset"])
    placed = placed.withColumn("_at", s.epoch_second("ts"))
    placed = placed.withColumn("b_page", _page("b_starts", F.col("_at"))).drop("b_starts")
    found = lookup_join(placed, lk.batch_windows, ["a_asset", "b_page"], "left", lk.small["batch_windows"])
    before = F.filter("b_windows", lambda step: step["at"] <= F.col("_at"))
    found = found.withColumn("_hit", F.try_element_at(before, F.lit(-1))["w"]).drop("b_windows")
    hit, default = F.col("_hit"), F.col("b_default")
    comparable = F.col("_at").isNotNull() & default["from_s"].isNotNull() & default["to_s"].isNotNull()
    uploaded = F.col("b_origin") == "upload"
    flag = (F.when(F.col("b_default").isNull(), None)
            .when(hit.isNotNull(), "in-window")
            .when(~uploaded & (F.coalesce(F.col("timestamp"), F.lit("")) == ""), None)
            .when(comparable, "outside-window")
            .when(uploaded, "uploaded").otherwise("unparsed-ts"))
    chosen = [F.when(hit.isNotNull(), hit[c]).otherwise(default[c]).alias(c) for c in BATCH_FIELDS]
    kept = [c for c in found.columns if c not in ("_hit", "_at", "b_default", "b_page")]
    return found.select(*kept, *chosen, flag.alias("time_match"),
                        default.isNotNull().alias("has_batch_row"))


def join_materials(readings: DataFrame, lk: Joinable) -> DataFrame:
    """Material by product; a miss keeps the reading."""
    return lookup_join(readings, lk.materials, "product", "left", lk.small["materials"])


def join_calibrations(readings: DataFrame, lk: Joinable) -> DataFrame:
    """Calibration by tag; a miss keeps the reading."""
    return lookup_join(readings, lk.calibrations, "tag", "left", lk.small["calibrations"])


def reject_reason():
    """Why a reading cannot be enriched, first failing step, or null."""
    tag, asset = F.col("tag"), F.col("a_asset")
    return (F.when(F.coalesce(tag, F.lit("")) == "", "reading has no tag")
            .when(F.col("value").isNull(), F.concat(F.lit("tag "), tag, F.lit(" has no numeric value")))
            .when(asset.isNull(), F.concat(F.lit("tag "), tag, F.lit(" not found in asset model")))
            .when(~F.col("has_batch_row"), F.concat(F.lit("asset "), asset, F.lit(" not found in MES"))))


def compute(joined: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """Parameter, status, zone and delta of joined readings.

    The status uses the asset's own control band; the zone uses the parameter's bands.
    """
    catalogue = dims.parameter_frame(joined.sparkSession, parameters)
    by_tag = catalogue.select(F.col("p_tag").alias("_tag"), F.col("param").alias("_tag_param"))
    details = catalogue.withColumnRenamed("param", "_p")
    given = s.blank_to_null("param") if "param" in joined.columns else F.lit(None).cast("string")
    rows = joined.join(F.broadcast(by_tag), F.col("tag") == F.col("_tag"), "left")
    rows = rows.withColumn("param", F.coalesce("_tag_param", given, s.blank_to_null("a_param"), "tag"))
    rows = rows.join(F.broadcast(details), F.col("param") == F.col("_p"), "left")

    value = F.col("value")
    spec = F.coalesce("a_control", F.array(F.lit(0.0), F.lit(0.0)))
    status = bands.status_of(value, spec[0], spec[1])
    known = F.col("_p").isNotNull()
    zone = F.when(known, bands.zone_of(
        value, (F.col("p_control_lo"), F.col("p_control_hi")), (F.col("p_alarm_lo"), F.col("p_alarm_hi")),
        (F.col("p_trip_lo"), F.col("p_trip_hi")))).when(status == "OK", "control").otherwise("alarm")
    unit = F.coalesce("p_unit", s.blank_to_null("a_unit"),
                      s.blank_to_null("unit") if "unit" in joined.columns else F.lit(None), F.lit(""))
    return (rows
            .withColumn("spec", spec).withColumn("status", status).withColumn("zone", zone)
            .withColumn("delta", bands.delta_of(F.col("status"), value, spec[0], spec[1]))
            .withColumn("unit", unit)
            .withColumn("alarm", F.coalesce("a_alarm", F.when(known, F.array("p_alarm_lo", "p_alarm_hi"))))
            .withColumn("trip", F.coalesce("a_trip", F.when(known, F.array("p_trip_lo", "p_trip_hi"))))
            .withColumn("short", F.coalesce("p_short", "param"))
            .withColumn("name", F.coalesce("p_name", s.blank_to_null("a_name"), "param"))
            .withColumn("drivers", F.coalesce(F.slice("p_drivers", 1, 3), F.array().cast("array<string>"))))


def enrich(readings: DataFrame, lookups, parameters=dims.BUILT_IN) -> DataFrame:
    """Every reading with its context; ``reason`` is set where a lookup rejected it.

    ``readings`` holds tag, value, timestamp (text), ts (timestamp_ntz) and reading_id,
    and may hold param, unit and source. One output row per input row. With lookups
    below the broadcast bound the whole chain is narrow: no shuffle of the readings.
    """
    lk = lookups if isinstance(lookups, Joinable) else prepare(lookups)
    joined = join_assets(readings, lk)
    joined = join_batches(joined, lk)
    joined = join_materials(joined, lk)
    joined = join_calibrations(joined, lk)
    full = compute(joined, parameters).withColumn("reason", reject_reason())
    window = F.when((F.coalesce("start", F.lit("")) != "") | (F.coalesce("end", F.lit("")) != ""),
                    F.concat(F.coalesce(F.nullif("start", F.lit("")), F.lit("—")), F.lit(" → "),
                             F.coalesce(F.nullif("end", F.lit("")), F.lit("—")))).otherwise("")
    carried = [c for c in readings.columns if c in ("scenario", "source", "quality", "row_index", "bronze_offset",
                                                    "source_rank", "event_id", "ts")]
    return full.select(
        "reading_id", F.col("timestamp"), "param", "short", "name", "tag", "value", "unit", "status",
        "zone", "delta", "spec", F.col("a_asset").alias("asset"), F.col("a_name").alias("asset_name"),
        F.col("a_line").alias("line"), "batch", "product", "phase", "operator_shift",
        window.alias("mes_window"), "material_no", "family", "grade", "equipment", "spec_source",
        "calibration_age_days", "probe_calibration_date", "last_maintenance", "lab_note_ref",
        "alarm", "trip", "drivers", F.col("start").alias("mes_start"), F.col("end").alias("mes_end"),
        "time_match",
        F.struct(F.coalesce("a_origin", F.lit("reference")).alias("asset"),
                 F.coalesce("b_origin", F.lit("reference")).alias("mes"),
                 F.coalesce("s_origin", F.lit("reference")).alias("sap"),
                 F.coalesce("r_origin", F.lit("reference")).alias("rdbms")).alias("lookup_origin"),
        "reason", *carried)


def events_of(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("reason").isNull()).drop("reason")


def rejects_of(enriched: DataFrame) -> DataFrame:
    """The readings that no event came from, with the reason."""
    return enriched.filter(F.col("reason").isNotNull()).select("reading_id", "tag", "timestamp", "reason")


def consume(raw: DataFrame) -> DataFrame:
    """Raw readings (text or typed value and time) to the columns that enrichment reads."""
    kinds = dict(raw.dtypes)
    number = [F.col(c).cast("double") if kinds[c] != "string" else s.lenient_number(c)
              for c in ("value", "val") if c in raw.columns]
    clocks = []
    for c in ("timestamp", "ts", "ts_raw", "file_ts"):
        if c in raw.columns:
            clock = s.clock_text(c) if kinds[c].startswith("timestamp") else s.canonical_clock(c)
            clocks.append(F.nullif(clock, F.lit("")))
    stamp = F.coalesce(*clocks) if clocks else F.lit(None).cast("string")
    rest = [c for c in raw.columns if c not in ("value", "val", "timestamp", "ts", "ts_raw")]
    return raw.select(*rest, F.coalesce(*number).alias("value"),
                      F.coalesce(stamp, F.lit("")).alias("timestamp"),
                      stamp.try_cast("timestamp_ntz").alias("ts"))


def flatten(events: DataFrame) -> DataFrame:
    """The 29 table columns of an event."""
    return events.select(*FLAT_COLUMNS)


def merged_view(events: DataFrame) -> DataFrame:
    """One nested record per event, a sub-struct per source."""
    return events.select(
        "tag", "param", "value", "unit", "status", "zone", "delta", "spec", "timestamp",
        F.struct("asset", "line", "spec", F.col("lookup_origin.asset").alias("origin")).alias("asset_model"),
        F.struct("batch", "product", "phase", "operator_shift", "time_match",
                 F.col("lookup_origin.mes").alias("origin")).alias("mes"),
        F.struct("material_no", "spec_source", "grade", F.col("lookup_origin.sap").alias("origin")).alias("sap"),
        F.struct("calibration_age_days", "operator_shift",
                 F.col("lookup_origin.rdbms").alias("origin")).alias("rdbms"),
        F.struct(*[c for c in events.columns]).alias("event"))


def trace(enriched: DataFrame) -> DataFrame:
    """The ordered steps of the chain; steps after the one that failed are absent."""
    def step(code, name, key_in, key_out):
        return F.struct(F.lit(code).alias("step"), F.lit(name).alias("source"),
                        key_in.alias("key_in"), key_out.alias("key_out"))

    at = F.concat_ws(" @ ", "asset", "timestamp")
    stepped = F.array(
        step("A", "Consume", F.col("tag"), F.col("timestamp")),
        step("B.1", "Asset Model", F.col("tag"), F.col("asset")),
        step("B.2", "MES", at, F.concat_ws(" / ", "batch", "product")),
        step("B.3", "SAP", F.col("product"), F.col("material_no")),
        step("B.4", "RDBMS / Files", F.col("tag"), F.col("calibration_age_days").cast("string")),
        step("C", "Compute", F.col("value").cast("string"), F.concat_ws(" / ", "status", "zone")),
        step("D", "Emit", F.col("tag"), F.col("reading_id")))
    reached = (F.when(F.col("reason").isNull(), 7)
               .when(F.col("reason").endswith("not found in MES"), 2).otherwise(1))
    return enriched.select("reading_id", "tag", "timestamp", "reason",
                           F.slice(stepped, F.lit(1), reached).alias("trace"))


def decompose_join(readings, asset_model, mes_batches, sap_master, reading_id=None) -> DataFrame:
    """The generated lookup SQL, all inner joins, for one reading id or for all.

    Windows are spread over the days they touch, so that a reading meets the windows of its
    own day and not all windows of its asset.
    """
    if reading_id is not None:
        readings = readings.filter(F.col("reading_id") == reading_id)
    days = F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))
    windows = mes_batches.filter("end >= start").select("asset", "batch", "product", "start", "end", F.explode(days).alias("_day"))
    placed = readings.join(asset_model.select("tag", "asset"), "tag").withColumn("_day", F.col("ts").cast("date"))
    found = placed.join(windows, ["asset", "_day"]).filter(F.col("ts").between(F.col("start"), F.col("end")))
    return found.join(sap_master.select("product", "material_no"), "product").select(
        "reading_id", "value", "asset", "batch", "material_no")
