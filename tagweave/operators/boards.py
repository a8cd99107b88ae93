"""Observations, excursion boards, dashboards and catalogues."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import bands
from tagweave.functions import scalars as s
from tagweave.operators import enrich as en
from tagweave.operators.dedup import NATURAL_KEY, keep_first_id, keep_first_reading, with_natural_key
from tagweave.operators.medallion import latest_by_arrival
from tagweave.operators.sizing import lookup_join
from tagweave.operators.versions import active_versions, slot_of
from tagweave.schemas import FLAT_COLUMNS
from tagweave.sources import parameters as dims
from tagweave.sources.sinks import LOG_POSITION

ZONES = ["control", "alarm", "trip"]


def observations(readings: DataFrame, lookups, parameters=dims.BUILT_IN, param=None) -> DataFrame:
    """Readings with their parameter, band and zone; unknown tags are left out."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    catalogue = dims.parameter_frame(readings.sparkSession, parameters)
    by_tag = catalogue.select(F.col("p_tag").alias("_tag"), F.col("param").alias("_tag_param"))
    by_id = catalogue.select(F.col("param").alias("_id"))
    rows = readings.withColumn("tag", F.trim(F.coalesce("tag", F.lit(""))))
    rows = (rows.join(F.broadcast(by_tag), F.col("tag") == F.col("_tag"), "left")
            .join(F.broadcast(by_id), F.col("param") == F.col("_id"), "left"))
    resolved = F.coalesce("_tag_param", "_id")
    if param is not None:
        # A row that names neither a tag nor a parameter belongs to the asked parameter.
        resolved = F.coalesce(resolved, F.when(F.col("tag") == "", F.lit(param)))
    rows = rows.withColumn("param", resolved).drop("_tag", "_tag_param", "_id")
    rows = rows.filter(F.col("param").isNotNull() & F.col("value").isNotNull())
    if param is not None:
        rows = rows.filter(F.col("param") == param)
    rows = rows.join(F.broadcast(catalogue), "param")
    rows = rows.withColumn("tag", F.coalesce(F.nullif("tag", F.lit("")), "p_tag")).filter("tag != ''")

    limits = lk.assets.select("tag", "a_control", "a_alarm", "a_trip")
    rows = lookup_join(rows, limits, "tag", "left", lk.small["assets"])
    control, alarm, trip = resolved_bands()
    rows = rows.withColumn("control", control).withColumn("alarm", alarm).withColumn("trip", trip)
    # With the parameter's own control band, its own alarm and trip bands decide as well.
    own = F.col("control") == F.array("p_control_lo", "p_control_hi")
    ours = [(F.col(f"p_{k}_lo"), F.col(f"p_{k}_hi")) for k in ZONES]
    theirs = [(F.col(k)[0], F.col(k)[1]) for k in ZONES]
    zone = F.when(own, bands.zone_of(F.col("value"), *ours)).otherwise(bands.zone_of(F.col("value"), *theirs))
    keep = [c for c in readings.columns if c not in ("tag", "param", "unit", "asset", "quality", "source")]

    def given(name, default):
        return F.coalesce(s.blank_to_null(name), default) if name in readings.columns else default

    return rows.select(
        *keep, "tag", "param", given("unit", F.col("p_unit")).alias("unit"),
        given("asset", F.col("p_asset")).alias("asset"), given("quality", F.lit("GOOD")).alias("quality"),
        given("source", F.lit("observation")).alias("source"), zone.alias("scenario"),
        "control", "alarm", "trip")


def resolved_bands():
    """Asset table, then parameter default, then control widened by 0.5 and 1.0."""
    def default(kind):
        lo, hi = F.col(f"p_{kind}_lo"), F.col(f"p_{kind}_hi")
        return F.when(lo.isNotNull() & hi.isNotNull(), F.array(lo, hi))

    control = F.coalesce("a_control", default("control"))
    alarm = F.coalesce("a_alarm", default("alarm"), bands.widened(control, 0.5))
    trip = F.coalesce("a_trip", default("trip"), bands.widened(control, 1.0))
    return control, alarm, trip


def zone_counts(observed: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """A1: control / alarm / trip / total per parameter; parameters without rows show 0."""
    catalogue = dims.parameter_frame(observed.sparkSession, parameters)
    counted = observed.groupBy("param").agg(
        *[F.count_if(F.col("scenario") == z).alias(z) for z in ZONES], F.count("*").alias("total"))
    joined = catalogue.join(counted, "param", "left").na.fill(0, [*ZONES, "total"])
    return joined.select("param", F.col("p_tag").alias("tag"), F.col("p_short").alias("short"),
                         F.col("p_unit").alias("unit"), *ZONES, "total")


def observation_run(readings: DataFrame, lookups, param: str, zone: str, order,
                    parameters=dims.BUILT_IN) -> dict:
    """One parameter and zone: classified rows, counts, events and errors."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    classified = keep_first_reading(observations(readings, lk, parameters, param), order)
    counts = zone_counts(classified, [p for p in parameters if p.param == param])
    return {"observations": classified, "counts": counts, **_run(classified, lk, [zone], order, parameters)}


def all_observation_runs(readings: DataFrame, lookups, order, zones=("trip", "alarm"),
                         parameters=dims.BUILT_IN) -> dict:
    """D1 for every parameter at once."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    classified = keep_first_reading(observations(readings, lk, parameters), order)
    return {"observations": classified, "counts": zone_counts(classified, parameters),
            **_run(classified, lk, list(zones), order, parameters)}


def _run(classified, lk, zones, order, parameters):
    matched = classified.filter(F.col("scenario").isin(zones)).drop("asset", "control", "alarm", "trip")
    enriched = en.enrich(matched, lk, parameters)
    events = keep_first_id(en.events_of(enriched), order)
    return {"events": events, "errors": en.rejects_of(enriched)}


def excursion_board(readings: DataFrame, lookups, order, zones=("trip", "alarm"),
                    parameters=dims.BUILT_IN) -> dict:
    """Trip and alarm events over all parameters, with counts per parameter."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    classified = keep_first_reading(observations(readings, lk, parameters), order)
    matched = classified.filter(F.col("scenario").isin(list(zones)))
    events = en.events_of(en.enrich(matched.drop("asset", "control", "alarm", "trip"), lk, parameters))
    return {"by_param": zone_counts(classified, parameters), "events": events.select("scenario", *FLAT_COLUMNS)}


def board_order(events: DataFrame) -> DataFrame:
    """Parameter, time and reading id as text, missing as blank."""
    return events.orderBy(*[F.coalesce(s.text(c), F.lit("")) for c in ("param", "timestamp", "reading_id")])


def board_totals(events: DataFrame, zones=("trip", "alarm")) -> DataFrame:
    return events.agg(*[F.count_if(F.col("scenario") == z).alias(z) for z in zones],
                      F.count("*").alias("total"))


def zone_examples(observed: DataFrame, order="row_index", zones=tuple(ZONES)) -> DataFrame:
    """Of every parameter and zone the newest reading that lies in it."""
    rest = [c for c in observed.columns if c not in ("param", "scenario")]
    rows = observed.filter(F.col("scenario").isin(list(zones)))
    newest = rows.groupBy("param", "scenario").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return newest.select("param", "scenario", "r.*")


def scenario_events(readings: DataFrame, lookups, order="row_index", zones=tuple(ZONES),
                    parameters=dims.BUILT_IN) -> DataFrame:
    """D3: the newest reading of every parameter and zone through the enrichment chain."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    newest = zone_examples(observations(readings, lk, parameters), order, zones)
    return en.events_of(en.enrich(newest.drop("asset", "control", "alarm", "trip"), lk, parameters))


def parameter_board(readings: DataFrame, lookups, order, zones=("trip", "alarm"), newest="row_index",
                    parameters=dims.BUILT_IN) -> DataFrame:
    """Events per parameter and zone; an empty group shows the parameter's newest reading."""
    lk = lookups if isinstance(lookups, en.Joinable) else en.prepare(lookups)
    run = all_observation_runs(readings, lk, order, zones, parameters)
    events = run["events"].select("scenario", *FLAT_COLUMNS).withColumn("fallback", F.lit(False))
    # A row per parameter and zone from here on, which the catalogue bounds.
    catalogue = dims.parameter_frame(readings.sparkSession, parameters)
    groups = catalogue.select("param", F.explode(F.array(*map(F.lit, zones))).alias("scenario"))
    empty = groups.join(events.select("param", "scenario").distinct(), ["param", "scenario"], "left_anti")
    seen = run["observations"]
    rest = [c for c in seen.columns if c not in ("param", "scenario", "asset", "control", "alarm", "trip")]
    last = seen.groupBy("param").agg(F.max_by(F.struct(*rest), F.col(newest)).alias("r"))
    spare = empty.join(last, "param").select("param", "scenario", "r.*")
    shown = en.events_of(en.enrich(spare, lk, parameters)).select("scenario", *FLAT_COLUMNS)
    return events.unionByName(shown.withColumn("fallback", F.lit(True)))


def decompose(readings: DataFrame, lookups, param, zone, reading_id, order,
              parameters=dims.BUILT_IN) -> DataFrame:
    """The event of one reading id within one parameter and zone.

    Only the copies of that reading are classified and enriched.
    """
    keyed = with_natural_key(readings)
    asked = keyed.filter(F.trim("reading_id") == reading_id.strip()).select(*NATURAL_KEY).distinct()
    copies = keyed.join(asked, NATURAL_KEY, "left_semi").drop(*NATURAL_KEY)
    run = observation_run(copies, lookups, param, zone, order, parameters)
    return run["events"].filter(F.trim("reading_id") == reading_id.strip())


def newest_log_rows(bronze: DataFrame, n: int) -> DataFrame:
    """Newest n rows of the historian by the reading's clock, then by position in the log:
    an offset says nothing across partitions."""
    return bronze.orderBy(F.desc_nulls_last(s.clock_of("ts_raw")), *[F.desc(c) for c in LOG_POSITION]).limit(n)


def newest_events(events: DataFrame, n: int, param=None, order="seq") -> DataFrame:
    """Newest n rows; a parameter filter applies before the cut."""
    if param:
        events = events.filter(F.col("param") == param)
    return events.orderBy(F.desc(order)).limit(n)


def newest_excursions(events: DataFrame, n=10, order="seq") -> DataFrame:
    """T4: the newest n OVER / UNDER events."""
    return newest_events(events.filter(F.col("status").isin("OVER", "UNDER")), n, order=order)


def status_counts(events: DataFrame) -> DataFrame:
    """A2: OK / OVER / UNDER over all events."""
    return events.agg(*[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("OK", "OVER", "UNDER")],
                      F.count("*").alias("total_events"))


def dashboard(events: DataFrame, parameters=dims.BUILT_IN, order="seq") -> DataFrame:
    """A3: latest state and excursions per parameter over all events."""
    catalogue = dims.parameter_frame(events.sparkSession, parameters)
    state = F.struct("value", "status", "batch", "product", "zone")
    latest = events.groupBy("param").agg(
        F.max_by(state, F.col(order)).alias("now"),
        F.count_if(F.col("status") != "OK").alias("excursions"))
    return catalogue.join(latest, "param", "left").select(
        "param", F.col("p_name").alias("name"), F.col("p_unit").alias("unit"), F.col("p_asset").alias("asset"),
        F.col("p_control_lo").alias("spec_lo"), F.col("p_control_hi").alias("spec_hi"),
        F.col("now.value").alias("value"), F.coalesce("now.status", F.lit("—")).alias("status"),
        F.col("now.batch").alias("batch"), F.col("now.product").alias("product"),
        F.col("now.zone").alias("zone"), F.coalesce("excursions", F.lit(0)).alias("excursions"))


def file_catalogue(readings: DataFrame, by=("param",), order="row_index") -> DataFrame:
    """A5: rows, and the first and last value and time, per parameter of a file."""
    at = F.col(order)
    unit = F.coalesce(s.blank_to_null("file_unit"), "unit", F.lit(""))
    time = F.coalesce(s.blank_to_null("file_ts"), "timestamp")
    first = F.struct(F.coalesce("file_tag", "tag").alias("tag"), unit.alias("unit"), "uns_topic",
                     "value", time.alias("ts"))
    return readings.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.min_by(first, at).alias("f"),
        F.max_by(F.struct("value", time.alias("ts")), at).alias("l")).select(
        *by, "n_rows", "f.tag", "f.unit", F.col("f.uns_topic").alias("topic"),
        F.col("f.value").alias("first_value"), F.col("l.value").alias("last_value"),
        F.col("f.ts").alias("first_ts"), F.col("l.ts").alias("last_ts"))


def rows_per_parameter(readings: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """Rows per parameter, 0 for those without rows."""
    catalogue = dims.parameter_frame(readings.sparkSession, parameters).select("param")
    counted = readings.groupBy("param").agg(F.count("*").alias("n_rows"))
    return catalogue.join(counted, "param", "left").na.fill(0, ["n_rows"])


def chart_series(counts: DataFrame) -> DataFrame:
    """A10: per agent Trip / Alarm / In-spec, and trip + alarm per parameter for escalation."""
    per_agent = counts.select(F.col("param").alias("agent"), F.col("trip").alias("Trip"),
                              F.col("alarm").alias("Alarm"), F.col("control").alias("In-spec")).unpivot(
        ["agent"], ["Trip", "Alarm", "In-spec"], "label", "value")
    overall = counts.select(F.lit("escalation").alias("agent"), F.col("short").alias("label"),
                            (F.col("trip") + F.col("alarm")).alias("value"))
    return per_agent.unionByName(overall)


def lake_mapping(lake: DataFrame, lookups, parameters=dims.BUILT_IN) -> dict:
    """Latest lake row per tag through the chain, with a summary."""
    newest = latest_by_arrival(lake)
    enriched = en.enrich(newest.drop("asset"), lookups, parameters)
    summary = enriched.agg(
        F.count_if(F.col("reason").isNull()).alias("mapped"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
        F.count("*").alias("tags")).withColumn("lake_rows", lake.agg(F.count("*")).scalar())
    return {"summary": summary, "events": en.events_of(enriched), "errors": en.rejects_of(enriched)}


def distinct_keys(readings: DataFrame, key="tag") -> DataFrame:
    """Distinct keys in order. Sorted by Spark, so no array of all keys is built."""
    return readings.select(key).distinct().orderBy(key)


def retained(rows: DataFrame, clock, days: int) -> DataFrame:
    """The rows of the last ``days`` days before the newest one; rows without a time stay."""
    newest = rows.agg(F.max(clock)).scalar()
    age = F.datediff(newest.cast("date"), clock.cast("date"))
    return rows.filter(F.coalesce(age < days, F.lit(True)))


def source_catalogue(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """Per slot its kind, columns, rows and bytes, from the newest version of the slot.

    A dataset without a slot counts under its kind. ``rows`` hold their cells in ``payload``,
    a map; its keys are the columns.
    """
    current = active_versions(datasets).withColumn("slot", slot_of())
    sized = rows.groupBy("dataset_id").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.length(F.array_join(F.map_values("payload"), ""))).alias("n_bytes"))
    # A dataset's names are few; its distinct lists of them need not be.
    names = rows.select("dataset_id", F.explode(F.map_keys("payload")).alias("_name")).groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("_name")).alias("_names"))
    columns = F.col("_names")
    return lookup_join(current, sized.join(names, "dataset_id", "left"), "dataset_id").select(
        "slot", "kind", "dataset_id", "persisted", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce(F.array_join(columns, ", "), F.lit("")).alias("columns"),
        (F.coalesce("n_rows", F.lit(0)) > 0).alias("loaded"))


def catalogue_totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count_if("persisted").alias("saved_count"),
                         F.count_if("loaded").alias("loaded_count"))
