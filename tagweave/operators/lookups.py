"""Uploaded lookup tables: normalising, classifying, choosing and falling back."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.functions.bands import parse_band
from tagweave.operators.sizing import first_per_key
from tagweave.sources import parameters as dims


def _cell(df: DataFrame, *names):
    """First non-blank of the columns that the table has, else blank."""
    present = [n for n in names if n in df.columns]
    return F.coalesce(s.first_present(*present), F.lit("")) if present else F.lit("")


def _number(df: DataFrame, name):
    return s.lenient_number(name) if name in df.columns else F.lit(None).cast("double")


def _band(df: DataFrame, *names):
    """P20: a band column (array or text), else control_lo / control_hi."""
    found = []
    for name in names:
        if name not in df.columns:
            continue
        if dict(df.dtypes)[name].startswith("array"):
            values = F.col(name).cast("array<double>")
            found.append(F.when(F.size(values) >= 2, F.slice(values, 1, 2)))
        else:
            found.append(parse_band(name))
    lo, hi = _number(df, "control_lo"), _number(df, "control_hi")
    return F.coalesce(*found, F.when(lo.isNotNull() & hi.isNotNull(), F.array(lo, hi)))


def _sequence(df: DataFrame):
    """The order of rows: ``seq`` where there is one (see ``files.read_lookup_table``)."""
    return F.col("seq").cast("long") if "seq" in df.columns else F.monotonically_increasing_id()


def normalise_assets(df: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """P25: asset rows; the parameter (by tag, then by id) supplies what is missing."""
    catalogue = dims.parameter_frame(df.sparkSession, parameters)
    by_tag = catalogue.select(F.col("p_tag").alias("_tag"), F.col("param").alias("_tag_param"))
    rows = df.select(
        F.col("*"), _cell(df, "tag", "file_tag").alias("_key"),
        _cell(df, "param", "parameter").alias("_given"), _sequence(df).alias("_seq"))
    rows = rows.filter(F.col("_key") != "").join(F.broadcast(by_tag), F.col("_key") == F.col("_tag"), "left")
    rows = rows.withColumn("_pid", F.coalesce("_tag_param", s.blank_to_null("_given"), F.lit("")))
    details = catalogue.withColumnRenamed("param", "_p")
    rows = rows.join(F.broadcast(details), F.col("_pid") == F.col("_p"), "left")

    def default_band(kind):
        return F.when(F.col("_p").isNotNull(), F.array(f"p_{kind}_lo", f"p_{kind}_hi"))

    def filled(name, fallback):
        return F.coalesce(s.blank_to_null(_cell(df, name)), fallback)

    return rows.select(
        F.col("_key").alias("tag"),
        filled("asset", F.coalesce("p_asset", F.lit(""))).alias("asset"),
        F.col("_pid").alias("parameter"),
        filled("name", F.coalesce("p_name", "_key")).alias("name"),
        filled("unit", F.coalesce("p_unit", F.lit(""))).alias("unit"),
        F.coalesce(_band(df, "control", "spec", "control_band"), default_band("control"),
                   F.array(F.lit(0.0), F.lit(0.0))).alias("control"),
        F.coalesce(_band(df, "alarm"), default_band("alarm")).alias("alarm"),
        F.coalesce(_band(df, "trip"), default_band("trip")).alias("trip"),
        _cell(df, "line").alias("line"), F.col("_seq").alias("seq"))


def normalise_batches(df: DataFrame) -> DataFrame:
    """P25: batch rows under any of the accepted column names."""
    return df.select(*[_cell(df, *names).alias(field) for field, names in fixed.BATCH_COLUMN_NAMES.items()],
                     _sequence(df).alias("seq")).filter(F.col("asset") != "")


def normalise_materials(df: DataFrame) -> DataFrame:
    return df.select(
        _cell(df, "product").alias("product"), _cell(df, "material_no", "material").alias("material_no"),
        _cell(df, "family").alias("family"), _cell(df, "grade").alias("grade"),
        _cell(df, "equipment", "asset").alias("equipment"),
        _cell(df, "spec_source", "sop").alias("spec_source"),
        _sequence(df).alias("seq")).filter(F.col("product") != "")


def normalise_calibrations(df: DataFrame) -> DataFrame:
    return df.select(
        _cell(df, "tag").alias("tag"),
        _cell(df, "probe_calibration_date", "calibration_date").alias("probe_calibration_date"),
        F.floor(_number(df, "calibration_age_days")).cast("int").alias("calibration_age_days"),
        _cell(df, "drift_mv").alias("drift_mv"), _cell(df, "last_maintenance").alias("last_maintenance"),
        _cell(df, "lab_note_ref", "lab_note").alias("lab_note_ref"),
        _sequence(df).alias("seq")).filter(F.col("tag") != "")


def classify_tables(tables: DataFrame) -> DataFrame:
    """Kind of each table (filename, columns) by name words and column set.

    A name word scores 6 once, each expected column 1; the best kind needs 2, and an
    earlier kind wins a tie.
    """
    name = F.lower(F.coalesce(F.col("filename"), F.lit("")))
    columns = F.transform(F.col("columns"), s.field_key)
    scored = []
    for rank, kind in enumerate(fixed.TABLE_NAME_WORDS):
        by_name = F.when(F.exists(F.array(*map(F.lit, fixed.TABLE_NAME_WORDS[kind])),
                                  lambda w: F.contains(name, w)), 6).otherwise(0)
        by_column = F.size(F.array_intersect(columns, F.array(*map(F.lit, fixed.TABLE_COLUMNS[kind]))))
        scored.append(F.struct((by_name + by_column).alias("score"), F.lit(-rank).alias("rank"),
                               F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*scored))
    return (tables.withColumn("score", best["score"].cast("long"))
            .withColumn("kind", F.when(best["score"] >= 2, best["kind"]).otherwise("other")))


def unique_slots(files: DataFrame, order="seq") -> DataFrame:
    """Slug per file name; a clash of different names gets _2, _3 in order of arrival."""
    from pyspark.sql import Window

    named = files.withColumn("_name", F.lower("filename"))
    firsts = named.groupBy("_name").agg(F.min(order).alias("_first"), F.min("filename").alias("_shown"))
    slots = firsts.withColumn("slug", s.slug("_shown"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("_first", "_name"))
    slots = slots.withColumn("_n", place).withColumn(
        "slot", F.when(F.col("_n") == 1, F.col("slug"))
        .otherwise(F.concat_ws("_", F.col("slug"), F.col("_n").cast("string"))))
    return named.join(slots.select("_name", "slot"), "_name").drop("_name")


def active_dataset(datasets: DataFrame, by="kind") -> DataFrame:
    """Per kind the one dataset that joins read: saved first, then the newest."""
    loaded = datasets.filter(F.col("row_count") > 0)
    return first_per_key(loaded, [by], [F.desc("persisted"), F.desc("seq")])


def with_fallback(uploaded: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Uploaded rows, and reference rows only for keys that were not uploaded."""
    reference = reference.withColumn("origin", F.lit("reference"))
    if "seq" not in reference.columns:
        reference = reference.withColumn("seq", F.lit(0).cast("long"))
    if uploaded is None:
        return reference
    kept = reference.join(uploaded.select(key).distinct(), key, "left_anti")
    return uploaded.withColumn("origin", F.lit("upload")).unionByName(kept, allowMissingColumns=True)


def first_match(df: DataFrame, key: str) -> DataFrame:
    """The first row of each lookup key in file order."""
    return first_per_key(df, [key], [F.col("seq")])


def fill_blank_batches(batches: DataFrame, reference: DataFrame) -> DataFrame:
    """An uploaded row without a batch takes the reference batch of its asset.

    ``has_batch`` remembers what was uploaded, because the fallback order looks at that.
    """
    known = reference.select("asset", F.col("batch").alias("_ref_batch"),
                             F.col("product").alias("_ref_product"))
    joined = batches.withColumn("has_batch", F.col("batch") != "").join(
        F.broadcast(known), "asset", "left")
    filled = ~F.col("has_batch") & (F.coalesce(F.col("_ref_batch"), F.lit("")) != "")
    return (joined
            .withColumn("product", F.when(filled & (F.col("product") == ""), F.col("_ref_product"))
                        .otherwise(F.col("product")))
            .withColumn("batch", F.when(filled, F.col("_ref_batch")).otherwise(F.col("batch")))
            .drop("_ref_batch", "_ref_product"))


@dataclass
class Lookups:
    """The four tables that enrichment joins, each with an ``origin`` column."""

    assets: DataFrame
    batches: DataFrame
    materials: DataFrame
    calibrations: DataFrame


def build_lookups(spark: SparkSession, assets=None, batches=None, materials=None,
                  calibrations=None, parameters=dims.BUILT_IN, reference=True) -> Lookups:
    """Normalise uploads and put the built-in tables behind them.

    ``reference=False`` leaves the built-in rows out, for plants whose tables are complete.
    """
    ref_assets = dims.built_in_assets(spark, parameters)
    ref_batches = dims.built_in_batches(spark)
    ref_materials = dims.built_in_materials(spark)
    ref_calibrations = dims.built_in_calibrations(spark, parameters)
    if not reference:
        ref_assets, ref_batches, ref_materials, ref_calibrations = (
            d.limit(0) for d in (ref_assets, ref_batches, ref_materials, ref_calibrations))
    up_assets = None if assets is None else normalise_assets(assets, parameters)
    up_batches = None if batches is None else fill_blank_batches(normalise_batches(batches), ref_batches)
    up_materials = None if materials is None else normalise_materials(materials)
    up_calibrations = None if calibrations is None else normalise_calibrations(calibrations)
    all_batches = with_fallback(up_batches, ref_batches, "asset")
    if "has_batch" not in all_batches.columns:
        all_batches = all_batches.withColumn("has_batch", F.col("batch") != "")
    all_batches = all_batches.withColumn("has_batch", F.coalesce("has_batch", F.col("batch") != ""))
    return Lookups(
        assets=first_match(with_fallback(up_assets, ref_assets, "tag"), "tag"),
        batches=all_batches,
        materials=first_match(with_fallback(up_materials, ref_materials, "product"), "product"),
        calibrations=first_match(with_fallback(up_calibrations, ref_calibrations, "tag"), "tag"))
