"""Readings to Bronze, Silver and Gold, and the views over them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.operators.sizing import first_per_key, numbered
from tagweave.schemas import BRONZE_COLUMNS, ENVELOPE_VALUE, GOLD_COLUMNS, SILVER_COLUMNS
from tagweave.sources import parameters as dims


def _optional(df: DataFrame, name: str, kind="string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def resolve_parameter(df: DataFrame, token="tag", out="param", parameters=dims.BUILT_IN) -> DataFrame:
    """Tag, then id, then alias words. The two small tables come from configuration."""
    spark = df.sparkSession
    catalogue = dims.parameter_frame(spark, parameters).select("param", "p_tag")
    by_tag = catalogue.select(F.col("p_tag").alias("_tag"), F.col("param").alias("_by_tag"))
    by_id = catalogue.select(F.col("param").alias("_id"), F.col("param").alias("_by_id"))
    aliases = dims.alias_frame(spark, parameters)
    word = F.trim(s.text(token))
    return (df.join(F.broadcast(by_tag), word == F.col("_tag"), "left")
            .join(F.broadcast(by_id), word == F.col("_id"), "left")
            .join(F.broadcast(aliases), s.match_key(word) == F.col("alias"), "left")
            .withColumn(out, F.coalesce("_by_tag", "_by_id", "alias_param"))
            .drop("_tag", "_by_tag", "_id", "_by_id", "alias", "alias_param"))


def pack(rows: DataFrame, source: str, parameters=dims.BUILT_IN, arrival=None) -> DataFrame:
    """S3 + P6: raw rows to the reading contract; unknown tags and bad values are dropped.

    ``rows`` holds tag, value, unit, timestamp and maybe reading_id, filename, row_index
    as text. ``arrival`` stamps rows that carry no time.
    """
    token = s.first_present(*[c for c in ("tag", "param", "id") if c in rows.columns])
    known = resolve_parameter(rows.withColumn("_token", token), "_token", "_param", parameters)
    catalogue = dims.parameter_frame(rows.sparkSession, parameters)
    topic_lines = F.coalesce(*[F.when(F.col("p_asset") == a, F.lit(line))
                               for a, line in fixed.ASSET_TOPIC_LINE.items()],
                             F.lit(fixed.OTHER_TOPIC_LINE))
    uploaded = F.lit(source.startswith("uploaded"))
    number = F.when(F.trim(s.text("value")).rlike(s.NUMBER), F.trim(s.text("value"))).try_cast("double")
    file_unit = F.coalesce(F.trim(s.text(_optional(rows, "unit"))), F.lit(""))
    file_ts = F.coalesce(s.text(_optional(rows, "timestamp")), F.lit(""))
    filename = _optional(rows, "filename")
    given = s.blank_to_null(_optional(rows, "reading_id"))
    joined = known.withColumn("_number", number).filter(
        F.col("_param").isNotNull() & F.col("_number").isNotNull()).join(
        F.broadcast(catalogue), F.col("_param") == catalogue["param"], "inner").drop(catalogue["param"])
    return joined.select(
        F.col("_token").alias("tag"),
        F.round("_number", 3).alias("value"),
        F.coalesce(F.nullif(file_unit, F.lit("")), "p_unit").alias("unit"),
        F.lit("GOOD").alias("quality"),
        F.coalesce(F.nullif(file_ts, F.lit("")), F.lit(arrival)).alias("timestamp"),
        F.when(uploaded, s.file_topic(filename, F.col("_token")))
        .otherwise(s.plant_topic(topic_lines, F.col("p_asset"), F.col("_param"))).alias("uns_topic"),
        F.lit(source).alias("source"),
        F.col("_param").alias("param"),
        F.col("p_asset").alias("asset"),
        F.col("p_short").alias("name"),
        given.alias("reading_id"),
        F.when(uploaded, F.col("_token")).alias("file_tag"),
        F.when(uploaded, file_unit).alias("file_unit"),
        F.when(uploaded, file_ts).alias("file_ts"),
        filename.cast("string").alias("filename"),
        _optional(rows, "row_index", "long").cast("long").alias("row_index"))


def parse_report(rows: DataFrame, parameters=dims.BUILT_IN, order="row_index") -> DataFrame:
    """Rows read, kept and skipped, and every unknown tag with its rows and first place."""
    token = s.first_present(*[c for c in ("tag", "param", "id") if c in rows.columns])
    known = resolve_parameter(rows.withColumn("_token", token), "_token", "_param", parameters)
    number = F.when(F.trim(s.text("value")).rlike(s.NUMBER), F.trim(s.text("value"))).try_cast("double")
    kept = F.col("_param").isNotNull() & number.isNotNull()
    unknown = F.when(F.col("_param").isNull(), F.col("_token"))
    # One pass: counts per unknown tag, which add up to the totals.
    counted = known.groupBy(unknown.alias("tag")).agg(
        F.count("*").alias("raw"), F.count_if(kept).alias("kept"), F.min(order).alias("first_at"))
    lines = counted.select("tag", "first_at", F.explode(F.array(
        F.struct(F.lit("raw").alias("item"), F.col("raw").alias("n_rows")),
        F.struct(F.lit("kept").alias("item"), F.col("kept").alias("n_rows")),
        F.struct(F.lit("skipped").alias("item"), (F.col("raw") - F.col("kept")).alias("n_rows")),
        F.struct(F.lit("unknown").alias("item"), F.when(F.col("tag").isNotNull(), F.col("raw")).alias("n_rows")))).alias("l"))
    total = F.col("l.item") != "unknown"
    return lines.filter(F.col("l.n_rows").isNotNull()).groupBy(
        F.col("l.item").alias("item"), F.when(~total, F.col("tag")).alias("tag")).agg(
        F.sum("l.n_rows").alias("n_rows"), F.min(F.when(~total, F.col("first_at"))).alias("first_at"))


def annotate_file_rows(readings: DataFrame, order, filename="filename") -> DataFrame:
    """Number kept rows per file, keep file fields, and give every row an id."""
    ranked = numbered(readings.drop("row_index"), order, group=[filename], start=1, out="row_index")
    name = F.col(filename)
    tag = F.coalesce("file_tag", "tag")
    return (ranked
            .withColumn("file_tag", tag)
            .withColumn("file_unit", F.coalesce(s.blank_to_null("file_unit"), "unit", F.lit("")))
            .withColumn("file_ts", F.coalesce(s.blank_to_null("file_ts"), "timestamp", F.lit("")))
            .withColumn("tag", tag)
            .withColumn("uns_topic", s.file_topic(name, tag))
            .withColumn("source", F.when(F.col("source").startswith("uploaded"), F.col("source"))
                        .otherwise("uploaded/file"))
            .withColumn("reading_id", F.coalesce(s.blank_to_null("reading_id"),
                                                 s.numbered_id(name, F.col("row_index")))))


def envelopes(readings: DataFrame, arrival=None, parameters=dims.BUILT_IN) -> DataFrame:
    """K6: readings as keyed log envelopes.

    Positions in the log are given by the log. Readings that come from one carry theirs in
    ``partition`` and ``offset``; without these columns both are null until a log assigns them.
    """
    catalogue = dims.parameter_frame(readings.sparkSession, parameters)
    by_id = catalogue.select(F.col("param").alias("_id"), F.col("p_asset").alias("_id_asset"))
    by_tag = catalogue.select(F.col("p_tag").alias("_tag"), F.col("param").alias("_tag_param"),
                              F.col("p_asset").alias("_tag_asset"))
    joined = (readings.join(F.broadcast(by_id), F.col("param") == F.col("_id"), "left")
              .join(F.broadcast(by_tag), F.col("tag") == F.col("_tag"), "left"))
    stamp = F.coalesce(s.blank_to_null("timestamp"), s.blank_to_null(_optional(readings, "file_ts")))
    value = F.struct(
        F.col("tag"), F.col("value").cast("double").alias("value"),
        s.text(_optional(readings, "unit")).alias("unit"), stamp.alias("timestamp"),
        F.coalesce(s.blank_to_null(_optional(readings, "quality")), F.lit("GOOD")).alias("quality"),
        F.coalesce("_id", "_tag_param").alias("param"),
        F.coalesce(s.blank_to_null(_optional(readings, "asset")), "_id_asset", "_tag_asset",
                   F.lit("")).alias("asset"),
        *[_optional(readings, c).alias(c)
          for c in ("name", "uns_topic", "source", "filename", "file_ts", "reading_id")],
        _optional(readings, "row_index", "long").cast("long").alias("row_index"))
    headers = F.create_map(*[F.lit(x) for pair in fixed.LOG_HEADERS.items() for x in pair])
    return joined.filter(F.col("tag").isNotNull()).select(
        F.lit(fixed.TOPIC).alias("topic"), _optional(readings, "partition", "int").cast("int").alias("partition"),
        _optional(readings, "offset", "long").cast("long").alias("offset"), F.col("tag").alias("key"),
        F.coalesce(F.lit(arrival), stamp).alias("timestamp"),
        headers.alias("headers"), value.alias("value"))


def log_records(envelope: DataFrame, *also: str) -> DataFrame:
    """Envelopes as key, value and headers of log records; the log gives them their position.

    ``also`` names envelope columns that a record carries along.
    """
    headers = F.transform(F.map_entries("headers"), lambda h: F.struct(h["key"], h["value"].cast("binary").alias("value")))
    return envelope.select("key", F.to_json("value").alias("value"), headers.alias("headers"), *also)


def from_records(records: DataFrame) -> DataFrame:
    """Records as a log's reader gives them (key, value, topic, partition, offset, timestamp,
    headers) as envelopes. Topic, partition and offset are the record's own."""
    value = F.from_json(F.col("value").cast("string"), ENVELOPE_VALUE)
    names = F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string").alias("value")))
    return records.select(
        "topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"),
        F.col("key").cast("string").alias("key"), F.col("timestamp").cast("string").alias("timestamp"),
        F.map_from_entries(F.coalesce(names, F.array().cast("array<struct<key:string,value:string>>"))).alias("headers"),
        value.alias("value"))


def bronze(envelope: DataFrame) -> DataFrame:
    """K1: the payload as it came, plus its offset and day."""
    v = F.col("value")
    ts_raw = F.coalesce(s.blank_to_null(v["timestamp"]), F.col("timestamp"))

    def filled(name, default=""):
        return F.coalesce(F.nullif(v[name], F.lit("")), F.lit(default)).alias(name)

    return envelope.select(
        F.col("offset").alias("kafka_offset"), F.col("topic").alias("kafka_topic"),
        F.col("partition").cast("int").alias("kafka_partition"),
        filled("tag", "unknown"), v["value"].cast("double").alias("value"), filled("unit"),
        ts_raw.alias("ts_raw"), filled("quality", "GOOD"),
        *[filled(c) for c in ("param", "asset", "name", "uns_topic", "source", "filename")],
        F.lit("bronze").alias("medallion_zone"),
    ).select(*BRONZE_COLUMNS, F.substring("ts_raw", 1, 10).alias("dt"))


def quality_of(column) -> F.Column:
    return F.upper(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("GOOD")))


def usable(value="value", quality="quality"):
    """P10: a value is present and the quality is not BAD in any case."""
    return F.col(value).isNotNull() & (F.upper(F.coalesce(F.col(quality), F.lit("GOOD"))) != "BAD")


def fill_from_catalogue(df: DataFrame, parameters=dims.BUILT_IN, key="tag", on="p_tag") -> DataFrame:
    """Blank param and asset from the catalogue; the unit is always the catalogue's."""
    catalogue = dims.parameter_frame(df.sparkSession, parameters).select(
        F.col("param").alias("_c_param"), F.col("p_asset").alias("_c_asset"),
        F.col("p_unit").alias("_c_unit"), F.col(on if on != "param" else "param").alias("_c_key"))
    joined = df.join(F.broadcast(catalogue), df[key] == F.col("_c_key"), "left")

    def filled(name):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_c_{name}"), F.lit(""))

    return (joined.withColumn("param", filled("param")).withColumn("asset", filled("asset"))
            .withColumn("unit", F.coalesce("_c_unit", F.lit("")))
            .drop("_c_param", "_c_asset", "_c_unit", "_c_key"))


def silver(bronze_rows: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """Conformed readings. The filter comes first so that it reaches the scan."""
    good = bronze_rows.filter(usable())
    return fill_from_catalogue(good, parameters).select(
        "tag", "param", "asset", F.col("value").cast("double").alias("value"), "unit",
        F.col("ts_raw").try_cast("timestamp_ntz").alias("ts"),
        quality_of("quality").alias("quality"), "uns_topic", "source",
        F.col("kafka_offset").alias("bronze_offset"), F.lit("silver").alias("medallion_zone"),
        F.lit(1).alias("schema_version")).select(*SILVER_COLUMNS)


def gold(silver_rows: DataFrame) -> DataFrame:
    """Readings ready to be put in context."""
    return (silver_rows.withColumn("grain", F.lit("reading"))
            .withColumn("ready_for", F.lit("contextualize"))
            .withColumn("medallion_zone", F.lit("gold"))
            .withColumn("context_status", F.lit("pending")).select(*GOLD_COLUMNS))


def with_day(rows: DataFrame, clock="ts") -> DataFrame:
    """The day folder of a row; rows without a readable time share one."""
    return rows.withColumn("dt", F.coalesce(F.col(clock).cast("date").cast("string"), F.lit("unknown")))


def latest_by_time(gold_rows: DataFrame, key="tag") -> DataFrame:
    """Newest reading per tag by its clock, nulls last, later offset on a tie."""
    newest = first_per_key(gold_rows, [key], [F.desc_nulls_last("ts"), F.desc("bronze_offset")])
    return newest.select("tag", "param", "asset", "value", "unit", "ts", "quality", "bronze_offset")


def latest_by_arrival(gold_rows: DataFrame, key="tag", order="bronze_offset") -> DataFrame:
    """The reading that arrived last per tag."""
    keep = gold_rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return first_per_key(keep, [key], [F.desc(order)])


def as_reading(lake_rows: DataFrame) -> DataFrame:
    """Lake rows on the consume contract; the first name present gives each field."""
    def pick(*names, kind="string"):
        present = [F.col(n).cast(kind) for n in names if n in lake_rows.columns]
        return F.coalesce(*present) if present else F.lit(None).cast(kind)

    clocks = [s.clock_text(n) if dict(lake_rows.dtypes)[n].startswith("timestamp") else s.canonical_clock(n)
              for n in ("timestamp", "ts", "ts_raw") if n in lake_rows.columns]
    stamp = F.coalesce(*[F.nullif(c, F.lit("")) for c in clocks])
    source = F.coalesce(s.blank_to_null(pick("source")), F.lit("gold-lake"))
    return lake_rows.select(
        "tag", pick("value", "val", kind="double").alias("value"), pick("unit").alias("unit"),
        F.coalesce(stamp, F.lit("")).alias("timestamp"),
        stamp.try_cast("timestamp_ntz").alias("ts"), pick("param").alias("param"),
        pick("asset").alias("asset"), pick("quality").alias("quality"), source.alias("source"),
        pick("reading_id").alias("reading_id"))


def zone_counts(rows: DataFrame) -> DataFrame:
    """A4: rows and distinct tags of a lake table."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("tag").alias("n_tags"))


def store_statistics(**stores: DataFrame) -> DataFrame:
    """Row count of every store and the latest offset, in one pass per store."""
    out = None
    for name, df in stores.items():
        offset = next((c for c in ("kafka_offset", "bronze_offset", "offset") if c in df.columns), None)
        one = df.agg(F.count("*").alias("n_rows"),
                     (F.max(offset) if offset else F.lit(None)).cast("long").alias("latest_offset"))
        one = one.select(F.lit(name).alias("store"), "n_rows", "latest_offset")
        out = one if out is None else out.unionByName(one)
    return out
