"""Reading files (delimited or JSON, long or wide) as rows of text."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.operators.sizing import lookup_join, top_per_key
from tagweave.sources import parameters as dims

HEAD_LINES = 25
BYTE_ORDER_MARK = "\ufeff"


def _key(cell: str) -> str:
    return "".join(c for c in cell.lower() if c.isascii() and c.isalnum())


def header_words(parameters=dims.BUILT_IN) -> list:
    """Match keys of all words that name one of the parameters."""
    known = {p.param for p in parameters}
    words = {w for w, p in fixed.PARAMETER_WORDS.items() if p in known}
    return sorted(words.union(*({_key(t) for t in (p.tag, p.param, p.short, p.name)} for p in parameters)))


def file_delimiters(lines: DataFrame) -> DataFrame:
    """Per file: the delimiter that occurs most in its first lines."""
    heads = top_per_key(lines.filter("block = 0"), ["filename"], [F.col("at")], HEAD_LINES, rank="n")
    files = heads.groupBy("filename").agg(F.array_join(F.collect_list("value"), "\n").alias("_head"))
    counts = F.array(*[F.struct((F.length("_head") - F.length(F.replace("_head", F.lit(d), F.lit("")))).alias("n"),
                                F.lit(-i).alias("turn"), F.lit(d).alias("d")) for i, d in enumerate(fixed.DELIMITERS)])
    return files.select("filename", F.array_max(counts)["d"].alias("delimiter"))


def _ends_open(start: int):
    """Whether a line leaves a quoted cell open; ``start`` is 1 within such a cell, else 2.

    States are 0 in a plain cell, 1 in a quoted cell, 2 behind its closing quote. Only a quote
    at the start of a cell opens it, or one right behind a closing quote (a doubled quote).
    """
    parts = F.split("value", '"')
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    state = F.aggregate(before, F.lit(start), lambda at, p: F.when(at == 1, 2).when((at == 2) & (p == ""), 1).when(
        F.endswith(p, F.col("delimiter")), 1).otherwise(0))
    return F.when(F.contains("value", F.lit('"')), (state == 1).cast("int")).otherwise(int(start == 1))


def _carried(df: DataFrame, window) -> DataFrame:
    """``_fixed`` and ``_flips``, the state before a row: ``_fixed``, else the state before the
    first row of the window, turned over ``_flips`` times.

    ``_f0`` and ``_f1`` are the states that a row ends in when it begins outside and within a quoted cell.
    """
    before, upto = (window.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    df = df.withColumn("_turns", F.sum(((F.col("_f0") == 1) & (F.col("_f1") == 0)).cast("int")).over(upto))
    known = F.when(F.col("_f0") == F.col("_f1"), F.struct(F.col("_f0").alias("state"), F.col("_turns").alias("turns")))
    df = df.withColumn("_known", F.last(known, ignorenulls=True).over(before))
    turns = F.coalesce(F.lag("_turns").over(window), F.lit(0)) - F.coalesce("_known.turns", F.lit(0))
    return df.withColumn("_fixed", F.col("_known.state")).withColumn("_flips", turns % 2).drop("_turns", "_known")


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files: filename, block, at (their order in a block), delimiter and value.

    A record is a line. Only in files where some line leaves a quoted cell open, lines are
    joined until it closes. Such a file is put in order block by block; between blocks one
    row per block is carried: how it ends, and where its last record starts.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.ltrim("value", F.lit(BYTE_ORDER_MARK)).alias("value"))
    lines = lookup_join(lines, file_delimiters(lines), "filename")
    open_files = lines.filter(_ends_open(2) == 1).groupBy("filename").agg(F.lit(True).alias("_open"))
    marked = lookup_join(lines, open_files, "filename")
    broken = marked.filter("_open").withColumn("_f0", _ends_open(2)).withColumn("_f1", _ends_open(1))
    in_block = Window.partitionBy("filename", "block").orderBy("at")
    broken = _carried(broken, in_block)

    def state(start):
        return (F.coalesce("_fixed", start) + F.col("_flips")) % 2

    # Per block and state before it: the state behind its last line, and its last start of a record.
    ends = [F.when(state(F.lit(s)) == 0, F.col("_f0")).otherwise(F.col("_f1")) for s in (0, 1)]
    blocks = broken.groupBy("filename", "block").agg(
        *[F.max_by(ends[s], "at").alias(f"_f{s}") for s in (0, 1)],
        *[F.max(F.when(state(F.lit(s)) == 0, F.col("at"))).alias(f"_last{s}") for s in (0, 1)])
    in_file = Window.partitionBy("filename").orderBy("block")
    blocks = _carried(blocks, in_file).withColumn("_start", state(F.lit(0)))
    last = F.when(F.col("_start") == 0, F.col("_last0")).otherwise(F.col("_last1"))
    own = F.when(last.isNotNull(), F.struct("block", last.alias("at")))
    blocks = blocks.select("filename", "block", "_start", F.last(own, ignorenulls=True).over(
        in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = broken.join(blocks, ["filename", "block"])
    start = F.when(state(F.col("_start")) == 0, F.struct("block", "at"))
    placed = placed.withColumn("_record", F.coalesce(F.last(start, ignorenulls=True).over(
        in_block.rowsBetween(Window.unboundedPreceding, 0)), "_before"))
    joined = placed.groupBy("filename", "_record").agg(
        F.first("delimiter").alias("delimiter"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    joined = joined.select("filename", "_record.block", "_record.at", F.array_join(
        F.transform("p", lambda x: x["value"]), "\n").alias("value"), "delimiter")
    return marked.filter("_open IS NULL").drop("_open").unionByName(joined)


def file_layouts(records: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """S1 + S4, per file: its delimiter, the first line that is a header (else the first line),
    and where the columns are.

    A header names a tag and a value column, or two or more parameters.
    """
    heads = top_per_key(records.filter("block = 0"), ["filename"], [F.col("at")], HEAD_LINES, rank="n")
    files = heads.groupBy("filename").agg(F.first("delimiter").alias("delimiter"),
                                          F.array_sort(F.collect_list(F.struct("at", "value"))).alias("head"))

    def cells(line):
        parts = F.split(line["value"], F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
        names = F.transform(parts, lambda c: F.trim(F.trim(c), F.lit('"')))
        return F.struct(line["at"].alias("at"), names.alias("names"), F.transform(names, s.match_key).alias("keys"))

    words = F.array(*map(F.lit, header_words(parameters)))
    tags, values = (F.array(*map(F.lit, names)) for names in (fixed.TAG_HEADERS, fixed.VALUE_HEADERS))

    def is_header(line):
        named = F.arrays_overlap(line["keys"], tags) & F.arrays_overlap(line["keys"], values)
        return named | (F.size(F.filter(line["keys"], lambda k: F.array_contains(words, k))) >= 2)

    split = files.withColumn("lines", F.transform("head", cells))
    found = split.withColumn("header", F.coalesce(F.try_element_at(F.filter("lines", is_header), F.lit(1)), F.col("lines")[0]))

    def place(names):
        return F.coalesce(*[F.nullif(F.array_position("header.keys", n), F.lit(0)) for n in names])

    found = found.select("filename", "delimiter", F.col("header.at").alias("header_at"), F.size("header.names").alias("width"),
                         place(fixed.TAG_HEADERS).alias("tag_at"), place(fixed.VALUE_HEADERS).alias("value_at"),
                         place(fixed.TIME_HEADERS).alias("time_at"), place(["unit"]).alias("unit_at"),
                         place(["readingid"]).alias("id_at"), "header")
    wide = F.filter(F.transform("header.keys", lambda k, i: F.struct(
        (i + 1).alias("place"), F.element_at("header.names", (i + 1).cast("int")).alias("name"),
        F.array_contains(words, k).alias("known"))), lambda c: c["known"])
    taken = F.array(F.coalesce("time_at", F.lit(0)), F.coalesce("unit_at", F.lit(0)))
    wide = F.filter(wide, lambda c: ~F.array_contains(taken, c["place"].cast("long")))
    return found.withColumn("wide", wide).drop("header")


def read_delimited(spark: SparkSession, path: str, parameters=dims.BUILT_IN) -> DataFrame:
    """Files as rows tag, value, unit, timestamp, reading_id, all text, each file by its own layout.

    The lines up to a file's header are left out by their place. A file with two or more
    parameter columns is wide (S5): a row per filled cell.
    """
    records = file_records(spark, path)
    layouts = file_layouts(records, parameters)
    width = layouts.agg(F.max("width")).first()[0] or 1
    table = lookup_join(records.drop("delimiter"), layouts, "filename", "inner").filter(
        ((F.col("block") > 0) | (F.col("at") > F.col("header_at"))) & (F.trim("value") != ""))
    shape = ", ".join(f"c{i} string" for i in range(width))
    cells = F.coalesce(*[F.when(F.col("delimiter") == d, F.from_csv("value", shape, {"sep": d, "escape": '"'})) for d in fixed.DELIMITERS])
    table = table.withColumn("_c", cells).withColumn("cells", F.array(*[F.trim(F.col(f"_c.c{i}")) for i in range(width)])).drop("_c")

    def cell(place):
        return F.coalesce(F.try_element_at("cells", F.col(place).cast("int")), F.lit(""))

    keep = ["filename", "block", "at"]
    is_wide = F.size("wide") >= 2
    unreadable = F.raise_error(F.concat(F.lit("a tag and a value column, or one column per tag, are needed in "), "filename"))
    long = table.filter(~is_wide).withColumn("tag_at", F.when(
        F.col("tag_at").isNull() | F.col("value_at").isNull(), unreadable.cast("long")).otherwise(F.col("tag_at")))
    long = long.select(*keep, cell("tag_at").alias("tag"), F.try_element_at("cells", F.col("value_at").cast("int")).alias("value"),
                       cell("unit_at").alias("unit"), cell("time_at").alias("timestamp"), cell("id_at").alias("reading_id"))
    filled = table.filter(is_wide).select(*keep, "cells", "unit_at", "time_at", F.explode("wide").alias("w"))
    filled = filled.select(*keep, F.col("w.name").alias("tag"), F.try_element_at("cells", F.col("w.place").cast("int")).alias("value"),
                           cell("unit_at").alias("unit"), cell("time_at").alias("timestamp"), F.lit("").alias("reading_id"))
    return long.filter(F.coalesce("tag", F.lit("")) != "").unionByName(
        filled.filter(s.blank_to_null("value").isNotNull()))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array, or an object with readings, rows or data."""
    row = "tag string, param string, id string, value string, unit string, timestamp string, ts string, reading_id string"
    nested = "array<struct<" + row.replace(" string", ":string") + ">>"
    raw = spark.read.schema(f"{row}, readings {nested}, rows {nested}, data {nested}").option(
        "multiLine", True).json(path)
    fields = [f.split()[0] for f in row.split(", ")]
    lists = [F.when(F.size(c) > 0, F.col(c)) for c in ("readings", "rows", "data")]
    rows = F.coalesce(*lists, F.array(F.struct(*[F.col(f) for f in fields])))
    out = raw.select(F.inline(rows))
    return out.select(s.first_present("tag", "param", "id").alias("tag"), "value",
                      F.coalesce("unit", F.lit("")).alias("unit"),
                      F.coalesce(s.blank_to_null("timestamp"), "ts", F.lit("")).alias("timestamp"),
                      F.coalesce("reading_id", F.lit("")).alias("reading_id")).filter("tag is not null")
