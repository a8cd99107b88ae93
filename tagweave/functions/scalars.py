"""Column expressions for numbers, clocks, keys and identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))$"
CLOCK = r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2}(:\d{1,2})?)?$"


def text(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("string")


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(text(value)), F.lit(""))


def first_present(*values) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(v) for v in values]) if values else F.lit(None).cast("string")


def lenient_number(value) -> Column:
    """Number from text such as ``45%`` or ``1,234.5``; anything else is null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text(value)), r"%+$", ""), ",", ""))
    bare = F.regexp_replace(bare, r"(?<=\d)_(?=\d)", "")
    return F.when(bare.rlike(NUMBER), bare).try_cast("double")


def clock_text(ts) -> Column:
    """Second-resolution text of a timestamp_ntz, independent of the session time zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.substring(column.cast("timestamp_ntz").cast("string"), 1, 19)


def clock_of(raw) -> Column:
    """Wall-clock timestamp_ntz of raw text, or null when it has no known form."""
    shape = _clock_shape(raw)
    return F.when(shape.rlike(CLOCK), shape).try_cast("timestamp_ntz")


def canonical_clock(raw) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text; unknown forms come back as cleaned text."""
    return F.coalesce(clock_text(clock_of(raw)), _clock_shape(raw), F.lit(""))


def _clock_shape(raw) -> Column:
    s = F.trim(text(raw))
    s = F.regexp_replace(s, r"(?i)\s*UTC$", "")
    s = F.replace(F.replace(s, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    s = F.regexp_replace(F.trim(s), r"^(.{11}[^+-]*)[+-]\d.*$", "$1")
    s = F.regexp_replace(s, r"\..*$", "")
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, 19)


def epoch_second(ts) -> Column:
    """Seconds since 1970 on the wall clock of a timestamp_ntz (no time zone involved)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def canonical_value(number) -> Column:
    """P3 for numeric input: four decimals."""
    column = F.col(number) if isinstance(number, str) else number
    return F.round(column.cast("double"), 4)


def four_decimals(number) -> Column:
    """Fixed text of a number, null for null."""
    return F.when(number.isNotNull(), F.format_string("%.4f", number))


def canonical_value_text(raw) -> Column:
    """P3 for raw text: the number to four decimals, else the trimmed text."""
    number = lenient_number(raw)
    return F.coalesce(four_decimals(F.round(number, 4)), F.trim(text(raw)), F.lit(""))


def match_key(token) -> Column:
    """P5: lower case with everything but letters and digits removed."""
    return F.regexp_replace(F.lower(text(token)), "[^a-z0-9]+", "")


def field_key(name) -> Column:
    """P5: lower case with spaces and hyphens as underscores."""
    return F.translate(F.lower(F.trim(text(name))), " -", "__")


def field_name(name: str) -> str:
    """The same rule for a header known while the job is being built."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def base_name(path) -> Column:
    return F.regexp_replace(text(path), r"^.*[/\\]", "")


def extension(name) -> Column:
    """Lower-case extension without the dot, blank when there is none."""
    return F.lower(F.regexp_extract(base_name(name), r"\.([^.]*)$", 1))


def stem(name) -> Column:
    """File name without folder and extension."""
    base = base_name(name)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def safe_stem(name, size=48, default="upload") -> Column:
    """File stem with unusual characters as underscores."""
    cleaned = F.regexp_replace(stem(F.coalesce(blank_to_null(name), F.lit(default))),
                               r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.substring(cleaned, 1, size), F.lit("")), F.lit(default))


def slug(name, default="source") -> Column:
    """Lower case words joined by underscores, 48 characters."""
    bare = F.regexp_replace(text(name), r"\.[^.]*$", "")
    words = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(words, 1, 48), F.lit("")), F.lit(default))


def file_topic(filename, tag) -> Column:
    """Topic of a reading from a file; the digest keeps files apart whose names begin alike."""
    return F.concat(F.lit("plant/file/"), safe_stem(filename), F.lit("-"), digest(filename), F.lit("/"), text(tag))


def digest(*parts) -> Column:
    """Whole digest of a key's parts, null as blank."""
    return F.md5(F.concat_ws("|", *[F.coalesce(text(p), F.lit("")) for p in parts]))


def plant_topic(line, asset, param) -> Column:
    """Topic of a live reading."""
    return F.concat(F.lit("plant/"), text(line), F.lit("/"), text(asset), F.lit("/"), text(param))


def numbered_id(name, number, size=48, default="upload") -> Column:
    """The name's stem to read, the digest of the whole name to tell files apart, the number."""
    return F.concat(safe_stem(name, size, default), F.lit("-"), digest(name), F.lit("-"),
                    F.format_string("%04d", number.cast("long")))


def reading_id(explicit, name, number, tag, value, clock) -> Column:
    """The given id, else file and row number, else a digest of the reading."""
    return F.coalesce(
        blank_to_null(explicit),
        F.when(number.isNotNull(), numbered_id(name, number, size=24, default="R")),
        F.concat(F.lit("R-"), digest(tag, four_decimals(value.cast("double")), clock)),
    )
