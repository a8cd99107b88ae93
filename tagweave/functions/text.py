"""Text expressions: tokens, chunks, classification of documents and questions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions.scalars import text

# Unicode white space, spelled out so that every regex engine agrees on it.
SPACE = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
BLANK_LINE = rf"\n{SPACE}*\n"


def strip(value) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(column, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(value) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text(value)), F.lit("([a-z0-9]+)"), F.lit(1))


def chunks(value, size: int = fixed.CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily up to ``size``; a chunk above twice that is cut."""
    column = F.col(value) if isinstance(value, str) else value
    paragraphs = F.filter(F.transform(F.split(column, BLANK_LINE), strip), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def pack(state, p):
        full = (state["buf"] != "") & (F.length(state["buf"]) + 1 + F.length(p) > size)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["buf"])))
            .otherwise(state["done"]).alias("done"),
            F.when(full | (state["buf"] == ""), p)
            .otherwise(F.concat(state["buf"], F.lit("\n\n"), p)).alias("buf"))

    packed = F.aggregate(
        paragraphs, empty, pack,
        lambda state: F.when(state["buf"] == "", state["done"])
        .otherwise(F.concat(state["done"], F.array(state["buf"]))))

    def cut(chunk):
        starts = F.sequence(F.lit(1), F.length(chunk), F.lit(size))
        pieces = F.filter(F.transform(starts, lambda i: strip(F.substr(chunk, i, F.lit(size)))),
                          lambda piece: piece != "")
        return F.when(F.length(chunk) <= 2 * size, F.array(chunk)).otherwise(pieces)

    return F.flatten(F.transform(packed, cut))


def document_type(filename, override=None) -> Column:
    """Type by words in the file name, first rule wins; an explicit kind overrides."""
    name = F.lower(F.coalesce(text(filename), F.lit("")))
    by_name = F.lit("OTHER")
    for kind, words in reversed(fixed.DOCUMENT_TYPES):
        by_name = F.when(_contains_any(name, words), F.lit(kind)).otherwise(by_name)
    if override is None:
        return by_name
    given = F.lower(F.coalesce(text(override), F.lit("")))
    key = F.translate(given, " -", "__")
    known = [kind for kind, _ in fixed.DOCUMENT_TYPES] + ["OTHER"]
    return (F.when(given.isin("", "auto"), by_name)
            .when(F.upper(key).isin(known), F.upper(key))
            .otherwise(F.upper(text(override))))


def wants_chart(question) -> Column:
    """The question asks for a chart."""
    return _contains_any(F.lower(F.coalesce(text(question), F.lit(""))), fixed.CHART_WORDS)


def guess_parameter(passage, parameters) -> Column:
    """The parameter a passage speaks of: name +2, tag +2, id as a word +1."""
    low = F.lower(F.coalesce(text(passage), F.lit("")))
    words = F.split(F.trim(F.regexp_replace(low, rf"{SPACE}+", " ")), " ")
    scored = F.array(*[
        F.struct(
            (F.when(low.contains(p.short.lower()) | low.contains(p.name.lower()), 2).otherwise(0)
             + F.when(low.contains(p.tag.lower()), 2).otherwise(0)
             + F.when(F.array_contains(words, p.param), 1).otherwise(0)).alias("score"),
            F.lit(p.param).alias("param"))
        for p in parameters])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["param"])


def _contains_any(value: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | value.contains(word)
    return hit
