import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions import bands, text
from tagweave.functions import scalars as s
from tagweave.sources.parameters import BUILT_IN


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_lenient_number(spark):
    raw = ["45%", "1,234.5", "", " ", "1.5d", "abc", "1_000", "-3", " 7 % ", "1e3", None, "."]
    assert one(spark, raw, s.lenient_number) == [45.0, 1234.5, None, None, None, None, 1000.0, -3.0, 7.0, 1000.0, None, None]
    assert math.isnan(one(spark, ["NaN"], s.lenient_number)[0])


def test_canonical_clock(spark):
    raw = ["2026-08-14T10:00:00+05:30", "2026-08-14 10:00:00.9 UTC", "2026-08-14 10:00", "2026-08-14",
           "2026-08-14 10:00 UTC", "2026-08-14T10:00:00Z", "2026-08-14T10:00:00.123456-08:00", "garbage", "", None]
    clock = "2026-08-14 10:00:00"
    assert one(spark, raw, s.canonical_clock) == [clock, clock, clock, "2026-08-14 00:00:00", clock, clock, clock,
                                                  "garbage", "", ""]
    assert one(spark, ["garbage", "2026-13-45"], s.clock_of) == [None, None]


def test_clock_does_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in New York that night.
        got = spark.sql("SELECT timestamp_ntz'2026-03-08 02:30:00' AS t").select(s.clock_text("t"), s.epoch_second("t")).first()
        assert got[0] == "2026-03-08 02:30:00" and got[1] == 1772937000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=20))
def test_number_text_survives(spark, values):
    assert one(spark, [f" {v:.3f}% " for v in values], s.lenient_number) == pytest.approx(values)


def test_names_and_ids(spark):
    assert one(spark, ["A b-C", None], s.field_key) == ["a_b_c", None]
    assert one(spark, ["My File (2).csv", "x", "***.txt"], s.slug) == ["my_file_2", "x", "source"]
    assert one(spark, ["/in/Floor data.v2.csv", "", None], lambda c: s.safe_stem(c)) == ["Floor_data_v2", "upload", "upload"]
    got = one(spark, ["a.csv"], lambda c: s.reading_id(F.lit(" "), c, F.lit(7), F.lit("T"), F.lit(1.0), F.lit("")))
    assert got == [f"a-{hashlib.md5(b'a.csv').hexdigest()}-0007"]
    none = F.lit(None).cast("double")
    digest = one(spark, ["T"], lambda c: s.reading_id(F.lit(None), F.lit(None), F.lit(None).cast("int"), c, none, F.lit("")))
    assert digest[0].startswith("R-") and len(digest[0]) == 34


TEMP = BUILT_IN[0]


def pairs_of(p):
    return [tuple(F.lit(x) for x in band) for band in (p.control, p.alarm, p.trip)]


@pytest.mark.parametrize("value,status,zone", [
    (38.0, "OVER", "trip"), (37.5, "OK", "control"), (40.0, "OVER", "trip"), (float("nan"), "OK", "trip"),
    (37.9, "OVER", "alarm"), (36.2, "UNDER", "alarm"), (36.0, "UNDER", "trip"), (35.0, "UNDER", "trip")])
def test_status_and_zone(spark, value, status, zone):
    pairs = pairs_of(TEMP)
    got = spark.range(1).select(bands.status_of(F.lit(value), *pairs[0]), bands.zone_of(F.lit(value), *pairs)).first()
    assert tuple(got) == (status, zone)


def test_bands(spark):
    raw = ["-5 - 10", "36.5–37.5", "5,-10", "-5-10", "1;2;3", "about 7", None, "1e-3 / 2"]
    assert one(spark, raw, bands.parse_band) == [[-5, 10], [36.5, 37.5], [5, -10], [-5, 10], [1, 2], None, None, [0.001, 2]]
    same = spark.range(1).select(bands.widened(F.array(F.lit(3.0), F.lit(3.0)), 0.5)).first()[0]
    assert same == [2.5, 3.5]


def python_chunks(value, size=420):
    """The packing rule, one paragraph at a time."""
    import re
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", value) if p.strip()]
    out, buf = [], ""
    for p in paragraphs:
        if buf and len(buf) + 1 + len(p) > size:
            out.append(buf)
            buf = p
        else:
            buf = buf + "\n\n" + p if buf else p
    out += [buf] if buf else []
    cut = []
    for c in out:
        cut += [c] if len(c) <= 2 * size else [x for x in (c[i:i + size].strip() for i in range(0, len(c), size)) if x]
    return cut


def test_chunks_against_a_loop(spark):
    texts = ["", "  ", "one", "a" * 300 + "\n\n" + "b" * 200 + "\n \t\n" + "c" * 100, "x" * 840, "x" * 841, "é" * 2000,
             "p\n\n" * 500, "\n\n lead \n\n\n\n tail \n \n end ", ("w" * 419 + " ") * 6]
    assert one(spark, texts, text.chunks) == [python_chunks(t) for t in texts]


def test_classifiers(spark):
    names = ["CAPA master.pdf", "Index of SOP", "annex 11 oem", "OEM manual", "my sop", "x", None]
    assert one(spark, names, text.document_type) == ["CAPA", "MASTER_INDEX", "REGULATORY", "OEM", "SOP", "OTHER", "OTHER"]
    assert one(spark, ["auto", "other", "Master Index", "memo"], lambda c: text.document_type(F.lit("capa"), c)) == [
        "CAPA", "OTHER", "MASTER_INDEX", "MEMO"]
    said = ["Reactor Temperature TT-1202B", "the ph is", "none", "temp hum", "pressure and humidity"]
    assert one(spark, said, lambda c: text.guess_parameter(c, BUILT_IN)) == ["temp", "ph", None, "temp", "press"]
    assert one(spark, ["Plot it", "how many TRIP events", "hello", None], text.wants_chart) == [True, True, False, False]
