"""Control, alarm and trip bands: parsing, status, zone, delta."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.scalars import text

SIGNED = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
PAIR = rf"^\s*({SIGNED})\s*[,;/-]\s*({SIGNED})\s*(?:[,;/-].*)?$"


def status_of(value: Column, lo: Column, hi: Column) -> Column:
    """OVER / UNDER / OK against the control band; NaN or a missing band is OK."""
    return (F.when(F.isnan(value) | lo.isNull() | hi.isNull(), "OK")
            .when(value > hi, "OVER").when(value < lo, "UNDER").otherwise("OK"))


def zone_of(value: Column, control, alarm, trip) -> Column:
    """Inside control, else strictly inside alarm, else trip. NaN lies in no band.

    ``trip`` is the outermost band; what lies beyond it is a trip as well.
    """
    inside = value.between(*control)
    between = (value > alarm[0]) & (value < alarm[1])
    return F.when(inside, "control").when(between, "alarm").otherwise("trip")


def delta_of(status: Column, value: Column, lo: Column, hi: Column) -> Column:
    """Distance beyond the control band, three decimals."""
    return (F.when(status == "OVER", F.round(value - hi, 3))
            .when(status == "UNDER", F.round(lo - value, 3)).otherwise(F.lit(0.0)))


def parse_band(raw) -> Column:
    """P20: ``lo - hi`` text (comma, semicolon, slash or dash between signed numbers)."""
    s = F.translate(text(raw), "–—", "--")
    lo = F.nullif(F.regexp_extract(s, PAIR, 1), F.lit("")).try_cast("double")
    hi = F.nullif(F.regexp_extract(s, PAIR, 2), F.lit("")).try_cast("double")
    return F.when(lo.isNotNull() & hi.isNotNull(), F.array(lo, hi))


def widened(control: Column, factor: float) -> Column:
    """A band wider than control by a share of its width, when none is given."""
    width = F.abs(control[1] - control[0])
    width = F.when(width == 0, F.lit(1.0)).otherwise(width)
    return F.array(control[0] - width * factor, control[1] + width * factor)
