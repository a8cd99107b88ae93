"""The parameter catalogue and the built-in lookup tables."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tagweave import fixed_values as fixed


class Parameter(NamedTuple):
    param: str
    name: str
    short: str
    unit: str
    tag: str
    asset: str
    control: tuple
    alarm: tuple
    trip: tuple
    drivers: list


BUILT_IN = tuple(Parameter(*row) for row in fixed.PARAMETERS)


def parameter_frame(spark: SparkSession, parameters=BUILT_IN) -> DataFrame:
    """One row per configured parameter. A driver-side constant, so it may be broadcast."""
    rows = [(p.param, p.name, p.short, p.unit, p.tag, p.asset,
             *map(float, p.control), *map(float, p.alarm), *map(float, p.trip),
             list(p.drivers), i) for i, p in enumerate(parameters)]
    return spark.createDataFrame(
        rows, "param string, p_name string, p_short string, p_unit string, p_tag string, "
              "p_asset string, p_control_lo double, p_control_hi double, p_alarm_lo double, "
              "p_alarm_hi double, p_trip_lo double, p_trip_hi double, p_drivers array<string>, "
              "p_order int")


def alias_frame(spark: SparkSession, parameters=BUILT_IN) -> DataFrame:
    """Every word (as a match key) that names a parameter."""
    keys = dict(fixed.PARAMETER_WORDS)
    for p in parameters:
        for token in (p.tag, p.param, p.short, p.name):
            keys["".join(c for c in token.lower() if c.isascii() and c.isalnum())] = p.param
    known = {p.param for p in parameters}
    return spark.createDataFrame([(k, v) for k, v in keys.items() if v in known],
                                 "alias string, alias_param string")


def line_of(asset: str) -> str:
    return fixed.ASSET_LINE.get(asset, fixed.OTHER_LINE)


def topic_line_of(asset: str) -> str:
    return fixed.ASSET_TOPIC_LINE.get(asset, fixed.OTHER_TOPIC_LINE)


def built_in_assets(spark: SparkSession, parameters=BUILT_IN) -> DataFrame:
    return spark.createDataFrame(
        [(p.tag, p.asset, p.param, p.name, p.unit, [float(x) for x in p.control],
          [float(x) for x in p.alarm], [float(x) for x in p.trip], line_of(p.asset))
         for p in parameters],
        "tag string, asset string, parameter string, name string, unit string, "
        "control array<double>, alarm array<double>, trip array<double>, line string")


def built_in_batches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.BATCHES, "asset string, batch string, product string, phase string, "
                       "start string, end string, operator_shift string")


def built_in_materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.MATERIALS, "product string, material_no string, family string, grade string, "
                         "equipment string, spec_source string")


def built_in_calibrations(spark: SparkSession, parameters=BUILT_IN) -> DataFrame:
    return spark.createDataFrame(
        [(p.tag, fixed.CALIBRATION_DATE, fixed.CALIBRATION_AGE_DAYS, str(fixed.CALIBRATION_DRIFT_MV),
          fixed.LAST_MAINTENANCE, fixed.LAB_NOTE_FORMAT.format(param=p.param.upper(), number=i + 1))
         for i, p in enumerate(parameters)],
        "tag string, probe_calibration_date string, calibration_age_days int, drift_mv string, "
        "last_maintenance string, lab_note_ref string")
