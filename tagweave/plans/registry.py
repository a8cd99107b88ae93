"""Registered queries and their SQL twins."""

from pyspark.sql import DataFrame, SparkSession

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str = None):
    """Register a query under a name, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run_view(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    """A view definition over the supplied tables, run by Spark."""
    return spark.sql(sql, **{t: table(spark, sf, t) for t in tables})
