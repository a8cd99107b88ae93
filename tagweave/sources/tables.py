"""Tables that a job goes on writing."""

from pyspark.sql import SparkSession


def existing(spark: SparkSession, path: str):
    """The table at a path, or None before the first row is written; any other error is raised.

    An empty batch under partition folders leaves a path without data files.
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
