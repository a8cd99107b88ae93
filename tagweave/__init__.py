"""Plant telemetry contextualization as Spark DataFrame, SQL and streaming jobs."""
