"""Versioned datasets and chat turns as append-only tables; "active" is computed, not updated."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.sizing import first_per_key, lookup_join, numbered, top_per_key


def add_version(datasets: DataFrame, rows: DataFrame, new_dataset: DataFrame, new_rows: DataFrame):
    """K7: append a version with its rows; the newest version of a slot is the active one."""
    return (datasets.unionByName(new_dataset, allowMissingColumns=True),
            rows.unionByName(new_rows, allowMissingColumns=True))


def slot_of():
    """A dataset without a slot counts under its kind."""
    return F.coalesce("slot", "kind")


def with_active_flag(datasets: DataFrame) -> DataFrame:
    """K7: is_active marks the newest version of every slot, found by a pre-aggregated maximum."""
    keyed = datasets.withColumn("_slot", slot_of())
    newest = keyed.groupBy("_slot").agg(F.max("dataset_id").alias("_newest"))
    return lookup_join(keyed, newest, "_slot").withColumn(
        "is_active", F.col("dataset_id") == F.col("_newest")).drop("_slot", "_newest")


def active_versions(datasets: DataFrame) -> DataFrame:
    """K8: the newest dataset of every slot."""
    return first_per_key(datasets.withColumn("_slot", slot_of()), ["_slot"], [F.desc("dataset_id")]).drop("_slot")


def active_per_kind(datasets: DataFrame) -> DataFrame:
    """K8: of the active datasets, the oldest of every kind, which lookups restore from."""
    kind = F.coalesce("kind", F.lit("other"))
    return first_per_key(active_versions(datasets).withColumn("kind", kind), ["kind"], [F.col("dataset_id")])


def load_active(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """K8: rows of the active datasets; order them by slot and seq."""
    active = active_versions(datasets).select("dataset_id", slot_of().alias("slot"))
    return lookup_join(rows, active, "dataset_id", "inner")


def delete_slot(datasets: DataFrame, rows: DataFrame, slots: DataFrame = None):
    """K9: drop the datasets of the given slots (or without slot, of that kind) and their rows;
    without ``slots`` drop all.

    Returns the kept datasets, the kept rows and the counts of what was deleted per slot.
    """
    doomed = datasets.withColumn("_slot", slot_of())
    if slots is not None:
        doomed = doomed.join(slots.select(F.col("slot").alias("_slot")).distinct(), "_slot", "left_semi")
    gone = doomed.select("dataset_id", F.col("_slot").alias("slot"))
    kept = lookup_join(datasets, gone.select("dataset_id"), "dataset_id", "left_anti")
    kept_rows = lookup_join(rows, gone.select("dataset_id"), "dataset_id", "left_anti")
    lost = rows.groupBy("dataset_id").agg(F.count("*").alias("_rows"))
    counts = gone.join(lost, "dataset_id", "left").groupBy("slot").agg(
        F.count("*").alias("deleted_datasets"), F.sum(F.coalesce("_rows", F.lit(0))).alias("deleted_readings"))
    return kept, kept_rows, counts


def newest_versions(datasets: DataFrame, n=10) -> DataFrame:
    """The newest n versions."""
    return datasets.orderBy(F.desc("dataset_id")).limit(n)


def append_turns(turns: DataFrame, order, stored: DataFrame = None) -> DataFrame:
    """Chat turns with increasing ids that go on after those of the stored turns; hits and
    chart are kept as JSON text."""
    last = stored.agg(F.max("id")).first()[0] if stored is not None else None
    start = (last or 0) + 1
    ready = turns
    for name in ("hits", "chart"):
        if name in turns.columns and dict(turns.dtypes)[name] != "string":
            ready = ready.withColumn(name, F.to_json(name))
    return numbered(ready, order, start=start, out="id")


def newest_turns(turns: DataFrame, n: int, by="agent") -> DataFrame:
    """The newest n turns of each agent, to be shown oldest first."""
    return top_per_key(turns, [by], [F.desc("id")], n, rank="_n").drop("_n")


def upsert_latest(records: DataFrame, key="key", at="updated_at") -> DataFrame:
    """One row per key, the latest; pre-aggregated per task."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")
