"""Tables that a job changes batch by batch, with one commit for all of them.

A batch writes its rows into folders of its own (table, batch, attempt) and ends with a
manifest, a small file that appears at once. What no manifest names does not exist for a
reader. So a batch that broke off anywhere leaves nothing behind, and a batch that is
repeated, also after it was committed, starts from the commit before it and takes the place
of its earlier attempt.

Append-only tables hold the rows of all batches up to the manifest's. The state holds the
current row of every key: a snapshot and the changes of the batches since, which every
SNAPSHOT_EVERY-th batch joins into a new snapshot. A batch may be repeated until a later one
has begun, so a batch keeps what its own manifest and the one before name, and the next
batch removes what only older ones named.
"""

import json
from collections import namedtuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import create_file, file_text, names_in, remove

SNAPSHOT_EVERY = 10
# parts: the parts of the state, [kind, batch, attempt], the snapshot first.
Manifest = namedtuple("Manifest", "batch attempt owner parts tables")
NOTHING = Manifest(-1, 0, None, [], [])


def manifests(spark: SparkSession, path: str) -> list:
    """(batch, attempt) of every manifest, oldest first."""
    names = [n[:-5].split(".") for n in names_in(spark, f"{path}/manifests") if n.endswith(".json")]
    return sorted((int(batch), int(attempt)) for batch, attempt in names)


def committed(spark: SparkSession, path: str, below: int = None) -> Manifest:
    """The last commit, or the last one of a batch before ``below``."""
    found = [m for m in manifests(spark, path) if below is None or m[0] < below]
    return Manifest(**json.loads(file_text(spark, _manifest(path, *found[-1])))) if found else NOTHING


def _manifest(path: str, batch: int, attempt: int) -> str:
    return f"{path}/manifests/{batch:012d}.{attempt:06d}.json"


def _part(table: str, batch: int, attempt: int) -> str:
    return f"{table}/batch={batch}/attempt={attempt}"


def read_table(spark: SparkSession, path: str, table: str, upto: Manifest = None) -> DataFrame:
    """The committed rows of an append-only table, None before the first commit."""
    upto = upto or committed(spark, path)
    if table not in upto.tables:
        return None
    rows = spark.read.parquet(f"{path}/{table}")
    fine = (F.col("batch") < upto.batch) | ((F.col("batch") == upto.batch) & (F.col("attempt") == upto.attempt))
    return rows.filter(fine).drop("batch", "attempt")


def read_state(spark: SparkSession, path: str, keys, upto: Manifest = None) -> DataFrame:
    """The committed current row of every key, None before the first commit."""
    upto = upto or committed(spark, path)
    if not upto.parts:
        return None
    folders = [f"{path}/state/kind={kind}/{_part('', batch, attempt)[1:]}" for kind, batch, attempt in upto.parts]
    rows = spark.read.option("basePath", f"{path}/state").parquet(*folders)
    rest = [c for c in rows.columns if c not in (*keys, "kind", "batch", "attempt")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


class Batch:
    """One batch in the making; nothing of it shows before ``commit``."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int = None, owner: str = "batch"):
        """``batch_id`` is the number that a repeated batch has again; without one it is the next.

        ``owner`` names who counts the batches, a stream's checkpoint, say: another one would
        count from zero again and is refused.
        """
        last = committed(spark, path)
        if last.owner not in (None, owner):
            raise ValueError(f"{path} belongs to {last.owner}")
        self.spark, self.path, self.owner = spark, path, owner
        self.batch_id = last.batch + 1 if batch_id is None else batch_id
        self.base = committed(spark, path, self.batch_id)
        self.parts, self.tables = list(self.base.parts), set(self.base.tables)
        self._clean()
        used = [n.split("=")[1] for table in self._folders() for n in names_in(spark, f"{table}/batch={self.batch_id}")]
        used += [a for b, a in manifests(spark, path) if b == self.batch_id]
        self.attempt = max(map(int, used), default=-1) + 1

    def _folders(self) -> list:
        tables = [f"{self.path}/{n}" for n in names_in(self.spark, self.path) if n not in ("manifests", "state")]
        return tables + [f"{self.path}/state/{n}" for n in names_in(self.spark, f"{self.path}/state")]

    def _clean(self) -> None:
        """Remove what the commit before this batch does not name and no repetition can need."""
        base = self.base
        named = {f"{self.path}/state/kind={kind}/{_part('', b, a)[1:]}" for kind, b, a in base.parts}
        for folder in self._folders():
            state = "/state/kind=" in folder
            for batch in names_in(self.spark, folder):
                number = int(batch.split("=")[1])
                if number > base.batch or not (state or number == base.batch):
                    continue
                attempts = names_in(self.spark, f"{folder}/{batch}")
                stale = [a for a in attempts if (f"{folder}/{batch}/{a}" not in named if state else a != f"attempt={base.attempt}")]
                for attempt in stale:
                    remove(self.spark, f"{folder}/{batch}/{attempt}")
                if len(stale) == len(attempts):
                    remove(self.spark, f"{folder}/{batch}")
        for batch, attempt in manifests(self.spark, self.path):
            if (batch, attempt) < (base.batch, base.attempt):
                remove(self.spark, _manifest(self.path, batch, attempt))

    def _write(self, rows: DataFrame, table: str) -> DataFrame:
        target = f"{self.path}/{_part(table, self.batch_id, self.attempt)}"
        rows.write.parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows to an append-only table; returns them as they are stored."""
        self.tables.add(table)
        return self._write(rows, table)

    def state(self, keys) -> DataFrame:
        """The state as the batches before this one have left it."""
        return read_state(self.spark, self.path, keys, self.base)

    def part(self, kind: str, rows: DataFrame) -> DataFrame:
        """Write a part of its kind, which stays until ``parts`` no longer names it."""
        self.parts.append([kind, self.batch_id, self.attempt])
        return self._write(rows, f"state/kind={kind}")

    def change(self, rows: DataFrame, keys) -> None:
        """The new rows of the keys that changed, one row per key."""
        self.part("changes", rows)
        if len(self.parts) > SNAPSHOT_EVERY:
            whole = read_state(self.spark, self.path, keys, self._manifest())
            self._write(whole, "state/kind=snapshot")
            self.parts = [["snapshot", self.batch_id, self.attempt]]

    def _manifest(self) -> Manifest:
        return Manifest(self.batch_id, self.attempt, self.owner, self.parts, sorted(self.tables))

    def commit(self) -> None:
        create_file(self.spark, _manifest(self.path, self.batch_id, self.attempt), json.dumps(self._manifest()._asdict()))
