"""Batches that are repeated or broken off at any point leave the tables as one clean run does."""

import pytest
from pyspark.sql import functions as F

from tagweave.operators import audit as au
from tagweave.sources import commits


class Stop(Exception):
    pass


@pytest.fixture
def stop_after(monkeypatch):
    """Let a batch break off after so many of its writes, the manifest counted as one."""
    left = [None]

    def counted(name):
        whole = getattr(commits.Batch, name)

        def step(self, *args):
            if left[0] is not None:
                if left[0] == 0:
                    raise Stop
                left[0] -= 1
            return whole(self, *args)
        monkeypatch.setattr(commits.Batch, name, step)

    for name in ("_write", "commit"):
        counted(name)

    def set_left(n):
        left[0] = n
    return set_left


def keyed(spark, n):
    """Key n % 3 and key 7 change in batch n."""
    return spark.createDataFrame([(n % 3, n), (7, n)], "k int, v int").coalesce(1)


def run(spark, path, n):
    batch = commits.Batch(spark, path, n, "me")
    seen = batch.state(["k"])
    batch.append("log", spark.createDataFrame([(n, seen.count() if seen is not None else 0)], "n int, keys int").coalesce(1))
    batch.change(keyed(spark, n), ["k"])
    batch.commit()


def content(spark, path):
    state = {r.k: r.v for r in commits.read_state(spark, path, ["k"]).collect()}
    return state, sorted(tuple(r) for r in commits.read_table(spark, path, "log").collect())


def expected(last):
    state = {k: max(n for n in range(last + 1) if n % 3 == k) for k in range(3) if k <= last}
    return {**state, 7: last}, [(n, min(n + 1, 4) if n else 0) for n in range(last + 1)]


def test_every_batch_may_be_repeated(spark, path):
    for n in range(25):
        for _ in range(3 if n in (9, 10, 19) else 2):
            run(spark, path, n)
            if n in (9, 10, 19, 24):
                assert content(spark, path) == expected(n)


def test_a_batch_may_stop_after_every_write(spark, path, stop_after, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 2)
    for n in range(6):
        for writes in range(5):
            stop_after(writes)
            try:
                run(spark, path, n)
            except Stop:
                if n:
                    assert committed_batch(spark, path) == n - 1 and content(spark, path) == expected(n - 1)
                else:
                    assert commits.read_table(spark, path, "log") is None and writes < 4
        stop_after(None)
        run(spark, path, n)
        assert committed_batch(spark, path) == n
    assert content(spark, path) == expected(5)


def committed_batch(spark, path):
    return commits.committed(spark, path).batch


def test_old_parts_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 2)
    path = str(tmp_path / "t")
    for n in range(8):
        run(spark, path, n)
    parts = [p for kind in (tmp_path / "t" / "state").iterdir() for p in kind.glob("batch=*/attempt=*")]
    assert len(parts) <= commits.SNAPSHOT_EVERY + 2
    assert len([p for p in (tmp_path / "t" / "manifests").iterdir() if not p.name.startswith(".")]) == 2


def test_another_owner_is_refused(spark, path):
    run(spark, path, 0)
    with pytest.raises(ValueError):
        commits.Batch(spark, path, 0, "another")


def entries(spark, low, high):
    return spark.range(low, high).select((F.col("id") % 2).cast("string").alias("chain"), F.lit("t").alias("ts"), F.lit("a").alias("actor"),
                                         F.lit("x").alias("action"), F.col("id").cast("string").alias("payload"), "id")


def test_the_audit_log_repeats_no_number(spark, path, stop_after):
    """Appends that stop after each of their writes, and are then made."""
    for n in range(3):
        part = entries(spark, 7 * n, 7 * n + 7)
        for writes in range(4):
            stop_after(writes)
            with pytest.raises(Stop):
                au.write_log(part, [F.col("id")], path, 4)
        stop_after(None)
        au.write_log(part, [F.col("id")], path, 4)
    whole = au.append(entries(spark, 0, 21), [F.col("id")], 4)
    log = au.stored_entries(spark, path)
    assert sorted(map(tuple, log.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert all(r.valid for r in au.verify(log, au.stored_seals(spark, path), 4).collect())


def test_a_repeated_append_gives_the_same_rows(spark, path):
    for n in (0, 0, 1, 1, 1):
        au.write_log(entries(spark, 7 * n, 7 * n + 7), [F.col("id")], path, 4, n, "stream")
    log = au.stored_entries(spark, path)
    assert log.count() == 14 and all(r.valid for r in au.verify(log, au.stored_seals(spark, path), 4).collect())
