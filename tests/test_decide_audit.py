import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tagweave.operators import audit as au
from tagweave.operators import decide as dc
from tagweave.operators import retrieval as rt
from tagweave.operators import sizing
from tagweave.operators import versions as vs

GENESIS = "0" * 64


@pytest.mark.parametrize("param,zone,confidence,approver", [
    ("ph", "alarm", 0.95, "QA"), ("temp", "trip", 0.95, "QA + Production"), ("temp", "alarm", 0.69, "Shift Lead"),
    ("temp", "alarm", 0.70, None)])
def test_gate(spark, param, zone, confidence, approver):
    row = spark.range(1).select(F.lit(param).alias("param"), F.lit(zone).alias("zone"), F.lit(confidence).alias("c"))
    got = row.select(dc.gate(F.col("c")).alias("g")).first().g
    assert got.approver == approver and got.required == (approver is not None)


@pytest.mark.parametrize("broadcast_rows", [sizing.BROADCAST_ROWS, 2])
def test_answers_are_worked_out_once_per_case(spark, monkeypatch, broadcast_rows):
    """Twenty events of every case: the same answers as event by event, from one row per case."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast_rows)
    index = rt.build_index(rt.built_in_passages(spark))
    cases = [("temp", "OVER", "trip", "Temp", "A-1", "t1", ["jacket", "valve"]), ("temp", "OVER", "trip", "Temp", None, "t1", ["jacket", "valve"]),
             ("temp", "OVER", "trip", "Temp", "", "t1", ["jacket", "valve"]), ("temp", "OVER", "trip", "Temp", "A-1", "t1", ["jacket valve"]),
             ("ph", "UNDER", "alarm", "pH", "A-2", "t2", []), ("other", "OVER", "alarm", "Other", "A-3", None, None),
             ("temp", "OK", "control", "Temp", "A-1", "t1", ["jacket"]), ("do", None, "alarm", "DO", "A-4", "t4", ["air"])]
    events = spark.createDataFrame(
        [(None if i == 3 else f"r{i % 150}", float(i), *cases[i % len(cases)]) for i in range(20 * len(cases))],
        "reading_id string, value double, param string, status string, zone string, short string, asset string, tag string, drivers array<string>")
    wanted = F.coalesce(F.col("status") != "OK", F.lit(False))
    plain = dc.retrieve(events, index, wanted=wanted).withColumn("action_required", wanted)
    plain = plain.withColumn("remedy", F.when(wanted, dc.remedy()))
    plain = dc.with_steps(plain.withColumn("governance", F.when(wanted, dc.gate(F.col("remedy.confidence")))))
    plain = plain.withColumn("steps", F.when(wanted, F.col("steps")))
    answer = ["reading_id", *dc.CASE, "action_required", "hits", "remedy", "governance", "steps"]

    seen, per_row = [], dc.with_steps
    monkeypatch.setattr(dc, "with_steps", lambda rows, *more: seen.append(rows.count()) or per_row(rows, *more))
    want = sorted(map(str, plain.select(*answer).collect()))
    assert sorted(map(str, dc.run_agent(events, index).select(*answer).collect())) == want
    kept = dc.run_agent(events, index, keep=["reading_id"])
    assert "value" not in kept.columns and sorted(map(str, kept.select(*answer).collect())) == want
    assert seen == [6, 6]


def test_commit_order(spark):
    rows = [("reject", "nobody", "", True, "dual e-signature", "REJECTED"), ("commit", "nobody", "", False, "policy", "AUTONOMOUS"),
            ("commit", "operator", "x", True, "dual e-signature", "BLOCKED"), ("commit", "shift_lead", "", True, "dual e-signature", "E-SIGN REQUIRED"),
            ("commit", "shift_lead", "x", True, "dual e-signature", "ESCALATE"), ("commit", "shift_lead", "x", True, "21 CFR Part 11", "BLOCKED"),
            ("commit", "qa", "x", True, "21 CFR Part 11", "ESCALATE"), (None, "nobody", "x", True, "dual", "BLOCKED")]
    data = [(i, a, r, s, "", "A", "p", "t", "z", ("sum",), (q, "ESCALATE", "QA", c)) for i, (a, r, s, q, c, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, action string, role string, signer string, meaning string, asset string, param string, "
                                     "tag string, zone string, remedy struct<summary:string>, "
                                     "governance struct<required:boolean,action:string,approver:string,control:string>")
    got = {r.i: r for r in dc.commit(df).collect()}
    assert [got[i].mode for i in range(len(rows))] == [r[-1] for r in rows]
    assert got[1].actor == "agent" and not got[2].audited and not got[3].audited and got[0].audited


def entries(spark, n, chain="c"):
    return spark.range(n).select(F.lit(chain).alias("chain"), F.lit("t").alias("ts"), F.lit("a").alias("actor"),
                                 F.lit("x").alias("action"), F.col("id").cast("string").alias("payload"), "id")


def start(chain, segment):
    return hashlib.sha256(f"{GENESIS}{chain}#{segment}".encode()).hexdigest()


def python_chain(n, segment, chain="c"):
    out, prev = [], None
    for seq in range(1, n + 1):
        if (seq - 1) % segment == 0:
            prev = start(chain, (seq - 1) // segment)
        body = json.dumps([str(seq), "t", "a", "x", str(seq - 1)], separators=(",", ":"))
        h = hashlib.sha256((prev + body).encode()).hexdigest()
        out.append((seq, prev, h))
        prev = h
    return out


def test_chain_equals_a_loop(spark):
    got = au.append(entries(spark, 50), [F.col("id")], 8).orderBy("seq")
    assert [(r.seq, r.prev_hash, r.hash) for r in got.collect()] == python_chain(50, 8)


def test_a_chain_of_one_segment_is_linear(spark):
    got = au.append(entries(spark, 30), [F.col("id")]).orderBy("seq").collect()
    assert [r.prev_hash for r in got] == [start("c", 0)] + [r.hash for r in got[:-1]]


def test_continued_chain_equals_one_run(spark, path):
    rows = entries(spark, 37)
    whole = au.append(rows, [F.col("id")], 8)
    for part in ("id < 13", "id >= 13 and id < 16", "id >= 16"):
        au.write_log(rows.filter(part), [F.col("id")], path, 8)
    assert sorted(map(tuple, au.stored_entries(spark, path).select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    stored = au.stored_seals(spark, path)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, au.seals(whole).collect()))


@pytest.fixture(scope="module")
def log(spark):
    audit = au.append(entries(spark, 70).unionByName(entries(spark, 3, "d")), [F.col("id")], 4).persist()
    return audit, au.seals(audit).persist()


def state(audit, sealed):
    return {r.chain: (r.valid, r.broken_at) for r in au.verify(audit, sealed, 4).collect()}


def test_verify(spark, log):
    assert state(*log) == {"c": (True, None), "d": (True, None)}


@pytest.mark.parametrize("seq", [1, 4, 5, 33, 70])
def test_any_edit_is_found(spark, log, seq):
    audit, sealed = log
    edited = audit.withColumn("payload", F.when((F.col("chain") == "c") & (F.col("seq") == seq), "z").otherwise(F.col("payload")))
    assert state(edited, sealed) == {"c": (False, seq), "d": (True, None)}


@pytest.mark.parametrize("seq", [1, 2, 4, 33, 70])
def test_a_removed_entry_is_found(spark, log, seq):
    audit, sealed = log
    assert state(audit.filter(f"not (chain = 'c' and seq = {seq})"), sealed)["c"] == (False, seq)


def test_a_rewritten_segment_is_found_by_its_seal(spark, log):
    """A segment replaced as a whole, with hashes that fit each other."""
    audit, sealed = log
    forged = au.append(entries(spark, 70).withColumn("payload", F.lit("forged")), [F.col("id")], 4)
    mixed = audit.filter("not (chain = 'c' and segment = 5)").unionByName(forged.filter("segment = 5"))
    assert state(mixed, sealed)["c"] == (False, 21)


@pytest.mark.parametrize("segment", [0, 7, 17])
def test_a_missing_segment_is_found(spark, log, segment):
    audit, sealed = log
    assert state(audit.filter(f"not (chain = 'c' and segment = {segment})"), sealed)["c"] == (False, 4 * segment + 1)


def test_swapped_segments_and_removed_chains_are_found(spark, log):
    audit, sealed = log
    other = F.when(F.col("segment") == 2, 3).when(F.col("segment") == 3, 2).otherwise(F.col("segment")).cast("long")
    swapped = audit.withColumn("seq", F.when(F.col("chain") == "c", F.col("seq") + 4 * (other - F.col("segment"))).otherwise(F.col("seq"))).withColumn(
        "segment", F.when(F.col("chain") == "c", other).otherwise(F.col("segment")))
    assert state(swapped, sealed)["c"] == (False, 9)
    assert state(audit.filter("chain = 'c'"), sealed) == {"c": (True, None), "d": (False, 1)}


def test_added_entries_are_found(spark, log):
    audit, sealed = log
    longer = au.append(entries(spark, 75).unionByName(entries(spark, 3, "d")), [F.col("id")], 4)
    assert state(longer, sealed)["c"] == (False, 71)


def test_versions(spark):
    data = spark.createDataFrame([(1, "s", "k"), (2, None, "s"), (3, "t", "k")], "dataset_id long, slot string, kind string")
    rows = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "dataset_id long, seq long")
    assert {r.dataset_id for r in vs.active_versions(data).collect()} == {2, 3}
    assert {(r.slot, r.seq) for r in vs.load_active(data, rows).collect()} == {("s", 1), ("s", 2), ("t", 1)}
    kept, kept_rows, counts = vs.delete_slot(data, rows, spark.createDataFrame([("s",)], "slot string"))
    assert [r.dataset_id for r in kept.collect()] == [3] and kept_rows.count() == 1
    assert [tuple(r) for r in counts.collect()] == [("s", 2, 3)]
