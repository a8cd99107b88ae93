"""Queries of agents, policy, commit, audit and memory."""

from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.operators import audit as au
from tagweave.operators import boards as bd
from tagweave.operators import decide as dc
from tagweave.operators import enrich
from tagweave.plans import fixtures as fx
from tagweave.plans.context_queries import (AUDIT_FOLD_SQL, AUDIT_HASH_SQL, AUDIT_SEGMENT, AUDIT_SQL, SCENARIO_SQL,
                                            audit_log, audit_source)
from tagweave.plans.registry import query, table
from tagweave.plans.text_queries import FOUND_SQL, PASSAGE_CHUNKS, chat_turns, memory, passage_index, search_parts
from tagweave.sources import parameters as dims


def acted(spark, sf, *keep):
    return dc.run_agent(fx.plant_events(spark, sf), passage_index(spark, sf), keep=keep)


def _quoted(value):
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


TEXTS = ["concat(short, ' ', status, ' ', zone, ' excursion on ', asset, ' drivers ', drivers, ' corrective action remedy')",
         "concat('SOP excursion response ', short, ' ', asset, ' setpoint control loop')",
         "concat('CAPA historical root cause ', asset, ' ', short, ' ', tag)"]


@query("u05_query_fan_out", fx.sql(f"""
SELECT reading_id, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS query_rank, unnest(['nl', 'nl', 'nl', 'sql']) AS kind,
  unnest([{', '.join(TEXTS)}, concat({_quoted(fixed.DECOMPOSE_TEXT)}, reading_id, '''')]) AS text FROM plant_flat""", "plant_flat"))
def u05(spark, sf):
    rows = dc.event_queries(fx.plant_events(spark, sf))
    return rows.select("reading_id", F.col("query_rank").cast("long").alias("query_rank"), "kind", "text")


# One request per parameter, status and zone: its three texts, their hits, merged.
REQUESTS = "SELECT DISTINCT param, status, zone, short, asset, drivers, tag FROM {flat} WHERE status <> 'OK'"
ASKED = f"""SELECT concat(param, '/', status, '/', zone, '/', CAST(i AS VARCHAR)) AS query_id, param,
  CASE i WHEN 0 THEN {TEXTS[0]} WHEN 1 THEN {TEXTS[1]} ELSE {TEXTS[2]} END AS query FROM requests, (VALUES (0), (1), (2)) n(i)"""
MERGED = """SELECT request, rank, id, type, ref, score FROM (
  SELECT request, id, type, ref, score, row_number() OVER (PARTITION BY request ORDER BY i, rank) AS rank FROM (
    SELECT regexp_replace(query_id, '/[0-9]$', '') AS request, right(query_id, 1) AS i, rank, id, type, ref, score,
      row_number() OVER (PARTITION BY regexp_replace(query_id, '/[0-9]$', ''), id ORDER BY right(query_id, 1), rank) AS copy
    FROM hits WHERE rank <= CASE WHEN right(query_id, 1) = '0' THEN 3 ELSE 2 END) WHERE copy = 1) WHERE rank <= 3"""
BEST = "SELECT request, list(upper(type) ORDER BY rank) AS types, list(ref ORDER BY rank) AS refs, list(score ORDER BY rank) AS scores FROM merged GROUP BY 1"


def _case(column, values, other="NULL"):
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in values.items()) + f" ELSE {other} END"


def _gate(field):
    rows = [fixed.GATE_PH, fixed.GATE_TRIP, fixed.GATE_LOW_CONFIDENCE, fixed.GATE_AUTONOMOUS]
    ph, trip, low, auto = ["TRUE" if r[field] is True else "FALSE" if r[field] is False else _quoted(r[field]) for r in rows]
    return f"CASE WHEN status = 'OK' THEN NULL WHEN param = 'ph' THEN {ph} WHEN zone = 'trip' THEN {trip} WHEN confidence < 0.7 THEN {low} ELSE {auto} END"


def agent_parts(flat="plant_flat") -> dict:
    parts = {"requests": REQUESTS.format(flat=flat)}
    parts.update(search_parts(PASSAGE_CHUNKS, ASKED, 3))
    parts.update(merged=MERGED, best=BEST, confident=f"""
      SELECT e.*, types, refs, scores, CASE WHEN status = 'OK' THEN NULL WHEN param = 'temp' AND status = 'UNDER' THEN {_quoted(fixed.REMEDY_LOW_TEMP)}
        ELSE {_case('param', fixed.REMEDIES)} END AS summary, refs[1] AS grounded_on,
        round(least(0.95::DOUBLE, 0.6::DOUBLE + scores[1]), 2) AS confidence
      FROM {flat} e LEFT JOIN best ON request = concat(param, '/', status, '/', zone)""",
                 acted=f"""SELECT *, {_gate(0)} AS required, {_gate(1)} AS gate_action, {_gate(2)} AS approver, {_gate(3)} AS control,
        {_gate(4)} AS message FROM confident""")
    return parts


AGENT = agent_parts()


@query("d06_remedy", fx.sql("SELECT reading_id, summary, grounded_on, confidence FROM acted WHERE status <> 'OK'", "plant_flat", **AGENT))
def d06(spark, sf):
    return acted(spark, sf, "reading_id").filter("action_required").select("reading_id", "remedy.summary", "remedy.grounded_on", "remedy.confidence")


def _steps_sql():
    """The step texts filled per parameter, as one CASE per step."""
    out = []
    for n in range(4):
        whens = []
        for p in dims.BUILT_IN:
            body = fixed.STEPS[p.param][n]
            words = {"short": p.short, "mid": round((p.control[0] + p.control[1]) / 2, 2), "unit": p.unit, "lo": p.control[0],
                     "hi": p.control[1], "trip_lo": p.trip[0], "trip_hi": p.trip[1], "driver": p.drivers[0], "asset": p.asset}
            whens.append(f"WHEN '{p.param}' THEN {_quoted(body.format(**words))}")
        out.append(f"CASE param {' '.join(whens)} END")
    return ", ".join(out)


def _cite(kind, fallback):
    return f"CASE WHEN list_contains(types, '{kind}') THEN refs[list_position(types, '{kind}')] ELSE {fallback} END"


@query("d07_action_steps", fx.sql(f"""
SELECT reading_id, CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS n, unnest([{_steps_sql()}]) AS text,
  unnest([{_cite('SOP', 'refs[1]')}, {_cite('OEM', 'refs[2]')}, {_cite('CAPA', 'refs[-1]')}, {_cite('CAPA', 'refs[-1]')}]) AS cite
FROM acted WHERE status <> 'OK'""", "plant_flat", **AGENT))
def d07(spark, sf):
    steps = acted(spark, sf, "reading_id").filter("action_required").select("reading_id", F.inline("steps"))
    return steps.select("reading_id", F.col("n").cast("long").alias("n"), "text", "cite")


@query("d08_governance_gate", fx.sql("""
SELECT reading_id, required, gate_action AS action, approver, control, message FROM acted WHERE status <> 'OK'""", "plant_flat", **AGENT))
def d08(spark, sf):
    return acted(spark, sf, "reading_id").filter("action_required").select("reading_id", "governance.*")


@query("d09_agent_run", fx.sql(f"""
SELECT reading_id, status, status <> 'OK' AS action_required, {_case('param', fixed.AGENT_NAMES)} AS agent_name,
  coalesce(array_to_string(refs, '; '), '') AS citations, coalesce(CAST(array_to_string(list_transform(scores, lambda x: printf('%.3f', x)), '; ') AS VARCHAR), '') AS scores
FROM acted""", "plant_flat", **AGENT))
def d09(spark, sf):
    def joined(fn):
        return F.coalesce(F.array_join(F.transform("hits", fn), "; "), F.lit(""))
    return acted(spark, sf, "reading_id").select("reading_id", "status", "action_required", "agent_name",
                                   joined(lambda h: h["ref"]).alias("citations"),
                                   joined(lambda h: F.format_string("%.3f", h["score"])).alias("scores"))


POLICY_SQL = """
SELECT reading_id, concat('evt-', param) AS event_id, param, asset, tag, zone,
  CASE WHEN param = 'ph' THEN 'always e-sign' ELSE coalesce(control, 'policy gate') END AS ph_rule, 'P(breach) ≥ 0.80' AS threshold_rule,
  CASE zone WHEN 'trip' THEN 0.95::DOUBLE WHEN 'alarm' THEN 0.9::DOUBLE ELSE 0.12::DOUBLE END AS p_breach,
  CASE WHEN required THEN 'E-SIGN REQUIRED' ELSE 'PERMITTED' END AS decision, coalesce(required, FALSE) AS esign_required,
  coalesce(control, '21 CFR Part 11') AS control, coalesce(message, '') AS message, approver FROM acted"""


@query("d10_policy_view", fx.sql(POLICY_SQL, "plant_flat", **AGENT))
def d10(spark, sf):
    return dc.policy_view(acted(spark, sf, "reading_id"))


ROLE_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'qa' WHEN '2-HIGH' THEN 'shift_lead' WHEN '3-MEDIUM' THEN 'operator'
  WHEN '5-LOW' THEN 'agent' ELSE 'visitor' END"""
REQUEST_SQL = f"""
SELECT o_orderkey AS request_id, {ROLE_SQL} AS role, CASE o_orderstatus WHEN 'F' THEN 'Reject' ELSE 'commit' END AS action,
  CASE WHEN o_totalprice < 150000 THEN ' ' ELSE concat('user', CAST(o_custkey AS VARCHAR)) END AS signer,
  CASE WHEN o_totalprice < 250000 THEN 'reviewed' ELSE '' END AS meaning FROM orders"""


def requests(spark, sf):
    """Orders as sign-off requests for the event with the same number."""
    o, priority = table(spark, sf, "orders"), F.col("o_orderpriority")
    role = (F.when(priority == "1-URGENT", "qa").when(priority == "2-HIGH", "shift_lead").when(priority == "3-MEDIUM", "operator")
            .when(priority == "5-LOW", "agent").otherwise("visitor"))
    return o.select(F.col("o_orderkey").alias("request_id"), role.alias("role"),
                    F.when(F.col("o_orderstatus") == "F", "Reject").otherwise("commit").alias("action"),
                    F.when(F.col("o_totalprice") < 150000, " ").otherwise(
                        F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).alias("signer"),
                    F.when(F.col("o_totalprice") < 250000, "reviewed").otherwise("").alias("meaning"))


@query("d11_role_capability", fx.sql("""
SELECT request_id, role, role = 'qa' AS esign, role IN ('qa', 'shift_lead') AS approve_low FROM r""", r=REQUEST_SQL))
def d11(spark, sf):
    rows = dc.with_rights(requests(spark, sf))
    return rows.select("request_id", "role", F.array_contains("rights", "esign").alias("esign"),
                       F.array_contains("rights", "approve_low").alias("approve_low"))


@query("d11_permitted_requests", fx.sql("SELECT request_id, role FROM r WHERE role IN ('qa', 'shift_lead')", r=REQUEST_SQL))
def d11_permitted(spark, sf):
    return dc.permitted(requests(spark, sf), "approve_low").select("request_id", "role")


def committed(spark, sf):
    events = acted(spark, sf, "seq").withColumn("request_id", F.col("seq"))
    return dc.commit(events.join(requests(spark, sf), "request_id"))


COMMIT_SQL = """
SELECT *, mode IN ('AUTONOMOUS', 'ESCALATE') AS committed, mode NOT IN ('BLOCKED', 'E-SIGN REQUIRED') AS audited,
  CASE mode WHEN 'REJECTED' THEN CASE WHEN meaning = '' THEN 'rejected by signer' ELSE meaning END
    WHEN 'BLOCKED' THEN concat('role ''', role, ''' lacks ''', CASE WHEN param = 'ph' THEN 'esign' ELSE 'approve_low' END, '''')
    WHEN 'E-SIGN REQUIRED' THEN 'QA e-signature is required before commit' END AS reason,
  CASE WHEN mode = 'AUTONOMOUS' THEN 'agent' WHEN trim(signer) <> '' THEN signer ELSE role END AS actor,
  CASE mode WHEN 'REJECTED' THEN 'rejected' WHEN 'AUTONOMOUS' THEN 'autonomous_action' ELSE 'approved_with_esignature' END AS audit_action,
  to_json([asset, param, tag, zone, coalesce(summary, ''), coalesce(approver, ''), coalesce(control, ''), signer, meaning, role])::VARCHAR AS payload
FROM (SELECT r.*, e.* EXCLUDE (message), CASE WHEN lower(action) = 'reject' THEN 'REJECTED' WHEN NOT coalesce(required, FALSE) THEN 'AUTONOMOUS'
    WHEN NOT (role = 'qa' OR role = 'shift_lead' AND param <> 'ph') THEN 'BLOCKED' WHEN trim(signer) = '' THEN 'E-SIGN REQUIRED' ELSE 'ESCALATE' END AS mode
  FROM r JOIN acted e ON e.row_index = r.request_id)"""


@query("d12_commit_decision", fx.sql("""
SELECT request_id, mode, committed, audited, reason, actor, audit_action, payload FROM c""", "plant_flat", **AGENT, r=REQUEST_SQL, c=COMMIT_SQL))
def d12(spark, sf):
    return committed(spark, sf).select("request_id", "mode", "committed", "audited", "reason", "actor", "audit_action", "payload")


@query("d13_audit_append", fx.sql("SELECT e.chain, e.segment, e.seq, e.action, h.prev_hash, h.hash FROM e JOIN h USING (chain, segment, seq)",
                                  e=AUDIT_SQL, f=AUDIT_FOLD_SQL, h=AUDIT_HASH_SQL))
def d13(spark, sf):
    return audit_log(spark, sf).select("chain", "segment", "seq", "action", "prev_hash", "hash")


def stored_log(spark, sf):
    """The log written in two parts, with its stored seals."""
    path = fx.scratch(spark, "audit")
    rows = audit_source(spark, sf)
    for part in ("ts < '2024-01-12'", "ts >= '2024-01-12'"):
        au.write_log(rows.filter(part), [F.col("event_id")], path, AUDIT_SEGMENT)
    return au.stored_entries(spark, path), au.stored_seals(spark, path)


@query("d13_audit_seals", fx.sql("""
SELECT chain, segment, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(hash, seq) AS head FROM h GROUP BY chain, segment""",
                                 e=AUDIT_SQL, f=AUDIT_FOLD_SQL, h=AUDIT_HASH_SQL))
def d13_seals(spark, sf):
    """The seals stored while the log was written in two parts, the newest of every segment."""
    return stored_log(spark, sf)[1].select("chain", "segment", "first_seq", "last_seq", "head")


@query("d14_audit_verify", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, user_id % 4 AS deed FROM events),
 n AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS top, CAST((s - 1) // {AUDIT_SEGMENT} AS BIGINT) AS segment FROM s),
 hit AS (SELECT *, CASE deed WHEN 0 THEN props = '{{"k": 7}}' WHEN 1 THEN s = 3 WHEN 2 THEN segment = 1 ELSE FALSE END AS touched FROM n)
SELECT CAST(user_id AS VARCHAR) AS chain, CAST(count(CASE WHEN deed IN (0, 3) OR NOT touched THEN 1 END) AS BIGINT) AS entries,
  count(CASE WHEN touched THEN 1 END) = 0 AS valid, min(CASE WHEN touched THEN s END) AS broken_at FROM hit GROUP BY user_id""")
def d14(spark, sf):
    """Against the stored seals: edited payloads in some chains, a removed entry or a removed
    segment in others; each chain reports its first broken entry."""
    audit, sealed = stored_log(spark, sf)
    deed = F.col("chain").cast("long") % 4
    edited = audit.withColumn("payload", F.when((deed == 0) & (F.col("payload") == '{"k": 7}'), '{"k": 8}').otherwise(F.col("payload")))
    gone = ((deed == 1) & (F.col("seq") == 3)) | ((deed == 2) & (F.col("segment") == 1))
    return au.verify(edited.filter(~gone), sealed, AUDIT_SEGMENT)


MEMORY_SQL = """
SELECT "key", arg_max(reading_id, row_index) AS reading_id, arg_max(zone, row_index) AS zone, arg_max(param, row_index) AS param,
  arg_max(confidence, row_index) AS confidence, arg_max(grounded_on, row_index) AS grounded_on, arg_max(tag, row_index) AS tag,
  arg_max(value, row_index) AS value, arg_max(unit, row_index) AS unit, arg_max(status, row_index) AS status, arg_max(summary, row_index) AS summary
FROM (SELECT *, unnest([concat(param, ':', zone), param, concat('escalation:', zone), 'escalation']) AS "key" FROM acted WHERE status <> 'OK') GROUP BY 1"""


@query("d15_last_remedy_memory", fx.sql('SELECT "key", reading_id, zone, param, confidence FROM m', "plant_flat", **AGENT, m=MEMORY_SQL))
def d15(spark, sf):
    return memory(spark, sf).select("key", "rec.reading_id", "rec.zone", "rec.param", F.col("rec.remedy.confidence").alias("confidence"))


# All turns ask about a trip: the memory of agent and zone, else the agent's if it is of that zone.
ANSWER_SQL = f"""
SELECT query_id, best >= 0.08 AS rag_ok,
  CASE WHEN best >= 0.08 THEN concat_ws(chr(10) || chr(10),
    'Referring to the last SCADA Intelligence ' || zone || ' on ' || reading_id || ' (' ||
      trim(concat(tag, ' ', CAST(value AS VARCHAR), unit)) || ' · ' || status || ').',
    'Automated remedy: ' || summary, texts[1],
    concat('Also see ', types[2], ' ', refs[2], ', ', types[3], ' ', refs[3], ', ', types[4], ' ', refs[4], '.'),
    CASE WHEN agent <> 'temp' THEN {_quoted(fixed.ESCALATION_NOTE)} END)
  ELSE replace({_quoted(fixed.NOT_GROUNDED)}, '{{agent_name}}', CASE agent WHEN 'temp' THEN 'Temperature Agent' ELSE 'Human Escalation Agent' END) END AS answer,
  CASE WHEN best >= 0.08 THEN 'rag' ELSE 'none' END AS source, best < 0.08 AND agent = 'temp' AS suggest_escalation
FROM (SELECT f.*, coalesce(m1."key", CASE WHEN m2.zone = 'trip' THEN m2."key" END) AS "key" FROM ({FOUND_SQL}) f
  LEFT JOIN m m1 ON m1."key" = concat(f.agent, ':trip') LEFT JOIN m m2 ON m2."key" = f.agent) LEFT JOIN m USING ("key")"""


@query("r10_grounded_answer", fx.sql(f"SELECT query_id, answer FROM ({ANSWER_SQL}) WHERE rag_ok", "plant_flat", **AGENT, m=MEMORY_SQL))
def r10(spark, sf):
    got = dc.answer(chat_turns(spark, sf), passage_index(spark, sf), memory(spark, sf))
    return got.filter("rag_ok").select("query_id", "answer")


@query("r11_answer_routing", fx.sql(f"SELECT query_id, source, suggest_escalation, md5(answer) AS digest FROM ({ANSWER_SQL})",
                                    "plant_flat", **AGENT, m=MEMORY_SQL))
def r11(spark, sf):
    got = dc.answer(chat_turns(spark, sf), passage_index(spark, sf), memory(spark, sf))
    return got.select("query_id", "source", "suggest_escalation", F.md5("answer").alias("digest"))


def asked_agents(spark, sf):
    """Every agent and zone that occurs in the events, and the escalation desk."""
    pairs = fx.plant_events(spark, sf).select(F.explode(F.array(F.col("param"), F.lit("escalation"))).alias("agent"), "zone")
    return pairs.distinct()


ASKED_SQL = "SELECT DISTINCT unnest([param, 'escalation']) AS agent, zone FROM plant_flat"
LAST_SQL = """SELECT k.agent, k.zone, coalesce(m1."key", CASE WHEN m2.zone = k.zone THEN m2."key" END) AS "key" FROM k
  LEFT JOIN m m1 ON m1."key" = concat(k.agent, ':', k.zone) LEFT JOIN m m2 ON m2."key" = k.agent"""


@query("d15_last_remedy_lookup", fx.sql('SELECT l.agent, l.zone, m.reading_id, m.confidence FROM l LEFT JOIN m USING ("key")',
                                        "plant_flat", **AGENT, m=MEMORY_SQL, k=ASKED_SQL, l=LAST_SQL))
def d15_lookup(spark, sf):
    got = dc.last_remedy(asked_agents(spark, sf), memory(spark, sf))
    return got.select("agent", "zone", "last.reading_id", F.col("last.remedy.confidence").alias("confidence"))


def _questions_sql():
    def listed(kind, state):
        out = []
        for q in fixed.QUESTIONS[(kind, state)]:
            body = _quoted(q)
            for word, col in (("name", "name"), ("zone", "shown_zone"), ("tag", "p_tag"), ("reading_id", "reading_id"), ("grounded_on", "grounded_on")):
                if "{" + word + "}" in q:
                    body = f"replace({body}, '{{{word}}}', {col})"
            out.append(body)
        return "[" + ", ".join(out) + "]"
    return f"""CASE WHEN agent = 'escalation' AND reading_id IS NOT NULL THEN {listed('escalation', 'remedy')}
      WHEN agent = 'escalation' THEN {listed('escalation', 'no remedy')} WHEN reading_id IS NOT NULL THEN {listed('parameter', 'remedy')}
      ELSE {listed('parameter', 'no remedy')} END"""


QUESTION_SQL = f"""
SELECT agent, zone, {_questions_sql()} AS questions FROM (
  SELECT l.agent, l.zone, coalesce(p_short, agent) AS name, coalesce(m.zone, l.zone) AS shown_zone, coalesce(p_tag, agent) AS p_tag, m.reading_id, m.grounded_on
  FROM l LEFT JOIN m USING ("key") LEFT JOIN params p ON p.param = coalesce(m.param, l.agent))"""


@query("r12_suggested_questions", fx.sql("SELECT agent, zone, unnest(range(1, 6)) AS n, unnest(questions) AS question FROM q", "plant_flat", "params",
                                         **AGENT, m=MEMORY_SQL, k=ASKED_SQL, l=LAST_SQL, q=QUESTION_SQL))
def r12(spark, sf):
    rows = dc.suggested_questions(dc.last_remedy(asked_agents(spark, sf), memory(spark, sf)))
    return rows.select("agent", "zone", F.posexplode("questions").alias("n", "question")).withColumn("n", (F.col("n") + 1).cast("long"))


CYCLE_AUDIT = f"""SELECT asset AS chain, (s - 1) // {AUDIT_SEGMENT} AS segment, s AS seq, request_id, mode,
  to_json([CAST(s AS VARCHAR), "timestamp", actor, audit_action, payload])::VARCHAR AS body
FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY request_id) AS s FROM c WHERE audited)"""


@query("d16_full_cycle", fx.sql("SELECT e.request_id, e.mode, e.chain, e.seq, h.hash FROM e JOIN h USING (chain, segment, seq)", "plant_flat", **AGENT,
                                r=REQUEST_SQL, c=COMMIT_SQL, e=CYCLE_AUDIT, f=AUDIT_FOLD_SQL, h=AUDIT_HASH_SQL))
def d16(spark, sf):
    """Raw reading, event, remedy, decision, audit entry."""
    raw = fx.plant_raw(spark, sf).drop("unit")
    events = enrich.events_of(enrich.enrich(enrich.consume(raw), fx.plant_joinable(spark, sf)))
    acted_on = dc.run_agent(events, passage_index(spark, sf), keep=["row_index", "timestamp"])
    done = dc.commit(acted_on.withColumn("request_id", F.col("row_index"))
                     .join(requests(spark, sf), "request_id"))
    entries = dc.audit_entries(done)
    audit = au.append(entries, [F.col("request_id")], AUDIT_SEGMENT)
    from tagweave.operators.sizing import numbered
    placed = numbered(done.filter("audited").select("request_id", "mode", F.col("asset").alias("chain")), [F.col("request_id")], group=["chain"])
    return placed.join(audit.select("chain", "seq", "hash"), ["chain", "seq"]).select("request_id", "mode", "chain", "seq", "hash")


@query("d17_agent_context", fx.sql("""
SELECT agent, zone, m.reading_id, questions[1] AS first_question, coalesce(t.n, 0) AS turns FROM q JOIN l USING (agent, zone) LEFT JOIN m USING ("key")
LEFT JOIN (SELECT agent, least(count(*), 24) AS n FROM (SELECT CASE role WHEN 'user' THEN 'temp' WHEN 'assistant' THEN 'escalation' ELSE 'nobody' END AS agent FROM conversations) GROUP BY 1) t USING (agent)""",
                                   "plant_flat", "params", **AGENT, m=MEMORY_SQL, k=ASKED_SQL, l=LAST_SQL, q=QUESTION_SQL))
def d17(spark, sf):
    """Last remedy, questions and the 24 newest turns of every agent and zone."""
    turns = chat_turns(spark, sf).withColumn("answer", F.lit("")).withColumn(
        "id", F.split("query_id", "/")[0].cast("long") * 1000000 + F.split("query_id", "/")[1].cast("long"))
    got = dc.agent_context(asked_agents(spark, sf), memory(spark, sf), turns)
    return got.select("agent", "zone", "last.reading_id", F.col("questions")[0].alias("first_question"),
                      F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("turns"))


@query("d18_policy_what_if", fx.sql(POLICY_SQL, "plant_flat", flat=SCENARIO_SQL, **agent_parts("flat")))
def d18(spark, sf):
    """The policy outcome of the newest reading of every parameter and zone, nothing committed."""
    events = bd.scenario_events(fx.plant_readings(spark, sf), fx.plant_joinable(spark, sf))
    return dc.policy_view(dc.run_agent(events, passage_index(spark, sf), keep=["reading_id"]))


