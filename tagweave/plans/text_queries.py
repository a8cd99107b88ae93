"""Queries of text retrieval (R), chunk sets (U2-U4) and knowledge base reports."""

from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import text
from tagweave.operators import decide as dc
from tagweave.operators import retrieval as rt
from tagweave.operators.sizing import stored
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import query, table

WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

DOC_CHUNKS = """SELECT concat('D-', CAST(doc_id AS VARCHAR)) AS id, 'OTHER' AS type, concat('doc ', CAST(doc_id AS VARCHAR)) AS ref,
  lang AS param, text, doc_id AS seq, 1 AS piece FROM documents"""
PASSAGE_CHUNKS = fx._values([(*row, i, 1) for i, row in enumerate(fixed.PASSAGES)], "id, type, ref, param, text, seq, piece")
ASKED_PARAM = "CASE WHEN item_id % 5 = 4 THEN 'es' ELSE 'en' END"
ASKED = f"SELECT item_id AS query_id, text AS query, {ASKED_PARAM} AS param FROM benchmark"


def search_parts(chunks: str, queries: str, k: int, name="hits") -> dict:
    """The scorer in SQL: every query against every chunk."""
    return {
        "chunks": chunks, "asked": queries,
        "tf": f"""SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS len
                  FROM (SELECT id, unnest({WORDS.format('text')}) AS term FROM chunks) GROUP BY id, term""",
        "idf": "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM chunks) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term",
        "w": "SELECT id, term, tf::DOUBLE / len::DOUBLE * idf AS w FROM tf JOIN idf USING (term)",
        "norm": "SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id",
        "qtf": f"""SELECT query_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY query_id) AS len
                   FROM (SELECT query_id, unnest({WORDS.format('query')}) AS term FROM asked) GROUP BY query_id, term""",
        "qw": "SELECT query_id, term, tf::DOUBLE / len::DOUBLE * idf AS w FROM qtf JOIN idf USING (term)",
        "qnorm": "SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id",
        "dot": "SELECT query_id, id, sum(qw.w * w.w) AS dot FROM qw JOIN w USING (term) GROUP BY query_id, id",
        "scored": """SELECT q.query_id, c.id, c.seq, c.piece, round(coalesce(dot / (qn.norm * n.norm), 0)
                       + CASE WHEN q.param = c.param THEN 0.15::DOUBLE ELSE 0::DOUBLE END, 9) AS score
                     FROM asked q CROSS JOIN chunks c LEFT JOIN dot d ON d.query_id = q.query_id AND d.id = c.id
                     LEFT JOIN norm n ON n.id = c.id LEFT JOIN qnorm qn ON qn.query_id = q.query_id""",
        name: f"""SELECT query_id, rank, id, type, ref, param, round(score, 3) AS score, text FROM (
                    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC, piece DESC) AS rank FROM scored)
                  JOIN chunks USING (id, seq, piece) WHERE rank <= {k}""",
    }


_INDEXES = {}


def _index(name, spark, sf, make):
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = rt.build_index(make())
    return _INDEXES[key]


def document_index(spark, sf) -> rt.Index:
    return _index("documents", spark, sf, lambda: fx.whole_documents(spark, sf))


def passage_index(spark, sf) -> rt.Index:
    return _index("passages", spark, "", lambda: rt.built_in_passages(spark))


@query("r01_tokenise", f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {WORDS.format('text')} AS t FROM documents)""")
def r01(spark, sf):
    t = F.col("t")
    return table(spark, sf, "documents").select("doc_id", text.tokens("text").alias("t")).select(
        "doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"),
        F.md5(F.array_join(t, " ")).alias("digest"))


@query("r02_idf", fx.sql("SELECT term, df, round(idf, 9) AS idf FROM idf", **search_parts(DOC_CHUNKS, ASKED, 4)))
def r02(spark, sf):
    return document_index(spark, sf).idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query("r03_vectors", fx.sql("""
SELECT id, count(*) AS n_terms, round(max(norm), 9) AS norm, round(max(w), 9) AS top_weight FROM w JOIN norm USING (id) GROUP BY id""",
                             **search_parts(DOC_CHUNKS, ASKED, 4)))
def r03(spark, sf):
    p = document_index(spark, sf).postings
    return p.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.max("norm"), 9).alias("norm"),
                               F.round(F.max("raw"), 9).alias("top_weight"))


@query("r04_cosine_search", fx.sql("SELECT query_id, rank, id, score FROM hits", **search_parts(DOC_CHUNKS, ASKED, 4)))
def r04(spark, sf):
    """Every benchmark text against every document, top four."""
    return rt.search(document_index(spark, sf), fx.questions(spark, sf), 4).select("query_id", "rank", "id", "score")


@query("t05_top_per_query", fx.sql("SELECT query_id, rank, id, score, md5(text) AS text_digest FROM hits",
                                   **search_parts(DOC_CHUNKS, ASKED.replace(ASKED_PARAM, "NULL"), 2)))
def t05(spark, sf):
    """The best two documents of every benchmark text, without a parameter."""
    asked = fx.questions(spark, sf).withColumn("param", F.lit(None).cast("string"))
    return rt.search(document_index(spark, sf), asked, 2).select("query_id", "rank", "id", "score", F.md5("text").alias("text_digest"))


SPACE_SQL = text.SPACE.replace("'", "''")
CHUNK_SQL = f"""
SELECT doc_id, lang, concat('doc ', CAST(doc_id AS VARCHAR), '.txt') AS filename, unnest(range(1, len(pieces) + 1)) AS piece, unnest(pieces) AS text FROM (
 SELECT doc_id, lang, flatten(list_transform(string_split(packed, chr(1)), lambda c: CASE WHEN length(c) <= 840 THEN [c]
   ELSE list_filter(list_transform(range(0, ((length(c) + 419) // 420)::BIGINT), lambda i: regexp_replace(substring(c, (i * 420 + 1)::BIGINT, 420), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')), lambda x: x <> '') END)) AS pieces
 FROM (SELECT doc_id, lang, list_reduce(paras, lambda acc, p: CASE WHEN length(string_split(acc, chr(1))[-1]) + 1 + length(p) > 420
         THEN concat(acc, chr(1), p) ELSE concat(acc, chr(10), chr(10), p) END) AS packed
   FROM (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), concat(chr(10), chr(10))), '\\n{SPACE_SQL}*\\n'),
           lambda p: regexp_replace(p, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')), lambda p: p <> '') AS paras FROM documents) WHERE len(paras) > 0))"""


def document_chunks(spark, sf):
    return rt.chunk_documents(fx.documents(spark, sf))


@query("r05_chunker", fx.sql("SELECT filename, CAST(piece AS BIGINT) AS piece, text FROM c", c=CHUNK_SQL))
def r05(spark, sf):
    return document_chunks(spark, sf).select("filename", "piece", "text")


@query("r06_chunk_identity", fx.sql("""
SELECT concat('UP-', upper(lang), '-doc_', CAST(doc_id AS VARCHAR), '-', md5(concat(filename, '|', lang)), '-', printf('%03d', piece)) AS id,
       concat('doc_', CAST(doc_id AS VARCHAR), ' §', CAST(piece AS VARCHAR)) AS ref, upper(lang) AS type, 'upload' AS source,
       lang AS rag_kind, doc_id AS seq FROM c""", c=CHUNK_SQL))
def r06(spark, sf):
    return document_chunks(spark, sf).select("id", "ref", "type", "source", "rag_kind", "seq")


@query("r06_long_names", fx.sql("SELECT lang AS rag_kind, piece, count(*) AS n_chunks, count(*) AS n_ids FROM c GROUP BY ALL", c=CHUNK_SQL))
def r06_long(spark, sf):
    """Names that agree for 60 characters; every chunk is kept under an id of its own."""
    docs = fx.documents(spark, sf).withColumn("filename", F.concat(F.lit("a long name of the yearly review " * 2), "filename"))
    chunks = rt.chunk_documents(docs)
    kept = rt.append_chunks(chunks.limit(0), chunks)
    return kept.groupBy("rag_kind", "piece").agg(F.count("*").alias("n_chunks"), F.count_distinct("id").alias("n_ids"))


def _earlier_upload(spark, sf):
    """A knowledge base from an earlier run: the passages and older French and Spanish pages."""
    old = table(spark, sf, "documents").filter(F.col("lang").isin("fr", "es")).select(
        F.concat(F.lit("OLD-"), F.col("doc_id").cast("string")).alias("id"), F.lit("OTHER").alias("type"),
        F.col("source").alias("ref"), F.lit(None).cast("string").alias("param"), F.lit("stale words").alias("text"),
        F.lit("upload").alias("source"), F.col("source").alias("filename"),
        F.when(F.col("lang") == "fr", "fr").otherwise("kept").alias("rag_kind"), F.col("doc_id").alias("seq"),
        F.lit(1).cast("long").alias("piece"))
    return rt.built_in_passages(spark).unionByName(old)


@query("r07_index_pipeline", fx.sql(f"""
SELECT kb.id, md5(text) AS text_digest, count(DISTINCT term) AS n_terms, CAST(sum(df) AS BIGINT) AS df_sum FROM kb
LEFT JOIN (SELECT DISTINCT id, unnest({WORDS.format('text')}) AS term FROM kb) t ON t.id = kb.id LEFT JOIN d USING (term) GROUP BY ALL""", c=CHUNK_SQL, kb=f"""
SELECT concat('UP-', upper(lang), '-doc_', CAST(doc_id AS VARCHAR), '-', md5(concat(filename, '|', lang)), '-', printf('%03d', piece)) AS id, text FROM c
UNION ALL SELECT id, text FROM ({PASSAGE_CHUNKS})
UNION ALL SELECT concat('OLD-', CAST(doc_id AS VARCHAR)), 'stale words' FROM documents WHERE lang = 'es'""",
                               d=f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({WORDS.format('text')}) AS term FROM kb) GROUP BY term"))
def r07(spark, sf):
    """Saved documents to chunks, replacing their kinds in the base, to an index."""
    base = rt.replace_kinds(_earlier_upload(spark, sf), document_chunks(spark, sf))
    index = rt.build_index(base)
    own = F.aggregate("words.df", F.lit(0).cast("long"), lambda a, b: a + b)
    sums = index.vectors.select("id", F.size("words").cast("long").alias("n"), own.alias("own")).groupBy("id").agg(
        F.sum("n").alias("n_terms"), F.sum("own").alias("df_sum"))
    return index.chunks.select("id", F.md5("text").alias("text_digest")).join(sums, "id", "left").select(
        "id", "text_digest", F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), "df_sum")


@query("r08_confidence_gate", fx.sql("""
SELECT query_id, max(score) AS best, max(score) >= 0.08 AS confident FROM hits GROUP BY 1""",
                                     **search_parts(DOC_CHUNKS, ASKED.replace(ASKED_PARAM, "NULL"), 6)))
def r08(spark, sf):
    asked = fx.questions(spark, sf).withColumn("param", F.lit(None).cast("string"))
    return rt.confident(rt.search(document_index(spark, sf), asked, 6))


CITED_CHUNKS = DOC_CHUNKS.replace("'OTHER' AS type", "CASE lang WHEN 'en' THEN 'sop' WHEN 'fr' THEN 'OEM' ELSE 'OTHER' END AS type")
LISTS = """SELECT query_id, list(upper(type) ORDER BY rank) AS types, list(ref ORDER BY rank) AS refs FROM hits GROUP BY 1"""


@query("r09_citation_pick", fx.sql("""
SELECT query_id, CASE WHEN list_contains(types, 'SOP') THEN refs[list_position(types, 'SOP')] ELSE refs[1] END AS sop,
       CASE WHEN list_contains(types, 'OEM') THEN refs[list_position(types, 'OEM')] ELSE refs[least(2, len(refs))] END AS oem,
       refs[-1] AS capa FROM l UNION ALL SELECT 1000000 + item_id, 'SOP-BSC-001', 'SOP-BSC-001', 'SOP-BSC-001' FROM benchmark""",
                                   **search_parts(CITED_CHUNKS, ASKED, 3), l=LISTS))
def r09(spark, sf):
    """First hit of a type, else the fallback hit; requests without hits cite the constant."""
    index = document_index(spark, sf)
    kind = F.when(F.col("param") == "en", "sop").when(F.col("param") == "fr", "OEM").otherwise("OTHER")
    typed = index.with_chunks(index.chunks.withColumn("type", kind))
    lists = rt.hit_lists(rt.search(typed, fx.questions(spark, sf), 3))
    none = lists.select((F.col("query_id") + 1000000).alias("query_id"), F.slice("hits", 1, 0).alias("hits"))
    return lists.unionByName(none).select("query_id", rt.citation(F.col("hits"), "SOP", 0).alias("sop"),
                                          rt.citation(F.col("hits"), "OEM", 1).alias("oem"),
                                          rt.citation(F.col("hits"), "CAPA", -1).alias("capa"))


# ---------------------------------------------------------------- chunk sets


@query("u02_append_chunks", """
SELECT concat('UP-', CAST(doc_id AS VARCHAR)) AS id, CASE lang WHEN 'en' THEN 'base' ELSE 'new 0' END AS text FROM documents""")
def u02(spark, sf):
    """English documents exist; all arrive again twice. Existing and repeated ids are skipped."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("UP-"), F.col("doc_id").cast("string")).alias("id"), "lang",
                                                F.col("doc_id").alias("seq"), F.lit(1).cast("long").alias("piece"))
    base = docs.filter("lang = 'en'").drop("lang").withColumn("text", F.lit("base"))
    twice = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    copies = docs.drop("lang", "piece").select("*", F.explode(twice).alias("piece"))
    new = copies.withColumn("text", F.concat(F.lit("new "), F.col("piece").cast("string")))
    return rt.append_chunks(base, new).select("id", "text")


@query("u03_replace_kind", fx.sql(f"""
SELECT coalesce(kind, '-') AS kind, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
 SELECT lang AS kind, text FROM c UNION ALL SELECT NULL, text FROM ({PASSAGE_CHUNKS}) UNION ALL SELECT 'kept', 'stale words' FROM documents WHERE lang = 'es') GROUP BY 1""",
                                  c=CHUNK_SQL))
def u03(spark, sf):
    def measured(chunks):
        return chunks.select("id", "rag_kind", "seq", "piece", F.length("text").alias("chars"))

    base = rt.replace_kinds(measured(_earlier_upload(spark, sf)), measured(document_chunks(spark, sf)))
    return base.groupBy(F.coalesce("rag_kind", F.lit("-")).alias("kind")).agg(
        F.count("*").alias("chunks"), F.sum("chars").alias("chars"))


@query("u04_merge_hits", fx.sql("""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY query_rank, rank) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY query_rank, rank) AS copy FROM (
    SELECT query_id % 8 AS request_id, query_id // 8 AS query_rank, rank, id, score FROM hits)) WHERE copy = 1
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY query_rank, rank) <= 9""", **search_parts(DOC_CHUNKS, ASKED, 4)))
def u04(spark, sf):
    """Benchmark texts grouped into eight requests; nine distinct hits each."""
    hits = rt.search(document_index(spark, sf), fx.questions(spark, sf), 4)
    asked = hits.withColumn("request_id", F.col("query_id") % 8).withColumn("query_rank", F.floor(F.col("query_id") / 8)).drop("query_id")
    return rt.merge_hits(asked, 9).select("request_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@query("a09_kb_statistics", fx.sql("""
SELECT face, name, count(*) AS chunks, count(DISTINCT filename) AS documents FROM (
  SELECT unnest(['all', 'type', 'source']) AS face, unnest(['', upper(lang), 'upload']) AS name, filename FROM c) GROUP BY ALL""", c=CHUNK_SQL))
def a09(spark, sf):
    return rt.kb_statistics(document_chunks(spark, sf))


@query("a09_kb_documents", "SELECT concat('doc ', CAST(doc_id AS VARCHAR), '.txt') AS filename FROM documents")
def a09_documents(spark, sf):
    return rt.kb_documents(document_chunks(spark, sf))


@query("a13_index_report", fx.sql("""
SELECT filename, CAST(strlen(replace(text, chr(10), concat(chr(10), chr(10)))) AS BIGINT) AS bytes,
  CAST(length(replace(text, chr(10), concat(chr(10), chr(10)))) AS BIGINT) AS chars, chunks, CASE WHEN lang = 'en' THEN 0 ELSE chunks END AS added,
  FALSE AS failed FROM documents JOIN (SELECT filename, doc_id, count(*) AS chunks FROM c GROUP BY ALL) USING (doc_id)""", c=CHUNK_SQL))
def a13(spark, sf):
    """English documents were indexed before, so their chunks are not added again."""
    docs = fx.documents(spark, sf)
    chunks, _ = stored(document_chunks(spark, sf).select("id", "filename", "rag_kind", "seq", "piece"), "chunk-ids")
    base = chunks.filter("rag_kind = 'en'")
    added = rt.append_chunks(base.limit(0), chunks.join(base.select("id"), "id", "left_anti"))
    return rt.index_report(docs, chunks, added)


# ---------------------------------------------------------------- co-pilot answers

AGENT_OF = "CASE role WHEN 'user' THEN 'temp' WHEN 'assistant' THEN 'escalation' ELSE 'nobody' END"
TURN_TEXT = "concat(text, CASE WHEN turn < 2 THEN ' temperature excursion on the heat exchanger' ELSE '' END)"
TURNS = f"""SELECT conv_id, turn, concat(CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) AS query_id, trim({TURN_TEXT}) AS query,
  CASE role WHEN 'user' THEN 'temp' END AS param, {AGENT_OF} AS agent FROM conversations"""


def chat_turns(spark, sf):
    """Conversation turns put to the temperature agent and the escalation desk."""
    c = table(spark, sf, "conversations")
    asked = F.concat("text", F.when(F.col("turn") < 2, " temperature excursion on the heat exchanger").otherwise(""))
    agent = F.when(F.col("role") == "user", "temp").when(F.col("role") == "assistant", "escalation").otherwise("nobody")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), agent.alias("agent"), F.lit("trip").alias("zone"),
                    asked.alias("query"))


def memory(spark, sf):
    acted = dc.run_agent(fx.plant_events(spark, sf), passage_index(spark, sf),
                         keep=["seq", "reading_id", "value", "unit", "batch"])
    return dc.remember(acted.filter("action_required"))


# Every turn with its best score and the texts, types and refs of its hits.
FOUND_SQL = fx.sql("""
SELECT a.query_id, CASE agent WHEN 'temp' THEN 'temp' ELSE 'escalation' END AS agent, best, texts, types, refs
FROM asked a JOIN (SELECT query_id, max(score) AS best, list(text ORDER BY rank) AS texts, list(upper(type) ORDER BY rank) AS types,
  list(ref ORDER BY rank) AS refs FROM hits GROUP BY 1) USING (query_id)""", **search_parts(PASSAGE_CHUNKS, TURNS, 6))
