"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from pyspark.sql import functions as F

from tagweave.llm import (archive, decontamination, language, line_dedup, packing, piece_merge, preference, quality, simhash,
                          spelling, token_count, url_model, whitening)

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


GRAMS = """unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))"""


@query("op1_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
     sized AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM b WHERE len(ws) > 0),
     dg AS (SELECT DISTINCT doc_id, k, {GRAMS} AS gram FROM d, (SELECT DISTINCT k FROM sized)),
     bg AS (SELECT DISTINCT item_id, k, {GRAMS} AS gram FROM sized),
     size AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id),
     both_ AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (gram, k) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n AS containment
FROM both_ JOIN size USING (item_id) WHERE n_shared * 10000 >= n * 8000
""")
def op1_decontamination(spark, sf):
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_token_counts")
def op2_token_counts(spark, sf):
    return token_count.token_counts(table(spark, sf, "documents"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


MASK = """coalesce(string_agg(CASE WHEN role = 'assistant' AND i > p THEN concat(
    CAST({0}_at AS BIGINT) + 13 + length(role), ':', CAST({0}_at AS BIGINT) + 23 + length(role) + length({0})) END, ',' ORDER BY i), '')"""
RENDER = """'<|im_start|>' || role || chr(10) || {0} || '<|im_end|>' || chr(10)"""


@query("op4_preference_pairs", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
     last_ AS (SELECT conv_id, max(i) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id),
     a AS (SELECT conv_id, i, n, role, text FROM t JOIN last_ USING (conv_id) WHERE i <= n),
     donor AS (SELECT lag(conv_id) OVER (ORDER BY conv_id) AS conv_id, text AS reply FROM a WHERE i = n),
     b AS (SELECT conv_id, i, n, role, text AS a, CASE WHEN i = n THEN coalesce(reply, '') ELSE text END AS b FROM a LEFT JOIN donor USING (conv_id)),
     cut AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE a <> b) - 1, max(n)) AS p FROM b GROUP BY conv_id),
     placed AS (SELECT b.*, p,
                  sum(CASE WHEN i > p THEN length({RENDER.format('a')}) ELSE 0 END) OVER w - CASE WHEN i > p THEN length({RENDER.format('a')}) ELSE 0 END AS a_at,
                  sum(CASE WHEN i > p THEN length({RENDER.format('b')}) ELSE 0 END) OVER w - CASE WHEN i > p THEN length({RENDER.format('b')}) ELSE 0 END AS b_at
                FROM b JOIN cut USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT conv_id, any_value(p) AS n_prompt_turns,
       coalesce(string_agg({RENDER.format('a')}, '' ORDER BY i) FILTER (WHERE i <= p), '') AS prompt,
       coalesce(string_agg({RENDER.format('a')}, '' ORDER BY i) FILTER (WHERE i > p), '') AS chosen, {MASK.format('a')} AS chosen_mask,
       coalesce(string_agg({RENDER.format('b')}, '' ORDER BY i) FILTER (WHERE i > p), '') AS rejected, {MASK.format('b')} AS rejected_mask
FROM placed GROUP BY conv_id
""")
def op4_preference_pairs(spark, sf):
    return preference.formatted(table(spark, sf, "conversations"))


@query("op8_url_model")
def op8_url_model(spark, sf):
    return url_model.judged(table(spark, sf, "pages"))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf):
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_language_mixture")
def op6_language_mixture(spark, sf):
    return language.identified(table(spark, sf, "documents"))


@query("op7_line_dedup", """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
     r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < holder) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
""")
def op7_line_dedup(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents"))


@query("op9_warc_archive", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, url, strlen(h) AS bytes, sha256(h) AS digest FROM p),
     o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM d)
SELECT page_id, coalesce(url, '') AS url, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM o
""")
def op9_warc_archive(spark, sf):
    return archive.archived(table(spark, sf, "pages"))


@query("op10_simhash")
def op10_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf):
    return piece_merge.digests(table(spark, sf, "documents"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf):
    found = whitening.whitened(table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
