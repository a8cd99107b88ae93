"""TF-IDF index and cosine search over document chunks."""

import math
import uuid
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import fixed_values as fixed
from tagweave.functions import scalars as s
from tagweave.functions import text
from tagweave.operators import sizing
from tagweave.operators.sizing import first_per_key, fits_broadcast, lookup_join, stored, top_per_key
from tagweave.session import scratch_path
from tagweave.sources import parameters as dims
from tagweave.sources.commits import Batch, committed

CHUNK_COLUMNS = ["id", "type", "ref", "param", "text", "source", "filename", "rag_kind", "seq", "piece"]
# Query terms up to this number are broadcast.
QUERY_ROWS = 200_000
# The first pass of a search reads a query's rarest terms, up to about so many postings per hit asked for.
SEED_POSTINGS = 64
# A search that meets more than so many times the postings of the index tries to leave common words out.
PRUNE_ABOVE = 64
# So many postings of a term meet its queries in one place when query terms are not broadcast.
TERM_POSTINGS = 10_000
# Chunks of a bucket of vectors.
BUCKET_CHUNKS = 100_000
# Bounds and scores are sums of doubles in different orders.
MARGIN = 1e-6
# So many segments of one level are merged into one of the next.
MERGE_SEGMENTS = 8


def _idf_of(df, n: int):
    return F.log(F.lit(max(n, 1) + 1) / (df + 1)) + 1


def split_common(known: DataFrame) -> tuple:
    """known(term, df): the most common terms, that fit a broadcast, and the rest (None if there is none).

    They part at a power of two, so that a histogram of as many rows as a count has bits decides.
    """
    size = F.sum(F.octet_length("term") + 24)
    histogram = known.groupBy(F.floor(F.log2("df")).alias("bits")).agg(F.count("*").alias("terms"), size.alias("bytes"))
    least, terms, bytes_ = None, 0, 0
    for row in sorted(histogram.collect(), reverse=True):
        terms, bytes_ = terms + row.terms, bytes_ + row.bytes
        if terms > sizing.BROADCAST_ROWS or bytes_ > sizing.BROADCAST_BYTES:
            least = 2 ** (row.bits + 1)
            break
    if least is None:
        return known, None
    return known.filter(F.col("df") >= least), known.filter(F.col("df") < least)


class Index:
    """What a search reads: chunks, terms(id, seq, piece, param, length, words) and df(term, df).

    Inverse document frequencies belong to all chunks together, so they are summed when they
    are first asked for, and the weights after them; each is written once per index.
    """

    def __init__(self, chunks: DataFrame, terms: DataFrame, df: DataFrame):
        self.chunks, self.terms, self._df = chunks, terms, df

    def with_chunks(self, chunks: DataFrame) -> "Index":
        """The same index, with its vectors, over chunks that carry other columns."""
        self.bounds
        other = copy(self)
        other.chunks = chunks
        return other

    @cached_property
    def _idf(self) -> tuple:
        n = self.terms.count()
        df = self._df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return stored(df.withColumn("idf", _idf_of(F.col("df"), n)), "idf")

    @property
    def idf(self) -> DataFrame:
        """R2: term, df, idf."""
        return self._idf[0]

    @cached_property
    def vectors(self) -> DataFrame:
        """Id, seq, piece, param, norm, words(term, tf, raw, df): raw is tf / length x idf.

        Words meet their document counts where their chunk lies: common words through a
        broadcast, rarer ones, of which there are few postings, through one map per id. Rows are
        kept in buckets by id, so that a search adds up a chunk's words in the task that reads them.
        """
        keys = ["id", "seq", "piece", "param", "length"]
        spark, n = self.terms.sparkSession, self.terms.count()
        # A word that is in neither table is in one chunk, as most of a vocabulary is.
        known = self.idf.filter("df > 1").select("term", "df")
        common, rare = split_common(known)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / BUCKET_CHUNKS))
        # A null id is a key like any other.
        rows = self.terms.withColumn("_key", F.coalesce("id", F.lit("")))
        whole = rows.repartition(buckets, "_key")
        if rare is None:
            whole = whole.withColumn("_df", F.lit(None).cast("long")).select("_key", *keys, "_df", F.inline("words"))
        else:
            looked = rows.select("_key", F.explode("words.term").alias("term")).join(
                F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term")
            maps = looked.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "df"))).alias("_rare"))
            told = F.transform("words", lambda w: F.struct(w["term"].alias("term"), w["tf"].alias("tf"), F.col("_rare")[w["term"]].alias("_df")))
            whole = whole.join(maps, "_key", "left").select("_key", *keys, F.inline(told))
        met = whole.join(F.broadcast(common), "term", "left").withColumn("df", F.coalesce("df", "_df", F.lit(1).cast("long")))
        weighed = met.withColumn("raw", F.col("tf") / F.col("length") * _idf_of(F.col("df"), n))
        whole = weighed.groupBy("_key", *keys).agg(F.collect_list(F.struct("term", "tf", "raw", "df")).alias("words"),
                                                   F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        name = f"vectors_{uuid.uuid4().hex}"
        whole.select("id", "seq", "piece", "param", "norm", "words").write.format("parquet").option(
            "path", scratch_path(spark, name)).bucketBy(buckets, "id").saveAsTable(name)
        return spark.table(name)

    @cached_property
    def held(self) -> int:
        """The number of postings."""
        return self.idf.agg(F.sum("df")).first()[0] or 0

    @property
    def postings(self) -> DataFrame:
        """id, seq, piece, param, norm, term, tf, raw, df, and weight: of unit length per chunk."""
        unit = F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
        return self.vectors.select("id", "seq", "piece", "param", "norm", F.inline("words")).withColumn(
            "weight", F.col("raw") / unit)

    @cached_property
    def bounds(self) -> DataFrame:
        """term, top: the largest weight that a term has in any chunk."""
        return stored(self.postings.groupBy("term").agg(F.max("weight").alias("top")), "bounds")[0]


def built_in_passages(spark: SparkSession) -> DataFrame:
    rows = [(*row, "seed", None, None, i, 1) for i, row in enumerate(fixed.PASSAGES)]
    return spark.createDataFrame(rows, "id string, type string, ref string, param string, text string, "
                                       "source string, filename string, rag_kind string, seq long, piece long")


def chunk_documents(documents: DataFrame, parameters=dims.BUILT_IN) -> DataFrame:
    """R5 + R6: documents(filename, text, kind, seq) to identified chunks.

    An id shows the kind and the stem of the name, cut; the digest of the whole name and kind
    and the piece make it unique.
    """
    name = F.regexp_replace("filename", r"\.[^.]*$", "")
    stem = F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, 40)
    kind = F.col("kind") if "kind" in documents.columns else F.lit(None).cast("string")
    prefix = F.upper(F.substring(F.replace(F.coalesce(kind, F.lit("up")), F.lit("_"), F.lit("")), 1, 8))
    pieces = text.chunks("text")
    whole = F.coalesce(F.nullif(text.strip("text"), F.lit("")), F.concat(F.lit("[file] "), "filename"))
    # As a variable the pieces are made once, not once to be counted and once to be taken.
    pieces = F.flatten(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(whole))))
    cut = documents.select("filename", kind.alias("rag_kind"), F.col("seq").cast("long").alias("seq"),
                           text.document_type(F.col("filename"), kind).alias("type"),
                           stem.alias("_stem"), prefix.alias("_prefix"), s.digest("filename", kind).alias("_digest"),
                           F.posexplode(pieces).alias("_pos", "text"))
    number = F.col("_pos") + 1
    return cut.select(
        F.concat(F.lit("UP-"), "_prefix", F.lit("-"), "_stem", F.lit("-"), "_digest", F.lit("-"),
                 F.format_string("%03d", number)).alias("id"),
        "type", F.concat("_stem", F.lit(" §"), number.cast("string")).alias("ref"),
        text.guess_parameter(F.col("text"), parameters).alias("param"), "text",
        F.lit("upload").alias("source"), "filename", "rag_kind", "seq", number.cast("long").alias("piece"))


def append_chunks(base: DataFrame, new: DataFrame) -> DataFrame:
    """Add chunks, skipping ids that exist and later copies of an id."""
    fresh = first_per_key(new.filter(F.coalesce("id", F.lit("")) != ""), ["id"], [F.col("seq"), F.col("piece")])
    return base.unionByName(fresh.join(base.select("id"), "id", "left_anti"), allowMissingColumns=True)


def replace_kinds(base: DataFrame, new: DataFrame) -> DataFrame:
    """Drop the base chunks of every kind that the new ones bring, then add.

    The new chunks are written once: their kinds and the chunks themselves are read from there.
    """
    new, _ = stored(new, "new-chunks")
    kinds, small = stored(new.select("rag_kind").filter(F.col("rag_kind").isNotNull()).distinct(), "kinds")
    kept = lookup_join(base.withColumnRenamed("rag_kind", "_k"),
                       kinds.select(F.col("rag_kind").alias("_k"), F.lit(True).alias("_new")), "_k", small=small)
    kept = kept.filter(F.col("_new").isNull()).drop("_new").withColumnRenamed("_k", "rag_kind")
    return append_chunks(kept.select(*base.columns), new)


def counted_words(chunks: DataFrame) -> DataFrame:
    """The chunks with _length and _words, an array of (term, tf) in term order.

    Words are sorted and counted inside their row, so nothing is shuffled: a term begins
    where a word differs from the one before and lasts up to the next beginning.
    """
    words = chunks.withColumn("_sorted", F.sort_array(F.coalesce(text.tokens("text"), F.array().cast("array<string>"))))
    places = F.sequence(F.lit(0), F.size("_sorted") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    marked = words.withColumn("_begins", F.when(F.size("_sorted") > 0, begins).otherwise(F.array().cast("array<int>")))
    counted = F.transform("_begins", lambda at, i: F.struct(
        F.get("_sorted", at).alias("term"),
        (F.coalesce(F.get("_begins", i + 1), F.size("_sorted")) - at).cast("long").alias("tf")))
    return marked.withColumn("_length", F.greatest(F.size("_sorted"), F.lit(1)).cast("long")).withColumn(
        "_words", counted).drop("_sorted", "_begins")


def _document_counts(rows: DataFrame, *keys) -> DataFrame:
    terms = rows.select(*keys, F.explode("_words.term").alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("df"))


class SegmentedIndex:
    """An index on disk that grows by immutable segments, one per change.

    A segment holds its chunks with their counted words and its own document counts. Removed
    chunks stay in their segment and are named, with the counts to take off, by the change that
    removed them; frequencies of all chunks are summed when the index is read. The segments of a
    level are merged into the next segment written when there are MERGE_SEGMENTS of them, which
    leaves removed chunks out. A change is one commit: it shows as a whole or not at all,
    and repeating it under its number replaces it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, chunks: DataFrame, change: int = None) -> None:
        """Add chunks; ids that are there and later copies of an id are left out."""
        self._change(chunks, None, None, change)

    def replace(self, chunks: DataFrame, change: int = None) -> None:
        """Remove the chunks of every kind that the new ones bring, then add."""
        kinds = chunks.select("rag_kind").filter(F.col("rag_kind").isNotNull()).distinct()
        self._change(chunks, kinds, "rag_kind", change)

    def remove(self, ids: DataFrame, change: int = None) -> None:
        """Remove chunks by id."""
        self._change(None, ids.select("id").distinct(), "id", change)

    def fill(self, chunks: DataFrame) -> None:
        """Write the first segment from chunks whose ids are known to differ."""
        batch = Batch(self.spark, self.path)
        if batch.base.parts:
            raise ValueError(f"{self.path} holds an index")
        self._write_segment(batch, counted_words(chunks), 0)
        batch.commit()

    def index(self) -> Index:
        """The index as the last commit has it."""
        parts = committed(self.spark, self.path).parts
        rows = self._rows(parts)
        if rows is None:
            raise ValueError(f"{self.path} holds no index")
        live = self._live(rows, parts)
        hidden = ["_length", "_words", "_segment"]
        terms = live.select("id", "seq", "piece", "param", F.col("_length").alias("length"), F.col("_words").alias("words"))
        return Index(live.drop(*hidden), terms, self._counts(parts))

    def segments(self) -> list:
        """(level, change) of every segment, oldest first."""
        return [(int(kind[5:]), number) for kind, number, _ in committed(self.spark, self.path).parts if kind.startswith("rows-")]

    def _change(self, chunks, wanted, key, change) -> None:
        batch = Batch(self.spark, self.path, change)
        parts = list(batch.base.parts)
        rows = self._rows(parts)
        live = None if rows is None else self._live(rows, parts)
        gone = None
        if live is not None and wanted is not None:
            found = lookup_join(live.withColumnRenamed(key, "_key"), wanted.select(F.col(key).alias("_key")), "_key", "left_semi")
            found = found.withColumnRenamed("_key", key)
            gone = batch.part("gone", found.select("id", "_segment"))
            batch.part("lost", _document_counts(found, "_segment").withColumn("df", -F.col("df")))
        if chunks is not None:
            fresh = first_per_key(chunks.filter(F.coalesce("id", F.lit("")) != ""), ["id"], [F.col("seq"), F.col("piece")])
            if live is not None:
                there = live.select("id", "_segment")
                if gone is not None:
                    there = there.join(gone, ["id", "_segment"], "left_anti")
                fresh = fresh.join(there.select("id"), "id", "left_anti")
            self._write_segment(batch, counted_words(fresh), 0)
        batch.commit()

    def _write_segment(self, batch: Batch, rows: DataFrame, level: int) -> None:
        """One segment of the new rows and of the levels that have become full."""
        while True:
            full = [p for p in batch.parts if p[0] == f"rows-{level}"]
            if len(full) < MERGE_SEGMENTS - 1:
                break
            old = self._live(self._rows(full), batch.parts).drop("_segment")
            rows = rows.unionByName(old, allowMissingColumns=True)
            numbers = {number for _, number, _ in full}
            batch.parts = [p for p in batch.parts if not (p[1] in numbers and p[0].split("-")[0] in ("rows", "df"))]
            level += 1
        if not any(p[0].startswith("rows-") for p in batch.parts):
            # Nothing older is left that a removal could name.
            batch.parts = []
        written = batch.part(f"rows-{level}", rows)
        batch.part("df", _document_counts(written))

    def _read(self, parts: list, kind: str) -> DataFrame:
        """The rows of the parts of a kind, None without any; _part is the change that wrote a row."""
        found = [(k, number, attempt) for k, number, attempt in parts if k.split("-")[0] == kind]
        if not found:
            return None
        folders = [f"{self.path}/state/kind={k}/batch={number}/attempt={attempt}" for k, number, attempt in found]
        reader = self.spark.read.option("basePath", f"{self.path}/state").option("mergeSchema", str(len(found) > 1))
        rows = reader.parquet(*folders)
        return rows.withColumn("_part", F.col("batch").cast("long")).drop("kind", "batch", "attempt")

    def _rows(self, parts: list) -> DataFrame:
        rows = self._read(parts, "rows")
        return None if rows is None else rows.withColumnRenamed("_part", "_segment")

    def _live(self, rows: DataFrame, parts: list) -> DataFrame:
        gone = self._read(parts, "gone")
        return rows if gone is None else lookup_join(rows, gone.select("id", "_segment"), ["id", "_segment"], "left_anti")

    def _counts(self, parts: list) -> DataFrame:
        """Document counts, and what removals take off the segments that are still there."""
        counts = self._read(parts, "df").select("term", "df")
        lost = self._read(parts, "lost")
        if lost is None:
            return counts
        numbers = [number for kind, number, _ in parts if kind.startswith("rows-")]
        return counts.unionByName(lost.filter(F.col("_segment").isin(numbers)).select("term", "df"))


def build_index(chunks: DataFrame) -> Index:
    """An index of chunks with distinct ids, as one segment in the shared folder."""
    built = SegmentedIndex(chunks.sparkSession, scratch_path(chunks.sparkSession, "index"))
    built.fill(chunks)
    return built.index()


def query_weights(queries: DataFrame, index: Index) -> DataFrame:
    """Unit-length query vectors; words that no chunk holds weigh nothing."""
    words = queries.select("query_id", F.col("param").alias("q_param"), text.tokens("query").alias("words"))
    counts = (words.select("query_id", "q_param", F.size("words").alias("length"), F.explode("words").alias("term"))
              .groupBy("query_id", "q_param", "length", "term").agg(F.count("*").alias("tf")))
    known = index.idf.select("term", "idf", "df").join(counts, "term")
    known = known.withColumn("raw", F.col("tf") / F.col("length") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    weighed = known.filter(F.col("query_id").isNotNull()).withColumn("q_norm", norm).withColumn(
        "q_weight", F.col("raw") / F.when(F.col("q_norm") == 0, 1.0).otherwise(F.col("q_norm")))
    return weighed.select("query_id", "q_param", "term", "df", "q_weight")


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """``query_weights`` with ``most``, the most that a term can add to the score of any chunk."""
    return _with_most(query_weights(queries, index), index)


def _with_most(weights: DataFrame, index: Index) -> DataFrame:
    return weights.join(index.bounds, "term").withColumn("most", F.col("q_weight") * F.col("top")).drop("top")


HIT = ["query_id", "id", "seq", "piece"]


def _boost():
    return F.when(F.col("q_param") == F.col("param"), fixed.PARAMETER_BOOST).otherwise(0.0)


def _dots(index: Index, terms: DataFrame, small: bool) -> DataFrame:
    """Sum of the products of the given query terms, per chunk that holds one of them.

    Few query terms are broadcast and meet a chunk's words where they lie, and nothing is
    shuffled: words of a chunk are in one bucket. Many meet the broadcast words of a small index
    where their query lies. Else they are shuffled
    by term, once; a common term is spread over as many places as its document count asks for.
    """
    postings, asked = index.postings, terms.drop("df")
    if small:
        met = postings.join(F.broadcast(asked), "term")
    elif index.held <= QUERY_ROWS:
        met = asked.repartition("query_id").join(F.broadcast(postings), "term")
    else:
        places = F.ceil(F.col("df") / TERM_POSTINGS).cast("long")
        asked = terms.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), places - 1))).drop("df")
        met = postings.withColumn("_place", F.pmod(F.xxhash64("id", "seq", "piece"), places)).join(asked, ["term", "_place"])
    return met.groupBy(*HIT, "param", "q_param").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("dot"))


def pruned_terms(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """The terms of every query with what decides which postings are read, and whether they fit a broadcast.

    A first pass scores the rarest terms (``seed``). The k-th best of these sums is a floor
    under the query's k-th best score. The terms of least effect that together cannot lift
    a chunk to the floor are not ``essential``: a chunk that holds no other term of the query
    cannot be among the best. ``unread`` is the most that they add together.
    """
    weights, small = _asked_terms(index, queries)
    return _pruned(index, weights, small, k), small


def _asked_terms(index: Index, queries: DataFrame) -> tuple[DataFrame, bool]:
    """``query_weights``, written once, and whether they fit a broadcast."""
    terms, small = stored(query_weights(queries, index), "query-terms")
    return terms, small and terms.count() <= QUERY_ROWS


def _pruned(index: Index, weights: DataFrame, small: bool, k: int) -> DataFrame:
    terms = _with_most(weights, index)
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.withColumn("seed", F.coalesce(F.sum("df").over(rarest), F.lit(0)) < SEED_POSTINGS * k)
    seeds = terms.filter("seed").select("query_id", "q_param", "term", "df", "q_weight")
    scored = _dots(index, seeds, small).withColumn("score", F.col("dot") + _boost())
    floor = top_per_key(scored.select("query_id", "score"), ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k)
    least = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    together = F.sum("most").over(least) + F.when(F.col("q_param").isNull(), 0.0).otherwise(fixed.PARAMETER_BOOST)
    known = terms.join(floor.select("query_id", F.col("score").alias("floor")), "query_id", "left")
    known = known.withColumn("essential", F.coalesce(together + MARGIN >= F.col("floor"), F.lit(True)))
    unread = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("most"))).over(Window.partitionBy("query_id"))
    return stored(known.withColumn("unread", unread), "pruned-terms")[0]


def search_effort(index: Index, queries: DataFrame, k: int = 4) -> DataFrame:
    """Per query: postings of all its terms, of the first pass, and of the terms that bring up chunks."""
    terms, _ = pruned_terms(index, queries, k)
    return terms.groupBy("query_id").agg(
        F.sum("df").alias("postings"), F.sum(F.when(F.col("seed"), F.col("df")).otherwise(0)).alias("seed_postings"),
        F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("essential_postings"))


def _matched(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Scores of all chunks that can be among the k best of a query by a word of it.

    Every chunk's words are read once and all their products added up where they lie, unless the
    queries meet many times the postings of the index and pruning leaves so few of them that
    the chunks they bring up can be completed one by one.
    """
    terms, small = _asked_terms(index, queries)
    met = terms.agg(F.sum("df")).first()[0] or 0
    if met > PRUNE_ABOVE * index.held:
        pruned = _pruned(index, terms, small, k)
        if (pruned.filter("essential").agg(F.sum("df")).first()[0] or 0) <= sizing.BROADCAST_ROWS:
            return _completed(index, pruned, small)
    return _dots(index, terms, small).select(*HIT, F.round(F.col("dot") + _boost(), 9).alias("score"))


def _completed(index: Index, terms: DataFrame, small: bool) -> DataFrame:
    """Scores from pruned terms.

    Essential terms bring chunks up. Those whose sum could reach the floor with everything that
    was not read are completed from their own row; the words of other chunks are not met.
    """
    essential = terms.filter("essential").select("query_id", "q_param", "term", "df", "q_weight", "floor", "unread")
    parts = _dots(index, essential.drop("floor", "unread"), small)
    limits = essential.groupBy("query_id").agg(F.first("floor").alias("floor"), F.first("unread").alias("unread"))
    parts = parts.join(F.broadcast(limits) if small else limits, "query_id")
    reaches = F.col("floor").isNull() | (F.col("dot") + F.col("unread") + _boost() + MARGIN >= F.col("floor"))
    left, few = stored(parts.filter(reaches).select(*HIT, "param", "q_param", "dot", "unread"), "survivors")
    rest = terms.filter(~F.col("essential")).select("query_id", "term", "q_weight")
    rows = index.vectors.select("id", "seq", "piece", "norm", "words")
    open_ = left.filter("unread > 0").drop("dot", "unread")
    found = rows.join(F.broadcast(open_) if few else open_, ["id", "seq", "piece"])
    unit = F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
    words = found.select(*HIT, "param", "q_param", unit.alias("_unit"), F.inline("words"))
    more = words.join(F.broadcast(rest) if small else rest, ["query_id", "term"]).select(
        *HIT, "param", "q_param", (F.col("q_weight") * F.col("raw") / F.col("_unit")).alias("dot"))
    whole = left.drop("unread").unionByName(more).groupBy(*HIT, "param", "q_param").agg(F.sum("dot").alias("dot"))
    return whole.select(*HIT, F.round(F.col("dot") + _boost(), 9).alias("score"))


def search(index: Index, queries: DataFrame, k: int = 4) -> DataFrame:
    """R4 + T5: top k chunks per query(query_id, query, param) by cosine, boosted by parameter.

    Exact; where it pays, postings of words that decide nothing are not scored (see ``_matched``).
    Each task keeps only its own top k per query before anything is shuffled. Chunks
    that share no word score 0 but may fill the top k: only the k newest chunks overall
    and of the query's parameter can get there, so just those are added.
    """
    order = [F.desc("score"), F.desc("seq"), F.desc("piece")]
    shape = [*HIT, "score"]
    matched = top_per_key(_matched(index, queries, k), ["query_id"], order, k).drop("rank")
    filled = _unmatched(index, queries, k).withColumn("score", _boost()).select(*shape)
    both = matched.unionByName(filled).groupBy(*HIT).agg(F.max("score").alias("score"))
    top = top_per_key(both, ["query_id"], order, k)
    return _with_text(top, index, k)


def _unmatched(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The k newest chunks, and the k newest of every parameter, offered to each query."""
    chunks = index.chunks.select("id", "seq", "piece", "param")
    newest = [F.desc("seq"), F.desc("piece")]
    overall = chunks.orderBy(*newest).limit(k)
    per_param = top_per_key(chunks.filter(F.col("param").isNotNull()), ["param"], newest, k)
    offer = F.collect_list(F.struct("id", "seq", "piece", "param"))
    everyone = overall.agg(offer).scalar()
    asked = queries.select("query_id", F.col("param").alias("q_param"))
    own = per_param.groupBy(F.col("param").alias("q_param")).agg(offer.alias("own"))
    asked = asked.join(own, "q_param", "left")
    both = F.concat(everyone, F.coalesce("own", F.expr("array()").cast(dict(own.dtypes)["own"])))
    return asked.select("query_id", "q_param", F.inline(both))


def _with_text(top: DataFrame, index: Index, k: int) -> DataFrame:
    """Fetch type, ref and text for the hits; the few hits travel, not the chunks."""
    wanted, small = stored(top, "hits")
    body = index.chunks.select("id", "seq", "piece", "type", "ref", "param", "text")
    found = body.join(F.broadcast(wanted) if small else wanted, ["id", "seq", "piece"])
    return found.select("query_id", "rank", "id", "type", "ref", "param",
                        F.round("score", 3).alias("score"), "text")


def hit_lists(hits: DataFrame) -> DataFrame:
    """The hits of a query as one array; its size is bounded by k."""
    hit = F.struct("rank", "id", "type", "ref", "param", "score", "text")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def merge_hits(hits: DataFrame, keep=3) -> DataFrame:
    """U4: hits of several queries of one request (request_id, query_rank, rank), first copy
    of a chunk kept, first ``keep`` left."""
    once = first_per_key(hits, ["request_id", "id"], [F.col("query_rank"), F.col("rank")])
    return top_per_key(once.withColumnRenamed("rank", "_r"), ["request_id"],
                       [F.col("query_rank"), F.col("_r")], keep).drop("_r", "query_rank")


def confident(hits: DataFrame) -> DataFrame:
    """The best score of a query reaches the threshold."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best")).withColumn(
        "confident", F.coalesce(F.col("best") >= fixed.CONFIDENT_SCORE, F.lit(False)))


def citation(hits, prefer: str, fallback: int):
    """Ref of the first hit of the preferred type, else of the fallback hit, else a constant."""
    match = F.try_element_at(F.filter(hits, lambda h: F.upper(h["type"]) == prefer), F.lit(1))
    size = F.size(hits)
    at = F.lit(-1) if fallback < 0 else F.least(F.lit(fallback + 1), size)
    other = F.try_element_at(hits, F.when(size > 0, at).otherwise(F.lit(1)))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, fixed.DEFAULT_CITATION).otherwise(
        F.coalesce(match["ref"], other["ref"]))


def index_report(documents: DataFrame, chunks: DataFrame, added: DataFrame) -> DataFrame:
    """Per file its bytes, characters, chunks and chunks added; empty files are failures."""
    cut = chunks.groupBy("filename").agg(F.count("*").alias("chunks"))
    new = added.groupBy("filename").agg(F.count("*").alias("added"))
    return (documents.select("filename", F.octet_length("text").cast("long").alias("bytes"),
                             F.length("text").cast("long").alias("chars"))
            .join(cut, "filename", "left").join(new, "filename", "left")
            .na.fill(0, ["chunks", "added"])
            .withColumn("failed", F.coalesce(F.col("bytes"), F.lit(0)) == 0))


def kb_statistics(chunks: DataFrame) -> DataFrame:
    """Chunk counts in total, by type and by source, and the number of documents."""
    source = F.coalesce("source", F.lit("seed"))
    faces = F.array(F.struct(F.lit("all").alias("face"), F.lit("").alias("name")),
                    F.struct(F.lit("type").alias("face"), F.col("type").alias("name")),
                    F.struct(F.lit("source").alias("face"), source.alias("name")))
    return chunks.select("filename", F.inline(faces)).groupBy("face", "name").agg(
        F.count("*").alias("chunks"), F.count_distinct("filename").alias("documents"))


def kb_documents(chunks: DataFrame) -> DataFrame:
    """The sorted document names."""
    return chunks.filter(F.col("filename").isNotNull()).select("filename").distinct().orderBy("filename")


