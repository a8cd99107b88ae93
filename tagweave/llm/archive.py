"""A content-addressed WARC archive.

``payloads`` holds the bytes of every distinct payload once, under its SHA-256 digest;
``records`` holds the exact header block of every record, apart from the payloads. A record
of the archive is its header block, an empty line, its body and two line ends. The body of a
response is joined from the payload store; a revisit has none and refers to the response.
Reading rebuilds every record, parses it, and verifies length and digest of its body against
its header; a revisit takes its payload's length from a response that was read.

Defined cases: null payloads are empty and null URLs are written as empty. Payloads under
``min_revisit`` bytes are always responses. Rows that repeat the smallest page_id of a
payload are all responses; rows without a page_id come last, and are responses only if the
payload has no other row. Line ends in a URL are percent-encoded in its header. Rows that repeat
a page_id have records that repeat its id.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import attach, saved
from tagweave.operators.sizing import lookup_join
from tagweave.session import scratch_path

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def header(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write a WARC record for every row of pages (page_id, url, html) below ``folder``."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                         F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    hashed = plain.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = saved(hashed.select("page_id", "url", "digest", "bytes"), "records")
    owners = saved(rows.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")), "owners")
    total = owners.agg(F.sum("copies")).first()[0] or 0

    named = attach(rows, owners, "digest", "copies", total)
    revisit = (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(
        F.lit("WARC/1.1" + END), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id(F.col("page_id"))), header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(header("WARC-Refers-To", record_id(F.col("owner"))),
                                 header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))))
    named.select(F.encode(block, "UTF-8").alias("header"), "digest").write.parquet(f"{folder}/records")

    # The row that owns a payload stores it. Keyed by digest and page no key is hot, and rows
    # that repeat the owner meet where they already are.
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("page")
    owner = owners.select("digest", F.coalesce(F.col("owner").cast("string"), F.lit("none")).alias("page"))
    store = hashed.select("digest", page, "payload").join(owner, ["digest", "page"], "left_semi")
    store.dropDuplicates(["digest", "page"]).select("digest", "payload").write.parquet(f"{folder}/payloads")


def field(name: str) -> F.Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def page_of(value) -> F.Column:
    return F.regexp_extract(value, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(record): the exact bytes of every record.

    Only responses are joined to the payload store; a payload with many of them (a short one,
    or rows that repeat a page) is spread over tasks.
    """
    records = spark.read.parquet(f"{folder}/records")
    revisit = F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}")
    stored = spark.read.parquet(f"{folder}/payloads")
    responses = lookup_join(records.filter(~revisit), stored, "digest", small=False)
    blank, end = F.lit(END.encode()), F.lit(END.encode() * 2)
    missing = F.raise_error(F.concat(F.lit("no payload of digest "), "digest")).cast("binary")
    return responses.select(F.concat("header", blank, F.coalesce("payload", missing), end).alias("record")).unionByName(
        records.filter(revisit).select(F.concat("header", blank, end).alias("record")))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Page, URL, type, reference and payload of every record, read from its rebuilt bytes."""
    whole = F.decode("record", "UTF-8")
    cut = F.instr("whole", END * 2)
    parts = reconstruct(spark, folder).select(whole.alias("whole")).select(
        F.substring("whole", F.lit(1), cut + 1).alias("head"),
        F.encode(F.substring("whole", cut + 4, F.length("whole") - cut - 7), "UTF-8").alias("body"))
    parts = parts.select(
        page_of(field("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"), page_of(field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract("head", "\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("length"), F.octet_length("body").cast("long").alias("bytes"),
        F.sha2("body", 256).alias("found"))
    fine = (F.col("length") == F.col("bytes")) & ((F.col("record_type") == "revisit") | (F.col("found") == F.col("payload_digest")))
    wrong = F.raise_error(F.concat(F.lit("payload is not that of digest "), "payload_digest")).cast("string")
    parsed = parts.select("page_id", "url", F.when(fine, F.col("record_type")).otherwise(wrong).alias("record_type"), "refers_to",
                          "payload_digest", "bytes")
    parsed = saved(parsed, "parsed")
    own = F.col("record_type") == "response"
    uses = parsed.groupBy("payload_digest").agg(F.count("*").alias("uses"), F.max(F.when(own, F.col("bytes"))).alias("payload_bytes"))
    return attach(parsed.drop("bytes"), saved(uses, "payload-sizes"), "payload_digest", "uses", parsed.count())


def archived(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the archive of pages and read it back: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to of every record."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, folder, min_revisit)
    return read_records(pages.sparkSession, folder)
