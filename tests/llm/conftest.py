import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as extra columns of the input.
EXTRA = ["fp", "k", "matches", "drops", "task", "rank", "score", "lang_pred", "label", "batch", "_hot", "_salt", "holder",
         "n", "gram", "slot", "digest", "payload", "owner", "copies", "page", "turns", "prompt", "chosen", "host", "rule", "path"]

LONG = " ".join(f"word{i % 997} the{i % 31}" for i in range(30_000))

EDGES = [
    (1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "the", "en"), (5, "### 123 --", "de"),
    (6, "The quick brown fox jumps over the lazy dog again and again.\nThis line is shared by many documents.\n", "en"),
    (7, "The quick brown fox jumps over the lazy dog again and again.\nThis line is shared by many documents.\n", "en"),
    (8, "another text\n  THIS LINE IS SHARED BY MANY DOCUMENTS.  \nend", "en"),
    (9, "le chat est sur la table et le chien dort sous le lit\n\n\nThis line is shared by many documents.", "fr"),
    (10, LONG, "en"), (10, LONG, "en"), (11, "ßäöü " * 40 + "日本語 🙂", "de"), (None, "no id but a text of a few words", "en"),
    (None, None, None), (12, "x" * 5000, "es"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls, empty, blank and long texts, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in EDGES], DOCUMENTS)
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
