import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

# nulls in every column, empty and blank texts, ties, wholly equal rows, one very long text
EDGE = [(1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (2, None, None, None, None),
        (3, "", "en", "s1", 0), (4, " \n\t\x0b\x0c\r ", "en", "s2", 7), (None, "null id words here", "en", "s2", 18),
        (None, None, None, None, None), (5, "x" * 300_000, "en", "s2", 300_000),
        (6, " ".join(f"w{i}" for i in range(40_000)), "en", "s1", None), (1, "another text with that id", "fr", None, 25),
        (8, "one<|endoftext|>two <|endoftext|>", "en", "s3", 33),
        (7, "Été \U0001d4b3 café\nline\nline\n\nline", "fr", "s3", 20)]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with every awkward value, and extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(EDGE, DOC_SCHEMA)
    extra = ("fp", "size", "row", "word", "n", "spans", "slot", "_id", "_row", "_hash", "label", "component_id", "piece", "start",
             "rank", "class", "bucket", "taken", "failure_bits", "row_hash", "text_hash", "digest", "path", "_words", "n_words")
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [r.asDict() for r in docs.collect()]
