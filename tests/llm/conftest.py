import pytest

from wattsift.llm.registry import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_001(spark):
    return table(spark, SF_DIR, "documents")


@pytest.fixture(scope="session")
def labels_001(spark):
    return table(spark, SF_DIR, "labels")


LONG = "many words in a very long text " * 3000
EDGE = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "src0", 9, "x"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "src0", 9, "x"),  # a repeated row
    (2, "ONE two three four five six seven eight nine ten eleven twelve", None, None, None, None),  # a copy but for case
    (3, None, "en", "src0", 0, "x"),
    (4, "", "de", "src1", 0, None),
    (5, " \n\t ", "de", "src1", 4, ""),
    (6, "two words", "fr", None, 9, "y"),
    (7, LONG, "en", "src0", len(LONG), "z"),
    (None, "a text without an id, mail me at a.b@c.org please", "en", "src2", 1, "w"),
    (None, None, None, None, None, None),
    (8, "x" * 40000, "en", "src0", 40000, "w"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty, long and repeated texts, and columns named like results."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, clash string"
    df = spark.createDataFrame(EDGE, names)
    for name in ("N_Words", "contaminated", "kept", "score", "pii", "secrets", "licenses", "copies", "shard", "slot", "quality", "items"):
        df = df.withColumn(name, df["clash"])
    return df


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
