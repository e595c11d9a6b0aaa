import pytest

pytest.importorskip("cloakframe.llm")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; a table may hold them too.
CLASHING = ["key", "n", "digest", "keep_id", "_gone", "_dropped", "_bad", "_pred", "_text", "unit", "row_key", "at", "bag", "code", "label", "h", "place", "_c", "slot", "component_id", "ids"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and odd texts, ties and repeated rows, a very long text, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{k % 977} of{k % 31}." for k in range(40_000))
    para = "The first line of it is here\nand the second line follows it\nthen a third one ends\n"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "one two three four"), (7, para * 3 + "tail"), (8, para * 3 + "tail"), (8, para * 3 + "tail"),
        (9, para.upper()), (10, long), (11, long + " more"), (12, "%%% ### 123"), (13, "été où ça \U0001f600 日本"), (None, "a row without an id but with words in it"), (15, "x" * 700), (16, "ab" * 400), (17, None),
    ]
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", "s", None) for i, t in rows], DOCS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
