import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents plus nulls, empties, ties and repeated rows, and a column with a clashing name."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    words = " ".join(f"w{i}" for i in range(80))
    more = [(9001, None, None), (9002, "", "src1"), (9003, " \t\n", "src1"), (9004, "one", None), (9005, "a b", "src2"), (9006, words, "src2"), (9007, "x " + words + " y", "src2"), (9006, words, "src2"), (9008, "la la " * 60, "src3"), (9009, words.upper() + "\n" + words, "src3"), (9010, "w1 " * 20000, "src3")]
    extra = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in more], "doc_id long, text string, lang string, source string, n_chars long")
    return d.union(extra).withColumn("rank", F.lit("clash")).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
