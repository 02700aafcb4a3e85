"""Hand-computed cases of text functions, fusion and selection."""

import time

import pytest
from pyspark.sql import functions as F

from loregraph.functions import files as FI
from loregraph.functions import text as X
from loregraph.operators import graph as G
from loregraph.operators import losses as L
from loregraph.operators import retrieval as R
from loregraph.plans import text_queries, views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("parts", "want"),
    [(("lossform", "КГМК", "+71", "open", "Ni"), "lossform_кгмк_+71_open_ni"), (("a  b", "c__d"), "a_b_c_d"), (("-71 + 45",), "71_+_45")],
)
def test_slug(spark, parts, want):
    assert one(spark, X.slug(*map(F.lit, parts))) == want


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1000, 1), (1001, 2), (1200, 2), (2001, 3)])
def test_windows(spark, n, want):
    assert len(one(spark, X.split_windows(F.lit("x" * n)))) == want


def test_sentences(spark):
    long = "This sentence is long enough to stand by itself here."
    assert one(spark, X.split_sentences(F.lit(f"Short. {long} Tiny one. {long}"))) == [f"Short. Short. {long} Tiny one.", long]
    assert one(spark, X.split_sentences(F.lit("No. Nor this."))) == ["No. Nor this."]
    assert one(spark, X.split_sentences(F.lit("  "))) == []


def test_paragraph_merge(spark):
    loose, closed = "loose line", "closed line."
    assert one(spark, X.split_paragraphs(F.lit(f"{'a' * 80}\n\n{loose}\n\n{closed}"))) == ["a" * 80 + "\n" + loose, closed]


def test_spaced_letters(spark):
    assert one(spark, X.join_spaced_letters(F.lit("ф л о т а ц и я"))) == "флотация"


def test_frontmatter(spark):
    raw = '---\na: "x"\nb: 2\na: y\n---\nbody'
    assert one(spark, X.frontmatter(F.lit(raw))) == {"a": "y", "b": "2"}
    assert one(spark, X.body(F.lit(raw))) == "body"


def test_highlight(spark):
    assert one(spark, X.highlight(F.lit("find needles"), F.lit("x" * 100 + " needles " + "y" * 200))).count("needles") == 1
    assert one(spark, X.highlight(F.lit("zzz"), F.lit("plain"))) == "plain"


def test_highlight_of_long_texts_by_themselves(spark):
    """60,000 different words: work by the square of their number takes minutes."""
    text = " ".join(f"word{i}" for i in range(60000))
    df = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    got = df.select(X.highlight(F.col("text"), F.col("text")).alias("x")).first()["x"]
    assert "word10000" in got and time.time() - began < 20
    df = spark.createDataFrame([("absent1 absent2 wordy words", "Wordy words"), (None, "x" * 130), ("word", None)], "q string, text string")
    assert [r["x"] for r in df.select(X.highlight(F.col("q"), F.col("text")).alias("x")).collect()] == ["Wordy words", "x" * 120 + "…", None]


def test_hash_bucket(spark):
    assert one(spark, R.hash_bucket(F.lit("test"))) == 246


def test_rrf_does_not_depend_on_order(spark):
    rows = [(1, "a", 1.0, 1, "x"), (1, "a", 1.0, 2, "y"), (1, "b", 2.0, 1, "y"), (1, "c", 0.0, 1, "z")]
    schema = "query_id int, channel string, weight double, rank int, chunk_id string"
    out = [sorted(map(tuple, R.weighted_rrf(spark.createDataFrame(r, schema)).collect())) for r in (rows, rows[::-1])]
    assert out[0] == out[1]
    assert [r[1] for r in out[0]] == ["x", "y"]


def test_mmr_prefers_different_texts(spark):
    rows = [(1, "a", 1.0, "red green"), (1, "b", 0.99, "red green"), (1, "c", 0.9, "blue")]
    out = R.mmr(spark.createDataFrame(rows, "query_id int, chunk_id string, score double, text string"), 2).orderBy("position").collect()
    assert [r["chunk_id"] for r in out] == ["a", "c"]


def test_cycle_of_two(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a")], "source string, relation string, target string")
    paths = G.traverse(spark.createDataFrame([("a",)], "start_id string"), edges, relations=None, max_hops=4)
    assert sorted(r["hops"] for r in paths.collect()) == [1, 2]


def test_two_relations_on_one_pair(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b")], "source string, relation string, target string")
    assert G.distinct_edges(edges).count() == 2


@pytest.mark.parametrize(("tonnes", "want"), [(79.0, 0.15), (80.0, 0.35), (300.0, 0.65), (800.0, 1.0)])
def test_ladder_without_peers(spark, tonnes, want):
    b = spark.createDataFrame([("n", "f", "+71", "open_pnt_cp", "Ni", tonnes, True)], "node_id string, factory string, size_class string, mineral_form string, metal string, tonnes double, recoverable boolean")
    assert L.value_percentile(b).first()["percentile"] == want


def test_spaced_letters_query_reads_whole_paragraphs(spark):
    letters = lambda r: "".join(r["text"].split())
    want = {r["chunk_id"]: letters(r) for r in views.paragraphs(spark, "/root/testdata/sf0.001").collect()}
    got = {r["chunk_id"]: letters(r) for r in text_queries.QUERIES["x10_spaced_letters"](spark, "/root/testdata/sf0.001").collect()}
    assert max(map(len, want.values())) > 40 and got == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"b":{"c":[1,2.50,"é"]},"a":null}', '{\n  "b": {\n    "c": [\n      1,\n      2.5,\n      "é"\n    ]\n  },\n  "a": null\n}'),
        ("[]", "[]"),
        ("7", "7"),
        ("{broken", "{broken"),
        ("", ""),
        (None, None),
        ('"\\ud800"', '"\\ud800"'),
        ("[" * 100000, "[" * 100000),
    ],
)
def test_pretty_json(spark, raw, want):
    assert one(spark, FI.pretty_json(F.lit(raw).cast("string"))) == want


def test_largest_bucket_of_a_scope(spark):
    rows = [("b", "f", 2.0), ("a", "f", 2.0), ("c", "f", None), ("d", None, None), ("e", "g", 1.0)]
    b = spark.createDataFrame(rows, "node_id string, factory string, tonnes double")
    top = lambda df, scope: {(r["factory"], r["node_id"]) for r in L.top_of_scope(df, scope).collect()}
    assert top(b, ["factory"]) == {("f", "a"), (None, "d"), ("g", "e")}
    assert top(b, []) == {("f", "a")} and L.top_of_scope(b, []).columns == b.columns
    assert top(b.limit(0), []) == top(b.limit(0), ["factory"]) == set()


def test_vector_topk_leaves_out_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [])]
    v = spark.createDataFrame(rows, "chunk_id int, vec array<float>")
    q = v.select(F.col("chunk_id").alias("query_id"), "vec")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in R.vector_topk(q, v, 5).collect()}
    assert got == {(1, 1): (8, 1.0), (1, 2): (2, 0.707107), (2, 1): (1, 0.707107), (2, 2): (8, 0.707107), (8, 1): (1, 1.0), (8, 2): (2, 0.707107)}
    assert R.vector_topk(q.limit(0), v, 5).count() == R.vector_topk(q, v.limit(0), 5).count() == 0


def test_graph_topk_is_the_top_of_the_join(spark):
    tags = spark.createDataFrame([(f"c{i:03}", f"n{j}") for i in range(200) for j in range(7) if i % (j + 1) == 0] + [("c001", None)], "chunk_id string, node_id string")
    asked = spark.createDataFrame([(q, f"n{(q + j) % 9}") for q in range(6) for j in range(3)] * 2 + [(7, None)], "query_id int, node_id string")
    rows = lambda df: {tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect()}
    want = rows(R.top_k(R.graph_overlap(asked, tags), 30))
    assert want and rows(R.graph_topk(asked, tags, 30)) == want
