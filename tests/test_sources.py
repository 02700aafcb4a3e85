"""Readers and writers on a temporary folder, and operators at sizes that the given tables don't reach."""

import tempfile
from pathlib import Path

import numpy as np
import pytest

from loregraph.functions import files as FI
from loregraph.operators import chunking as CH
from loregraph.operators import retrieval as R
from loregraph.operators import topk as K
from loregraph.sources import documents as S


@pytest.fixture
def root():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_markdown_tree(spark, root):
    (root / "a/b").mkdir(parents=True)
    (root / "a/one.md").write_text('---\ntitle: "T"\npage: 3\n---\nbody\nline')
    (root / "a/b/two.md").write_text("plain")
    (root / "a/_index.md").write_text("left out")
    (root / "a/three.txt").write_text("left out")
    got = {r["path"].rsplit("/", 1)[1]: (r["meta"], r["text"]) for r in S.read_markdown(spark, str(root / "a")).collect()}
    assert got == {"one.md": ({"title": "T", "page": "3"}, "body\nline"), "two.md": ({}, "plain")}


@pytest.mark.parametrize("sep", ["\t", ";", ","])
def test_delimited(spark, root, sep):
    (root / "t.csv").write_text("\n".join(sep.join(r) for r in (("a", "b", "c"), ("1", "x y", ""), ("2", "z", "w"), ("3", "bad", "row", "long"))))
    rows, found = S.read_delimited(spark, str(root / "t.csv"))
    assert found == sep and rows.columns == ["a", "b", "c"]
    assert [tuple(r) for r in rows.orderBy("a").collect()] == [("1", "x y", None), ("2", "z", "w")]


def test_snapshot_and_graph_round_trip(spark, root):
    nodes = spark.createDataFrame([("a", "Mechanism", "A"), ("b", "Process", None)], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("a", "r", "b")], "source string, relation string, target string")
    S.write_snapshot(nodes, edges, str(root / "json"))
    back = S.read_snapshot(spark, str(root / "json"), ("node_id string, node_type string, label string", "source string, relation string, target string"))
    assert sorted(map(tuple, back[0].collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str)
    assert sorted(map(tuple, back[1].collect())) == sorted(map(tuple, edges.collect()))
    S.write_graph(nodes, edges, str(root / "graph"))
    assert spark.read.parquet(str(root / "graph/nodes")).count() == 2
    assert sorted(r["relation"] for r in spark.read.parquet(str(root / "graph/edges")).collect()) == ["r", "s"]


def test_elements_with_kids(spark):
    raw = '[{"type": "heading", "content": "H", "page": 1}, {"type": "list", "page": 1, "kids": [{"type": "list item", "content": "k1", "page": 1}, {"type": "image", "content": "x", "page": 1}]}, {"type": "paragraph", "content": "p", "page": 2}]'
    got = [(r["page"], r["number"], r["type"], r["text"], r["section"]) for r in S.flatten_elements(spark.createDataFrame([(1, raw)], "doc_id long, json string")).orderBy("page", "number").collect()]
    assert got == [(1, 0, "heading", "H", "H"), (1, 1, "list item", "k1", "H"), (2, 0, "paragraph", "p", "H")]


def test_page_metadata(spark):
    html = '<html lang="en"><head><title> T  t </title><meta property="og:description" content="D"><link rel="canonical" href="https://x/y"></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b></p><script>var a = "</p>";</script></article></body></html>'
    r = S.extract_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["lang"], r[0]["description"], r[0]["canonical"]) == ("T t", "en", "D", "https://x/y")
    assert (r[0]["text"], r[0]["markdown"], list(r[0]["headings"])) == ("Head\nOne two", "# Head\nOne two", ["Head"])
    assert r[1]["text"] == ""


@pytest.mark.parametrize("block", [CH.LEXICON_BLOCK, 500])
def test_tags_with_many_keywords_of_any_length(spark, monkeypatch, block):
    monkeypatch.setattr(CH, "LEXICON_BLOCK", block)
    words = [(f"n{i}", f"keyword{i}x") for i in range(6000)] + [("ox", "ox"), ("one", "q"), ("empty", ""), ("upper", "ÄB"), ("ox2", "OX")]
    texts = [(1, "an OX and keyword17x"), (2, "äb keyword5999xq"), (3, None), (4, ""), (5, "nothing")]
    got = CH.tag_entities(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(words, "node_id string, keyword string"))
    assert sorted(map(tuple, got.collect())) == [(1, "n17"), (1, "ox"), (1, "ox2"), (2, "n5999"), (2, "one"), (2, "upper")]


def test_sparse_topk_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q, c = (rng.random((n, 30)) * (rng.random((n, 30)) < 0.3) for n in (40, 300))
    table = lambda m, key: spark.createDataFrame([(int(i), f"t{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], f"{key} long, term string, weight double")
    monkeypatch.setattr(K, "QUERY_TERMS", 100)
    monkeypatch.setattr(K, "SCORES", 500)
    monkeypatch.setattr(K, "BLOCK", 16)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in R.sparse_topk(table(q, "query_id"), table(c, "chunk_id"), 7).collect()}
    s = np.round(q @ c.T, 6)
    want = {(i, r + 1): j for i in range(40) for r, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:7].tolist()) if s[i, j] > 0}
    assert got == want


def test_files(spark):
    rows = [("a.PY", "x = 1"), ("b.json", '{"a": 1}'), ("c.zip", "x"), ("d", "plain text"), ("e", "\x00bin"), ("f.txt", None), ("g.unknown", ""), ("h.json", "{bad")]
    got = {r["name"]: r for r in FI.convert_files(spark.createDataFrame(rows, "name string, content string")).collect()}
    assert {n: (r["kind"], r["success"]) for n, r in got.items()} == {"a.PY": ("code", True), "b.json": ("code", True), "c.zip": ("binary", False), "d": ("text", True), "e": ("binary", False), "f.txt": ("text", False), "g.unknown": ("text", True), "h.json": ("code", True)}
    assert got["a.PY"]["markdown"] == "```python\nx = 1\n```\n" and got["h.json"]["markdown"] == "```json\n{bad\n```\n"
    assert got["c.zip"]["errors"] == ["No converter for file type: binary"]
    assert "\n" in got["b.json"]["markdown"].split("```")[1].strip("json\n")


def test_modes_of_the_chunker_function(spark):
    CH.register_chunker(spark)
    spark.createDataFrame([(1, "a\nb\n\nc"), (2, "x" * 1500)], "id int, t string").createOrReplaceTempView("texts_for_chunker")
    rows = lambda g: [(r["id"], r["piece"][:3]) for r in spark.sql(f"SELECT id, i, piece FROM texts_for_chunker, LATERAL rechunk_text(t, '{g}') ORDER BY id, i").collect()]
    assert rows("line") == [(1, "a"), (1, "b"), (1, "c"), (2, "xxx")]
    assert rows("block") == [(1, "a\nb"), (1, "c"), (2, "xxx")]
    assert rows("window") == [(1, "a\nb"), (2, "xxx"), (2, "xxx")]


def test_embedder_sees_whole_batches(spark):
    def embedder(texts):
        return np.column_stack([texts.str.len(), np.full(len(texts), len(texts) > 1)])

    got = R.embed(spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "chunk_id long, text string").coalesce(1), embedder).orderBy("chunk_id").collect()
    assert [tuple(r["vec"]) for r in got] == [(float(n), 1.0) for n in (0, 1, 2, 3, 4, 0)]
    assert got[0].asDict().keys() == {"chunk_id", "vec"}
