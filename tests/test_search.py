"""Running top-k with bounds and filters against brute force, diversity against plain Python, articles of malformed pages."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loregraph.functions import text as X
from loregraph.operators import chunk_table as CT
from loregraph.operators import chunking as CH
from loregraph.operators import graph as G
from loregraph.operators import requests as Q
from loregraph.operators import retrieval as R
from loregraph.operators import topk as K
from loregraph.operators.chunk_table import every_granularity, register_rechunker
from loregraph.plans import evidence_queries as EQ
from loregraph.plans import request_queries as PQ
from loregraph.plans import retrieval_queries as RQ
from loregraph.plans import views as V
from loregraph.sources.pages import extract_page
from loregraph.store import stored

DATA = "/root/testdata/sf0.001"


class Shared:
    def __init__(self, value):
        self.value = value


def sparse_case(rng, queries=30, chunks=4000, terms=40):
    """A matrix of queries and one of chunks, with ties, and what queries ask for and chunks have."""
    q = np.round(rng.random((queries, terms)) * (rng.random((queries, terms)) < 0.2), 1)
    c = np.round(rng.random((chunks, terms)) * (rng.random((chunks, terms)) < 0.2), 1)
    want = [("f1", "f2", None)[i % 3] for i in range(queries)], [(True, False, None)[i % 4 % 3] for i in range(queries)]
    have = [("f1", "f2", "f3", None)[i % 4] for i in range(chunks)], [i % 5 < 2 for i in range(chunks)]
    return q, c, want, have


def asked_table(q, want):
    i, t = np.nonzero(q)
    cols = {"query_id": pa.array(i), "term": pa.array([f"t{x}" for x in t]), "weight": pa.array(q[i, t])}
    return pa.table(cols | {"factory": pa.array([want[0][x] for x in i], pa.string()), "external": pa.array([want[1][x] for x in i], pa.bool_())})


def chunk_batches(c, have, order, size=700):
    rows = [(f"c{i:05}", [f"t{x}" for x in np.flatnonzero(c[i])], c[i][c[i] > 0].tolist(), have[0][i], have[1][i]) for i in order]
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.string(), pa.bool_()]
    names = ["chunk_id", "terms", "weights", "factory", "external"]
    return [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[a : a + size], strict=True), kinds, strict=True)], names) for a in range(0, len(rows), size)]


@pytest.mark.parametrize("k, cells", [(1, 4_000_000), (7, 900), (60, 50_000)])
def test_a_task_gives_out_its_k_best_once(monkeypatch, k, cells):
    monkeypatch.setattr(K, "SCORES", cells)
    monkeypatch.setattr(K, "BLOCK", 128)
    rng = np.random.default_rng(k)
    q, c, want, have = sparse_case(rng)
    out = list(K._sparse(Shared(asked_table(q, want)), k)(iter(chunk_batches(c, have, rng.permutation(len(c))))))
    assert len(out) == 1 and out[0].num_rows <= len(q) * k
    got = {}
    for i, x, s in zip(*(out[0][n].to_pylist() for n in ("query_id", "chunk_id", "score")), strict=True):
        got.setdefault(i, []).append((-s, x))
    scores = np.round(q @ c.T, 6)
    for i in range(len(q)):
        ok = [j for j in range(len(c)) if scores[i, j] > 0 and (want[0][i] is None or have[0][j] in (None, want[0][i])) and want[1][i] in (None, have[1][j])]
        plain = sorted((-scores[i, j], f"c{j:05}") for j in ok)[:k]
        assert [x for _, x in sorted(got.get(i, []))] == [x for _, x in plain]


def test_blocks_out_of_reach_are_passed_over(monkeypatch):
    """Chunks of large weights first: the blocks of small ones are never scored."""
    monkeypatch.setattr(K, "BLOCK", 100)
    rng = np.random.default_rng(1)
    q, c, want, have = sparse_case(rng)
    c *= np.linspace(1, 0.01, len(c))[:, None] ** 4
    seen, score = [], K._score
    monkeypatch.setattr(K, "_score", lambda best, rows, *a: (seen.append(rows.num_rows), score(best, rows, *a))[1])
    monkeypatch.setattr(K.Best, "add", lambda self, *a, f=K.Best.add: (f(self, *a), self.merge())[0])
    order = np.argsort(-c.max(axis=1), kind="stable")
    list(K._sparse(Shared(asked_table(q, want)), 5)(iter(chunk_batches(c, have, order))))
    assert sum(seen) < len(c) / 2


def test_filters_of_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vec array<double>")
    has = spark.createDataFrame([(i, f"t{i % 3}", i % 2 == 0) for i in range(300)], "chunk_id long, chunk_type string, external boolean")
    asks = spark.createDataFrame([(i, "t1" if i % 4 else None, True if i % 3 == 0 else None) for i in range(40)], "query_id long, chunk_type string, external boolean")
    q = rows.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in K.vector_topk(q, rows, 5, asks, has).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {}
    for i in range(40):
        ok = [j for j in range(300) if j != i and s[i, j] > 0 and (i % 4 == 0 or j % 3 == 1) and (i % 3 or j % 2 == 0)]
        want |= {(i, r + 1): j for r, j in enumerate(sorted(ok, key=lambda j: (-s[i, j], j))[:5])}
    assert got == want


def plain_mmr(rows, n, lam=R.MMR_LAMBDA):
    """rows: (score, chunk_id, tokens) of one query -> ids in the order picked."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    if len(rows) <= n:
        return [r[1] for r in rows]
    picked = [rows.pop(0)]
    while rows and len(picked) < n:
        near = lambda r: max(len(r[2] & p[2]) / (len(r[2] | p[2]) or 1) for p in picked)  # noqa: E731, B023
        best = max(range(len(rows)), key=lambda i: (lam * rows[i][0] - (1 - lam) * near(rows[i]), -i))  # noqa: B023
        picked.append(rows.pop(best))
    return [r[1] for r in picked]


def by_query(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(key(r))
    return out


@pytest.mark.parametrize("which", ["rt9", "rt16", "rt13"])
def test_diversity_equals_plain_python(spark, which):
    if which == "rt9":
        cands, got = R.rerank_overlap(RQ.candidates(spark, DATA)), RQ.rt9(spark, DATA)
    else:
        cands, got = PQ.candidates(spark, DATA), PQ.rt16(spark, DATA) if which == "rt16" else PQ.rt13(spark, DATA)
    rows = cands.select("query_id", "chunk_id", "score", F.array_distinct(X.tokenize(F.col("text"))).alias("t")).collect()
    want = {q: plain_mmr(own, 8) for q, own in by_query(rows, lambda r: (r["score"], r["chunk_id"], frozenset(r["t"]))).items()}
    if which == "rt13":
        there = {r["chunk_id"] for r in V.paragraphs(spark, DATA).select("chunk_id").collect()}
        for q in want:
            pin = f"book_{q}_paragraph_i0"
            if q % 2 == 0 and pin in there:
                want[q] = [pin, *(c for c in want[q] if c != pin)]
    found = {q: [c for _, c in sorted(own)] for q, own in by_query(got.collect(), lambda r: (r["position"], r["chunk_id"])).items()}
    assert found == want


def test_answers_are_cited(spark):
    p = {r["chunk_id"]: r for r in V.paragraphs(spark, DATA).collect()}
    rows = EQ.rt16(spark, DATA).collect()
    assert rows and all(r["display_ref"] == f"{p[r['chunk_id']]['source']}, §{p[r['chunk_id']]['paragraph_index'] + 1}" and r["source_type"] == "book" for r in rows)


def test_a_hub_is_met_once_for_each_set(spark):
    """A node on half of all keys: pairs of classes, not of keys, and the same counts."""
    left = spark.createDataFrame([(i, n) for i in range(400) for n in (["hub"] if i % 2 else []) + [f"n{i % 5}"]], "a long, node_id string")
    right = spark.createDataFrame([(i, n) for i in range(300) for n in ["hub", f"n{i % 3}"]], "b long, node_id string")
    x, y, pairs = G.shared_classes(left, right, "a", "b")
    assert x.count() == 400 and y.count() == 300 and pairs.count() <= 10 * 3
    want = left.join(right, "node_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    rows = lambda df: sorted(map(tuple, df.select("a", "b", "shared").collect()))
    assert rows(G.shared_nodes(left, right, "a", "b")) == rows(want)


@pytest.mark.parametrize("granularity", list(CH.GRANULARITIES))
def test_table_function_gives_the_granularities(spark, granularity):
    register_rechunker(spark)
    atoms = V.atoms(spark, DATA)
    got = spark.sql(f"SELECT * FROM rechunk_atoms(TABLE({{atoms}}), '{granularity}')", atoms=atoms)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "paragraph_index", "page", F.coalesce("section", F.lit("")), "text").collect()))
    assert rows(got) == rows(CH.rechunk(atoms, granularity))


LONG = "A sentence with, some, commas that makes a paragraph of an article. " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        ("<nav><ul><li>a<li>b</ul></nav><p>Main text</p>", "Main text"),
        ("<ul><li>one<li>two <b>bold<li>three</ul><p>after", "one\ntwo bold\nthree\nafter"),
        ("<p>one<p>two<div>three</p>four</div>five", "one\ntwo\nthreefour\nfive"),
        ("<table><tr><td>a<td>b<tr><td>c</table>tail", "a\nb\nc\ntail"),
        ("</div></p>stray ends</b> stay", "stray ends stay"),
        ("<nav>only a menu", "only a menu"),
        ("<aside><p>aside</aside></aside><p>body", "body"),
        ("<body><div><div class='x'><p>" + LONG + "<p>" + LONG + "</div><div><a href=1>m</a><a href=2>n</a><a href=3>o</a></div></div>", LONG.strip() + "\n" + LONG.strip()),
        ("<body><p>short<div><a href=1>menu one</a> <a href=2>menu two</a> <a href=3>menu three</a></div><p>" + LONG, "short\n" + LONG.strip()),
        ("<div>" * 5000 + "deep", "deep"),
        ("<b>" * 5000 + "</i>" * 5000 + "flat", "flat"),
        ("", ""),
        (None, ""),
    ],
)
def test_articles_of_malformed_pages(html, text):
    assert extract_page(html)["text"] == text


def test_postings_hold_one_chunk_at_a_time(spark, capsys):
    """Counted in each row: neither an aggregation nor a sort over a task's chunks, whose memory grows with the input."""
    texts = ["b a b", None, "", " .. ", "A a a", "z " * 3000 + "y"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    post = R.postings(chunks)
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["dl"]) for r in post.collect()}
    assert got == {(0, "a"): (1, 3), (0, "b"): (2, 3), (4, "a"): (3, 3), (5, "y"): (1, 3001), (5, "z"): (3000, 3001)}
    post.explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and "Aggregate" not in plan and "Sort " not in plan


def test_modes_share_postings(spark, monkeypatch):
    made = []
    monkeypatch.setattr(R, "packed_postings", lambda c, own=R.packed_postings: made.append(1) or own(c))
    assert PQ.QUERIES["ev3_modes"](spark, "/root/testdata/sf0.001").count() == 6
    assert len(made) == 1


def test_granular_chunks_are_written_once(spark, capsys):
    """Steps read a table and don't cut the documents again."""
    PQ.granular(spark, "/root/testdata/sf0.001", "page")[0].explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("pair", [0, 1e9])
def test_terms_of_many_queries_are_multiplied_as_matrices(monkeypatch, pair):
    """Neither all terms pair by pair nor all as matrices, nor terms that a row or a query holds twice, change the scores."""
    monkeypatch.setattr(K, "PAIR", pair)
    q, c, want, have = sparse_case(np.random.default_rng(5), 20, 500, 12)
    asked = pa.concat_tables([asked_table(q, want).select(["query_id", "term", "weight"])] * 2)
    rows = [(f"c{i:05}", [f"t{x}" for x in np.flatnonzero(r)] * 2, r[r > 0].tolist() * 2) for i, r in enumerate(c)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["chunk_id", "terms", "weights"])
    (out,) = K._sparse(Shared(asked), 6)(iter([batch]))
    scores = np.round(4 * (q @ c.T), 6)
    for i in range(len(q)):
        got = sorted((-s, x) for n, x, s in zip(*(out[n].to_pylist() for n in ("query_id", "chunk_id", "score")), strict=True) if n == i)
        plain = sorted((-scores[i, j], f"c{j:05}") for j in range(len(c)) if scores[i, j] > 0)[:6]
        assert [x for _, x in got] == [x for _, x in plain] and np.allclose([s for s, _ in got], [s for s, _ in plain])


def test_postings_are_those_of_the_tokens(spark, monkeypatch):
    """Counted in Arrow with the tokens of ``tokenize``, in slices of any size, and so are document frequencies."""
    texts = ["Это Ёлка, ёлка-ёлка! 12a", "\u0130stanbul \u212aelvin \u03a3\u03a3 na\u00efve", "a\u0000b\u0085c\u2028a a", " one", "two ", "x" * 90, "\U0001f600a\U0001f600", None, "...", "", "İ" * 9]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts * 3)], "chunk_id string, text string").coalesce(2)
    want = R.term_frequencies(chunks)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for spread in (True, False):
        post = R.packed_postings(chunks, spread)
        assert rows(R.unpacked(post).select("chunk_id", "term", "tf")) == rows(want.select("chunk_id", "term", "tf"))
        assert rows(R.document_frequencies(post)) == rows(R.document_frequencies(want))
        assert rows(post.select("chunk_id", "dl")) == rows(want.groupBy("chunk_id").agg(F.sum("tf")))
    low = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunks.select("chunk_id", F.lower("text")).collect(), strict=True)], ["chunk_id", "_t"])
    whole = list(R._counted(iter([low])))
    monkeypatch.setattr(R, "PIECE", 40)
    cut = list(R._counted(iter([low])))
    own = lambda batches: pa.Table.from_batches(batches).select(["chunk_id", "dl", "terms", "tfs"]).to_pylist()
    assert len(whole) == 1 and len(cut) > 3 and own(cut) == own(whole)
    pieces = spark.createDataFrame(pa.Table.from_batches(cut).to_pylist(), post.schema)
    assert rows(R.document_frequencies(pieces)) == rows(R.document_frequencies(want))
    assert not re.search(X.TOKEN, "".join(map(chr, [*range(0x800, 0xD800), *range(0xE000, 0x110000)])))  # two bytes at most


def test_granularities_are_cut_in_one_pass(spark, monkeypatch, capsys):
    """One deal and one sort of the atoms give the chunks of ``rechunk`` at all granularities, in batches of any size."""
    atoms = V.atoms(spark, DATA)
    every = every_granularity(atoms)
    rows = lambda df: sorted(map(tuple, df.select("granularity", "chunk_id", "text").collect()))
    want = None
    for g in CH.GRANULARITIES:
        own = CH.rechunk(atoms, g).withColumn("granularity", F.lit(g)).select("granularity", "chunk_id", "text")
        want = own if want is None else want.union(own)
    assert rows(every) == rows(want)
    every.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
    names = ["doc_id", "page", "is_heading", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*atoms.orderBy("doc_id", "pos").select(names).collect(), strict=True)], names)
    whole = pa.Table.from_batches(CT._every(iter([batch]))).to_pylist()
    monkeypatch.setattr(CT, "PIECE", 5000)
    cut = list(CT._every(batch.slice(i, 7) for i in range(0, batch.num_rows, 7)))
    assert len(whole) == every.count() and len(cut) > 3 and pa.Table.from_batches(cut).to_pylist() == whole


def test_best_granularity_cuts_and_counts_once(spark, monkeypatch):
    """The documents are cut once for all granularities, and each granularity's terms are counted once."""
    cut, counted = [], []
    monkeypatch.setattr(CH, "rechunk", lambda *a, own=CH.rechunk: cut.append(1) or own(*a))
    monkeypatch.setattr(R, "document_frequencies", lambda p, own=R.document_frequencies: counted.append(1) or own(p))
    assert PQ.QUERIES["ev4_best_granularity"](spark, DATA).count() == 5
    assert not cut and len(counted) == 5


def test_relevance_is_looked_up_among_hits(spark, monkeypatch):
    """Only chunks that are hits are searched for an item's line, and the metrics are those of all chunks that hold it."""
    sizes = []
    monkeypatch.setattr(CH, "tag_entities", lambda c, *a, own=CH.tag_entities: sizes.append(c.count()) or own(c, *a))
    got = {r["granularity"]: r for r in PQ.QUERIES["ev4_best_granularity"](spark, DATA).drop("best").collect()}
    chunks, relevant = PQ.granular(spark, DATA, "sentence")
    want = PQ.means(PQ.judged(Q.hybrid_search(V.eval_queries(spark, DATA), chunks, PQ.K_EVAL), relevant), granularity="sentence").first()
    assert got["sentence"] == want and len(sizes) == 6 and sizes[1] < sizes[-1] == chunks.count()


def test_tables_between_steps(spark):
    """Compressed well, and a reader of one value of the column ``by`` reads that part only."""
    table = stored(spark.createDataFrame([(i, f"g{i % 3}", None if i % 2 else "t") for i in range(30)], "n long, g string, t string"), by="g")
    part = table.where("g = 'g1'")
    assert sorted(map(tuple, part.select("n", "g", "t").collect())) == [(i, "g1", None if i % 2 else "t") for i in range(1, 30, 3)]
    assert all("g=g1/" in f and f.endswith(".zstd.parquet") for f in {r[0] for r in part.select("_metadata.file_path").collect()})
