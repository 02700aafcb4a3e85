"""Queries on search with filters of factory, origin and chunk type, and on chunks with their citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.operators import requests as Q
from loregraph.operators import retrieval as R
from loregraph.operators.topk import vector_topk
from loregraph.plans import request_queries as PQ
from loregraph.plans import retrieval_queries as RQ
from loregraph.plans import source_queries as SQ
from loregraph.plans import views as V
from loregraph.plans.views import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def wanted(spark, d, key="item_id", table="benchmark"):
    """What each query asks for: two of three a factory, half an origin, one of seven a type of chunk."""
    i = F.col(key)
    return V.table(spark, d, table).select(i.alias("query_id"), F.when(i % 3 != 0, F.concat(F.lit("f"), i % 5)).alias("factory"), F.when(i % 2 == 0, i % 4 == 0).alias("external"), F.when(i % 7 == 0, F.lit("book_text")).alias("chunk_type"))


WANT = "SELECT item_id AS query_id, CASE WHEN item_id%3<>0 THEN 'f'||(item_id%5) END AS factory, CASE WHEN item_id%2=0 THEN item_id%4=0 END AS external, CASE WHEN item_id%7=0 THEN 'book_text' END AS chunk_type FROM benchmark"
PASS = "SELECT s.* FROM {0} s JOIN typed t USING (chunk_id) JOIN want w USING (query_id) WHERE (w.factory IS NULL OR t.factory IS NULL OR w.factory=t.factory) AND (w.external IS NULL OR w.external=t.external) AND (w.chunk_type IS NULL OR w.chunk_type=t.chunk_type)"
FILTERED = dict(typed=SQ.TYPED, want=WANT)
BM = FILTERED | dict(terms=RQ.TERMS, bm=RQ.BM, fbm=PASS.format("bm"), bm_top=RQ.TOP.format("fbm", RQ.K))
DENSE = FILTERED | {k: v for k, v in RQ.TI_PARTS.items() if k != "ti_top"} | dict(fti=PASS.format("ti"), ti_top=RQ.TOP.format("fti", RQ.K))


def filters(spark, d):
    return wanted(spark, d), SQ.typed_chunks(spark, d)


@query("rt4_bm25_filtered", sql("query_tokens dfreq tf chunk_len stats", "SELECT query_id, chunk_id, rank, score FROM bm_top", **BM))
def rt4(spark, d):
    return R.bm25_topk(V.eval_queries(spark, d), V.paragraphs(spark, d), RQ.K, None, *filters(spark, d)).select(*RQ.OUT, "score")


@query("rt3_dense_filtered", sql("query_tokens dfreq tf stats paragraphs", "SELECT query_id, chunk_id, rank FROM ti_top", **DENSE))
def rt3(spark, d):
    return R.tfidf_topk(V.eval_queries(spark, d), V.paragraphs(spark, d), RQ.K, None, *filters(spark, d)).select(*RQ.OUT)


@query("rt5_hybrid_filtered", sql(RQ.HY_NEEDS, "SELECT query_id, chunk_id, rank, score FROM hy", **BM, **{k: v for k, v in DENSE.items() if k not in FILTERED}, both_=RQ.BOTH, rrf="SELECT query_id, chunk_id, round(sum(weight/(60+rank)),6) AS score FROM both_ GROUP BY 1,2", hy=RQ.TOP.format("rrf", RQ.K)))
def rt5(spark, d):
    return Q.hybrid_search(V.eval_queries(spark, d), V.paragraphs(spark, d), RQ.K, *filters(spark, d)).select(*RQ.OUT, "score")


# The shared types of the graph channel that typed_chunks has.
GRAPH_PASS = "SELECT query_id, chunk_id, count(DISTINCT node_id) AS score FROM qn JOIN tags USING (node_id) JOIN typed t USING (chunk_id) JOIN want w USING (query_id) WHERE w.factory IS NULL OR w.factory=t.factory OR t.chunk_type IN ('book_text','constraint_regulation','constraint_example') GROUP BY 1,2"


@query("rt10_graph_filtered", sql("tags", "SELECT query_id, chunk_id, rank FROM gtop", qn=RQ.QN, **FILTERED, g=GRAPH_PASS, gtop=RQ.TOP.format("g", 30)))
def rt10(spark, d):
    return R.graph_topk(RQ.query_nodes(spark, d), V.tags(spark, d), 30, *filters(spark, d)).select(*RQ.OUT)


VECTORS = """SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]),6) AS score
 FROM embeddings q JOIN embeddings v ON q.vec_id%50=0 AND q.vec_id<>v.vec_id AND (q.vec_id%3=0 OR v.vec_id%3=0 OR q.vec_id%5=v.vec_id%5) AND (q.vec_id%2<>0 OR (q.vec_id%4=0)=(v.vec_id%2=0))"""


@query("rt3_vectors_filtered", sql("", "SELECT query_id, chunk_id, rank, score FROM vtop", vec=VECTORS, vtop=RQ.TOP.format("vec", 20)))
def rt3_vectors(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    i = F.col("chunk_id")
    has = e.select("chunk_id", F.when(i % 3 != 0, F.concat(F.lit("f"), i % 5)).alias("factory"), (i % 2 == 0).alias("external"))
    return vector_topk(q, e, 20, wanted(spark, d, "vec_id", "embeddings").drop("chunk_type"), has).select(*RQ.OUT, "score")


# The whole plan with filters: those of SUB and PLAN with the channels' candidates filtered before they are ranked.
_each = lambda name: PASS.format(name).replace("JOIN want w USING (query_id)", "JOIN want w ON w.query_id=CAST(split_part(s.query_id,'#',1) AS BIGINT)")
PLAN = {}
for _name, _text in PQ.PLAN.items():
    if _name == "sbm_top":
        PLAN |= FILTERED | dict(fsbm=_each("sbm"))
        _text = _text.replace("FROM sbm ", "FROM fsbm ")
    if _name == "sti_top":
        PLAN["fsti"] = _each("sti")
        _text = _text.replace("FROM sti ", "FROM fsti ")
    if _name == "gtop":
        PLAN["fshared"] = GRAPH_PASS.replace("FROM qn", "FROM inodes")
        _text = _text.replace("FROM shared ", "FROM fshared ")
    if _name not in FILTERED:
        PLAN[_name] = _text


@query("rt16_candidates_filtered", sql(PQ.SUB_NEEDS + " tags edges loss", PQ.CANDIDATES, **PLAN))
def rt16(spark, d):
    return PQ.candidates(spark, d, filters=filters(spark, d)).select("query_id", "chunk_id", "channels", F.round("score", 6).alias("score"))
