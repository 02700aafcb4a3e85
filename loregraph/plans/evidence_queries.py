"""Queries on citations, evidence chains with their buckets, metrics over book hits, graph lift and constraints with regulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.operators import graph as G
from loregraph.operators import requests as Q
from loregraph.operators import retrieval as R
from loregraph.plans import graph_queries as GQ
from loregraph.plans import ingest_queries as N
from loregraph.plans import request_queries as PQ
from loregraph.plans import retrieval_queries as RQ
from loregraph.plans import source_queries as SQ
from loregraph.plans import views as V
from loregraph.plans.views import sql
from loregraph.store import stored

QUERIES, SQL = {}, {}
K = 12


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


@query("rt17_cited_chunks", sql("paragraphs", f"SELECT item_id, chunk_id, source_type, md5(excerpt) AS digest, {N.REF} AS display_ref FROM cited JOIN benchmark ON chunk_id IN ('book_'||item_id||'_paragraph_i0', 'pdf_'||item_id||'_p1_0')", cited=N.CITED))
def rt17(spark, d):
    """The first paragraph of the document of each item's number, by either of its ids, with its citation."""
    c = N.cited(spark, d).select("chunk_id", "source", "chunk_type", "text", F.col("meta").alias("metadata"), "source_url")
    i = V.table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.concat(F.lit("book_"), "item_id", F.lit("_paragraph_i0")), F.concat(F.lit("pdf_"), "item_id", F.lit("_p1_0")))).alias("chunk_id"))
    return Q.cited(i.join(c, "chunk_id")).select("item_id", "chunk_id", "source_type", F.md5("excerpt").alias("digest"), "display_ref")


@query("rt16_cited")
def rt16(spark, d):
    """The whole retrieval plan with each chunk's citation."""
    meta = F.create_map(F.lit("paragraph_index"), F.col("paragraph_index").cast("string"))
    c = V.paragraphs(spark, d).select("chunk_id", "text", "source", F.lit("book_text").alias("chunk_type"), F.lit(None).cast("string").alias("source_url"), meta.alias("metadata"))
    return Q.retrieve(PQ.candidates(spark, d)).join(Q.cited(c).select("chunk_id", "source_type", "excerpt", "display_ref"), "chunk_id", "left")


CHAIN = dict(
    hops_=GQ.EVIDENCE,
    chain="""SELECT start_id, hop, from_id, relation, to_id, inferred, evidence AS source FROM hops_ UNION SELECT start_id, hop, from_id, relation, to_id, inferred, 'excel_'||start_id FROM hops_ WHERE from_id=start_id
 UNION SELECT node_id, 0, node_id, 'BUCKET', node_id, false, 'excel_'||node_id FROM loss WHERE node_id NOT IN (SELECT start_id FROM hops_)""",
)


@query("gr9_evidence_chain", sql("edges loss", "SELECT start_id, ['A','A→B','B→C','C→D','D→E'][hop+1] AS hop, from_id, relation, to_id, inferred, source FROM chain", **GQ.walk(3, GQ.INT), best=GQ.BEST, **CHAIN))
def gr9(spark, d):
    """All loss buckets: recoverable ones by their primary path, the others by themselves."""
    e, b = stored(V.edges(spark, d)), V.loss_forms(spark, d).select(F.col("node_id").alias("start_id"))
    paths = stored(G.primary_path(G.traverse(GQ.starts(spark, d), e)))
    return G.evidence_chain(b, paths, e, b.select("start_id", F.concat(F.lit("excel_"), "start_id").alias("citation")))


THREE = RQ.HY | dict(qn=RQ.QN, g="SELECT query_id, chunk_id, count(DISTINCT node_id) AS score FROM qn JOIN tags USING (node_id) GROUP BY 1,2", gtop=RQ.TOP.format("g", 30), typed=SQ.TYPED, rels=RQ.REL)
FUSED = "SELECT query_id, chunk_id, round(sum(weight/(60+rank)),6) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels FROM ({0}) GROUP BY 1,2"
BOTH = "SELECT query_id, chunk_id, rank, channel, weight FROM both_"
BOOK = """SELECT query_id, count(*) FILTER (is_book) AS book_hits, sum(rel)::BIGINT AS relevant_book_hits, count(*) FILTER (is_book AND contains(channels,'graph')) AS graph_book_hits, count(*) FILTER (is_book AND regexp_matches(channels,'hybrid|dense|bm25')) AS vector_book_hits,
 max(rel)::DOUBLE AS recall_at_k, round(coalesce(1/min(rank) FILTER (rel=1),0),3) AS mrr, round(coalesce(sum(rel/log2(rank+1))/nullif(sum(rel/log2(ideal+1)),0),0),3) AS ndcg, min(rank) FILTER (rel=1) AS first_rank, round(coalesce(sum(rel)/nullif(count(*) FILTER (is_book),0),0),3) AS precision_at_k
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM (SELECT t.query_id, t.rank, t.channels, c.chunk_type='book_text' AS is_book, CASE WHEN c.chunk_type='book_text' AND r.chunk_id IS NOT NULL THEN 1 ELSE 0 END AS rel FROM {0} t JOIN typed c USING (chunk_id) LEFT JOIN rels r ON r.query_id=t.query_id AND r.chunk_id=t.chunk_id WHERE rank<=12)) GROUP BY 1"""
EVAL = THREE | dict(
    f3=FUSED.format(BOTH + " UNION ALL SELECT query_id, chunk_id, rank, 'graph', 1.0 FROM gtop"), t3=RQ.TOP.format("f3", K).replace("SELECT query_id, chunk_id, score, rank", "SELECT query_id, chunk_id, score, rank, channels"),
    f2=FUSED.format(BOTH), t2=RQ.TOP.format("f2", K).replace("SELECT query_id, chunk_id, score, rank", "SELECT query_id, chunk_id, score, rank, channels"),
)
EVAL_NEEDS = RQ.HY_NEEDS + " paragraphs tags"


def judged(spark, d, graph):
    """The metrics over book hits of the text channels, and of these with the graph channel."""
    channels = stored(RQ.rankings(spark, d).select("query_id", "chunk_id", "rank", "channel", "weight"))
    relevant = stored(RQ.relevant(spark, d)).withColumn("_rel", F.lit(1))
    books = SQ.typed_chunks(spark, d).select("chunk_id", (F.col("chunk_type") == "book_text").alias("is_book"))
    out = []
    for own in graph:
        rows = channels
        if own:
            g = R.graph_topk(RQ.query_nodes(spark, d), V.tags(spark, d), 30)
            rows = rows.union(g.select("query_id", "chunk_id", "rank", F.lit("graph"), F.lit(1.0)))
        top = R.top_k(R.weighted_rrf(rows), K).join(books, "chunk_id").join(relevant, ["query_id", "chunk_id"], "left")
        out.append(R.book_metrics(top.withColumn("relevant", F.coalesce("_rel", F.lit(0))), K))
    return out


@query("ev2_book_metrics", sql(EVAL_NEEDS, BOOK.format("t3"), **EVAL))
def ev2(spark, d):
    return judged(spark, d, (True,))[0]


@query("ev4_graph_lift", sql(EVAL_NEEDS, f"SELECT rag_recall, graphrag_recall, round(graphrag_recall-rag_recall,3) AS graph_lift FROM (SELECT round(avg(recall_at_k),3) AS rag_recall FROM ({BOOK.format('t2')})), (SELECT round(avg(recall_at_k),3) AS graphrag_recall FROM ({BOOK.format('t3')}))", **EVAL))
def ev4(spark, d):
    return R.graph_lift(*judged(spark, d, (False, True)))


@query("la7_regulations", sql("equipment", """SELECT n_name AS factory, 'tier|Доступное оборудование: '||e||'|'||rules||'|own' AS items FROM nation JOIN (SELECT factory, string_agg(equipment, ', ' ORDER BY equipment) AS e FROM equipment GROUP BY 1) ON factory=n_name
 JOIN (SELECT n_name AS f, string_agg(t, '|' ORDER BY seq) AS rules FROM nation JOIN (SELECT r_regionkey AS seq, NULL::VARCHAR AS own, 'rule of '||r_name AS t FROM region UNION ALL SELECT 100+n_nationkey, n_name, 'rule in '||n_name FROM nation WHERE n_nationkey%2=1) ON own IS NULL OR own=n_name GROUP BY 1) ON f=n_name"""))
def la7(spark, d):
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    rules = r.select(F.col("r_regionkey").cast("long").alias("seq"), F.lit(None).cast("string").alias("factory"), F.concat(F.lit("rule of "), "r_name").alias("text"))
    rules = rules.union(n.where("n_nationkey % 2 = 1").select((F.col("n_nationkey") + 100).cast("long"), "n_name", F.concat(F.lit("rule in "), "n_name")))
    e = V.factory_equipment(spark, d).groupBy("factory").agg(F.collect_list("equipment").alias("e"))
    e = e.join(Q.factory_regulations(e, rules), "factory")
    items = Q.constraint_items(F.lit("tier"), F.col("e"), F.array(F.lit("own"), F.lit("  ")), F.col("regulations"))
    return e.select("factory", F.array_join(items, "|").alias("items"))
