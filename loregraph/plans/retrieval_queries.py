"""Queries on postings, ranked channels, fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions import text as X
from loregraph.operators import chunking as CH
from loregraph.operators import retrieval as R
from loregraph.plans import views as V
from loregraph.plans.views import TOKENS_SQL, n_rows, sql
from loregraph.store import stored

QUERIES, SQL = {}, {}
K = 60


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def chunks(spark, d):
    return V.paragraphs(spark, d)


@query("a5_document_frequency", sql("dfreq", "SELECT term, df FROM dfreq"))
def a5(spark, d):
    return R.document_frequencies(R.term_frequencies(chunks(spark, d)))


@query("a6_term_frequency", sql("tf", "SELECT chunk_id, term, tf FROM tf"))
def a6(spark, d):
    return R.term_frequencies(chunks(spark, d))


TERMS = "SELECT term, df, CASE WHEN raw<0 THEN 0.25*avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, df, ln((n-df+0.5)/(df+0.5)) AS raw FROM dfreq, stats)"
BM = """SELECT query_id, chunk_id, round(sum(qtf*idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl))),6) AS score FROM (SELECT query_id, term, count(*) AS qtf FROM query_tokens GROUP BY 1,2)
 JOIN terms USING (term) JOIN tf USING (term) JOIN chunk_len USING (chunk_id), stats GROUP BY 1,2"""
TOP = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {0} WHERE score>0) WHERE rank<={1}"
BM_PARTS = dict(terms=TERMS, bm=BM, bm_top=TOP.format("bm", K))
VOC = "SELECT term, ln((1+n)/(1+df))+1 AS idf FROM (SELECT * FROM dfreq ORDER BY df DESC, term LIMIT 512), stats"
NORM = "SELECT {0}, term, w/sqrt(sum(w*w) OVER (PARTITION BY {0})) AS w FROM ({1})"
QTF = "SELECT query_id, term, count(*) AS tf FROM query_tokens GROUP BY 1,2"
TI_PARTS = dict(voc=VOC, cv=NORM.format("chunk_id", "SELECT chunk_id, term, tf*idf AS w FROM tf JOIN voc USING (term)"), qv=NORM.format("query_id", f"SELECT query_id, term, tf*idf AS w FROM ({QTF}) JOIN voc USING (term)"), ti="SELECT query_id, chunk_id, round(sum(qv.w*cv.w),6) AS score FROM qv JOIN cv USING (term) GROUP BY 1,2", ti_top=TOP.format("ti", K))


def bm25(spark, d, k=K):
    return R.bm25_topk(V.eval_queries(spark, d), chunks(spark, d), k)


def tfidf(spark, d, k=K, post=None):
    return R.tfidf_topk(V.eval_queries(spark, d), chunks(spark, d), k, post)


OUT = ("query_id", "chunk_id", "rank")


@query("rt4_bm25", sql("query_tokens dfreq tf chunk_len stats", "SELECT query_id, chunk_id, rank, score FROM bm_top", **BM_PARTS))
def rt4(spark, d):
    return bm25(spark, d).select(*OUT, "score")


@query("w5_channel_ranks", sql("query_tokens dfreq tf chunk_len stats", "SELECT query_id, max(rank) AS ranks, count(*) AS n FROM bm_top GROUP BY 1", **BM_PARTS))
def w5(spark, d):
    return bm25(spark, d).groupBy("query_id").agg(F.max("rank").alias("ranks"), n_rows())


@query("rt1_tfidf", sql("query_tokens dfreq tf stats", "SELECT chunk_id, count(*) AS n, round(sum(w),4) AS total, round(max(w),4) AS most FROM cv GROUP BY 1", **TI_PARTS))
def rt1(spark, d):
    c = chunks(spark, d)
    voc = R.tfidf_vocabulary(R.term_frequencies(c), R.corpus_stats(c))
    v = R.tfidf_vectors(c, voc, "chunk_id")
    return v.groupBy("chunk_id").agg(n_rows(), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("most"))


@query("rt2_hash_vectors", sql("chunk_tokens", "SELECT chunk_id, bucket, round(c/sqrt(sum(c*c) OVER (PARTITION BY chunk_id)),4) AS weight FROM (SELECT chunk_id, ('0x'||right(md5(term),2))::INT AS bucket, count(*)::DOUBLE AS c FROM chunk_tokens GROUP BY 1,2)"))
def rt2(spark, d):
    return R.hash_vectors(chunks(spark, d), "chunk_id").select("chunk_id", F.col("term").alias("bucket"), F.round("weight", 4).alias("weight"))


@query("rt3_dense_tfidf", sql("query_tokens dfreq tf stats", "SELECT query_id, chunk_id, rank FROM ti_top", **TI_PARTS))
def rt3(spark, d):
    return tfidf(spark, d).select(*OUT)


VEC = "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]),6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id%50=0 AND q.vec_id<>v.vec_id"


@query("rt3_stored_vectors", sql("", "SELECT query_id, chunk_id, rank, score FROM vtop", vec=VEC, vtop=TOP.format("vec", 20)))
def rt3b(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return R.vector_topk(q, e, 20).select(*OUT, "score")


BOTH = "SELECT *, 'bm25' AS channel, 1.0 AS weight FROM bm_top UNION ALL SELECT *, 'dense', 1.0 FROM ti_top"
RRF = "SELECT query_id, chunk_id, sum(weight/(60+rank)) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels FROM both_ GROUP BY 1,2"
HY = BM_PARTS | TI_PARTS | dict(both_=BOTH, rrf=RRF.replace("sum(weight/(60+rank))", "round(sum(weight/(60+rank)),6)"), hy=TOP.format("rrf", K).replace("SELECT query_id, chunk_id, score, rank", "SELECT query_id, chunk_id, score, rank, channels"))
HY_NEEDS = "query_tokens dfreq tf chunk_len stats"


def rankings(spark, d, bm_weight=1.0, dense_weight=1.0, post=None):
    both = R.channels_topk(V.eval_queries(spark, d), chunks(spark, d), K, post)
    return both.withColumn("weight", F.when(F.col("channel") == "bm25", bm_weight).otherwise(dense_weight))


def hybrid(spark, d, k=K, post=None):
    return R.top_k(R.weighted_rrf(rankings(spark, d, post=post)), k)


@query("rt5_hybrid", sql(HY_NEEDS, "SELECT query_id, chunk_id, rank, channels FROM hy", **HY))
def rt5(spark, d):
    return hybrid(spark, d).select(*OUT, "channels")


@query("rt6_weighted_rrf", sql(HY_NEEDS, "SELECT query_id, chunk_id, round(sum(CASE channel WHEN 'bm25' THEN 1.3 ELSE 1.0 END/(60+rank)),5) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels FROM both_ GROUP BY 1,2", **HY))
def rt6(spark, d):
    return R.weighted_rrf(rankings(spark, d, 1.3, 1.0)).withColumn("score", F.round("score", 5))


@query("a9_channel_hits", sql(HY_NEEDS, "SELECT query_id, count(*) FILTER (channel='bm25') AS bm25, count(*) FILTER (channel='dense') AS dense, 0 AS graph FROM both_ GROUP BY 1", **HY))
def a9(spark, d):
    return R.channel_hits(rankings(spark, d), ["bm25", "dense", "graph"])


@query("a10_channel_label", sql(HY_NEEDS, "SELECT channels, count(*) AS n FROM rrf GROUP BY 1", **HY))
def a10(spark, d):
    return R.weighted_rrf(rankings(spark, d)).groupBy("channels").agg(n_rows())


def candidates(spark, d, k=32):
    h = hybrid(spark, d, k)
    c = chunks(spark, d).select("chunk_id", "text")
    return h.join(c, "chunk_id").join(V.eval_queries(spark, d).withColumnRenamed("text", "query_text"), "query_id")


OVER = f"""SELECT query_id, chunk_id, rank, score + 0.2*len(list_intersect(q,t))/greatest(len(q),1) AS score FROM (SELECT hy.*, list_distinct({TOKENS_SQL.format('p.text')}) AS t, list_distinct({TOKENS_SQL.format('eq.text')}) AS q
 FROM hy JOIN paragraphs p USING (chunk_id) JOIN eq USING (query_id) WHERE rank<=32)"""


@query("rt7_overlap_rerank", sql(HY_NEEDS + " paragraphs", "SELECT query_id, chunk_id, round(score,8) AS score FROM over_", **HY, over_=OVER))
def rt7(spark, d):
    return R.rerank_overlap(candidates(spark, d)).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


def query_nodes(spark, d):
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    return CH.tag_entities(q, V.lexicon(spark)).withColumnRenamed("chunk_id", "query_id")


QN = "SELECT DISTINCT item_id AS query_id, node_id FROM benchmark JOIN lexicon ON contains(lower(text), keyword)"


@query("rt8_graph_rerank", sql(HY_NEEDS + " tags", "SELECT query_id, chunk_id, round(score + 0.25*coalesce(both_n,0)/greatest(coalesce(qn_n,0),1),8) AS score FROM (SELECT * FROM hy WHERE rank<=32) LEFT JOIN (SELECT query_id, chunk_id, count(*) AS both_n FROM qn JOIN tags USING (node_id) GROUP BY 1,2) USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, count(*) AS qn_n FROM qn GROUP BY 1) USING (query_id)", **HY, qn=QN))
def rt8(spark, d):
    nodes = query_nodes(spark, d).groupBy("query_id").agg(F.collect_set("node_id").alias("nodes"))
    tagged = V.tags(spark, d).groupBy("chunk_id").agg(F.collect_set("node_id").alias("graph_node_ids"))
    empty = F.array().cast("array<string>")
    c = hybrid(spark, d, 32).join(nodes, "query_id", "left").join(tagged, "chunk_id", "left")
    c = c.withColumns({"nodes": F.coalesce("nodes", empty), "graph_node_ids": F.coalesce("graph_node_ids", empty)})
    return R.rerank_graph_overlap(c).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("rt9_mmr")
def rt9(spark, d):
    return R.mmr(R.rerank_overlap(candidates(spark, d)), 8)


@query("j2_node_overlap", sql("tags", "SELECT query_id, chunk_id, count(DISTINCT node_id) AS shared FROM qn JOIN tags USING (node_id) GROUP BY 1,2", qn=QN))
def j2(spark, d):
    return R.graph_overlap(query_nodes(spark, d), V.tags(spark, d)).select("query_id", "chunk_id", F.col("score").cast("long").alias("shared"))


@query("rt10_graph_channel", sql("tags", "SELECT query_id, chunk_id, rank FROM gtop", qn=QN, g="SELECT query_id, chunk_id, count(DISTINCT node_id) AS score FROM qn JOIN tags USING (node_id) GROUP BY 1,2", gtop=TOP.format("g", 30)))
def rt10(spark, d):
    return R.graph_topk(query_nodes(spark, d), V.tags(spark, d), 30).select(*OUT)


@query("j1_chunk_lookup", sql("query_tokens dfreq tf chunk_len stats paragraphs", "SELECT query_id, chunk_id, length(text) AS chars FROM bm_top JOIN paragraphs USING (chunk_id)", **BM_PARTS))
def j1(spark, d):
    return bm25(spark, d).join(chunks(spark, d), "chunk_id").select("query_id", "chunk_id", F.length("text").alias("chars"))


@query("rt17_fetch_chunk", sql("paragraphs", "SELECT item_id, chunk_id, source, left(p.text,250) AS preview FROM benchmark JOIN paragraphs p ON chunk_id='book_'||item_id||'_paragraph_i0'"))
def rt17(spark, d):
    ids = V.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("book_"), "item_id", F.lit("_paragraph_i0")).alias("chunk_id"))
    return ids.join(chunks(spark, d), "chunk_id").select("item_id", "chunk_id", "source", F.left("text", F.lit(250)).alias("preview"))


@query("rt18_chunk_listing", sql("tags paragraphs", "SELECT node_id, chunk_id, left(text,250) AS preview FROM tags JOIN paragraphs USING (chunk_id)"))
def rt18(spark, d):
    return V.tags(spark, d).join(chunks(spark, d), "chunk_id").select("node_id", "chunk_id", F.left("text", F.lit(250)).alias("preview"))


@query("rt15_hypothesis_support", sql(HY_NEEDS + " paragraphs", "SELECT query_id, chunk_id, shared, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, score DESC, chunk_id) AS k FROM (SELECT hy.query_id, hy.chunk_id, hy.score, len(list_intersect(list_distinct(" + TOKENS_SQL.format("p.text") + "), list_distinct(" + TOKENS_SQL.format("eq.text") + "))) AS shared FROM hy JOIN paragraphs p USING (chunk_id) JOIN eq USING (query_id) WHERE rank<=32) WHERE shared>0) WHERE k<=5", **HY))
def rt15(spark, d):
    c = candidates(spark, d)
    c = c.withColumn("shared", F.size(F.array_intersect(F.array_distinct(X.tokenize(F.col("text"))), F.array_distinct(X.tokenize(F.col("query_text"))))).cast("long")).where("shared > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("score"), "chunk_id")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 5").select("query_id", "chunk_id", "shared", F.col("k").alias("rank"))


REL = "SELECT item_id AS query_id, chunk_id FROM paragraphs p JOIN benchmark b ON contains(p.text, string_split(b.text,chr(10))[1])"


def relevant(spark, d):
    """(query_id, chunk_id) of paragraphs that hold the first line of an item."""
    head = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", "\n")[0].alias("head"))
    found = CH.tag_entities(chunks(spark, d), head.select(F.col("query_id").cast("string").alias("node_id"), F.col("head").alias("keyword")))
    found = found.select("chunk_id", F.col("node_id").cast("long").alias("query_id")).join(head, "query_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return found.where(F.contains("text", "head")).select("query_id", "chunk_id")


@query("ev1_relevance", sql("paragraphs", REL))
def ev1(spark, d):
    return relevant(spark, d)


EVAL = """SELECT query_id, max(rel) AS hit_at_k, round(avg(rel),3) AS precision, round(coalesce(1/min(rank) FILTER (rel=1),0),3) AS mrr, round(coalesce(sum(rel/log2(rank+1))/nullif(sum(rel/log2(ideal+1)),0),0),3) AS ndcg, min(rank) FILTER (rel=1) AS first_rank
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM (SELECT hy.query_id, hy.rank, CASE WHEN r.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM hy LEFT JOIN rels r ON r.query_id=hy.query_id AND r.chunk_id=hy.chunk_id WHERE rank<=12)) GROUP BY 1"""


def judged(spark, d):
    r = relevant(spark, d).withColumn("_rel", F.lit(1))
    return hybrid(spark, d).join(r, ["query_id", "chunk_id"], "left").select("query_id", "rank", F.coalesce("_rel", F.lit(0)).alias("relevant"))


@query("ev2_metrics", sql(HY_NEEDS + " paragraphs", EVAL, **HY, rels=REL))
def ev2(spark, d):
    return R.judged_metrics(judged(spark, d), 12)


@query("a18_mean_metrics", sql(HY_NEEDS + " paragraphs", f"SELECT count(*) AS queries, round(avg(hit_at_k),3) AS hit_at_k, round(avg(mrr),3) AS mrr, round(avg(ndcg),3) AS ndcg FROM ({EVAL})", **HY, rels=REL))
def a18(spark, d):
    m = R.judged_metrics(judged(spark, d), 12)
    return m.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 3).alias(c) for c in ("hit_at_k", "mrr", "ndcg")))


@query("ev5_index_consistency", sql("paragraphs tf", "SELECT count(*) AS stored, count(t.chunk_id) AS indexed FROM paragraphs p LEFT JOIN (SELECT DISTINCT chunk_id FROM tf) t ON p.chunk_id=t.chunk_id"))
def ev5(spark, d):
    c = chunks(spark, d).select("chunk_id")
    i = R.term_frequencies(chunks(spark, d)).select("chunk_id").distinct().withColumn("_in", F.lit(1))
    return c.join(i, "chunk_id", "left").agg(F.count(F.lit(1)).alias("stored"), F.count("_in").alias("indexed"))


@query("d3_query_dedupe", sql("eq", "SELECT query_id, i-1 AS pos, q[i] AS text FROM (SELECT query_id, unnest(range(1,len(q)+1)) AS i, q FROM (SELECT query_id, CASE WHEN query_id%3=0 THEN [text, lower(text)] ELSE [text, lower(text), 'tail '||query_id] END AS q FROM eq WHERE text<>lower(text)))"))
def d3(spark, d):
    q = V.eval_queries(spark, d).where("text <> lower(text)")
    others = F.array("text", F.lit("  "), F.lower("text"), F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("tail "), "query_id")).otherwise(F.col("text")))
    return q.select("query_id", F.posexplode(F.array_distinct(F.filter(others, lambda x: F.trim(x) != ""))).alias("pos", "text"))
