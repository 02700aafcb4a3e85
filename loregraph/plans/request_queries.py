"""Queries on requests: routing, expansion, context and the whole retrieval plan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.operators import chunking as CH
from loregraph.operators import graph as G
from loregraph.operators import losses as L
from loregraph.operators import requests as Q
from loregraph.operators import retrieval as R
from loregraph.operators.chunk_table import every_granularity
from loregraph.plans import graph_queries as GQ
from loregraph.plans import loss_queries as LQ
from loregraph.plans import retrieval_queries as RQ
from loregraph.plans import source_queries as SQ
from loregraph.plans import text_queries as TQ
from loregraph.plans import views as V
from loregraph.plans.views import TOKENS_SQL, n_rows, sql
from loregraph.store import stored

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


WORDS = {"count": ("comb",), "edge": ("arist",), "evidence": ("schk",), "neighbour": ("erbl",), "equipment": ("ation",), "process": ("eaux",), "intervention": ("mento",), "top": ("ción",), "recoverable": ("heit",), "by_factory": ("esth",), "find": ("thin",)}
ALIASES = (
    ("factory", 1, "eaux", "NATION_1"),
    ("factory", 2, "ation", "NATION_2"),
    ("metal", 1, "ción", "Ni"),
    ("metal", 2, "heit", "Cu"),
    ("mineral_form", 1, "esth", "millerite"),
    ("size_class", 1, "mento", "+71"),
    ("node_type", 1, "iez", "Reagent"),
    ("entity", 1, "iez", "reagent_a"),
    ("search", 1, "thin", "thin"),
    ("search", 2, "arist", "arist"),
)
_like = lambda name: f"contains(q,'{WORDS[name][0]}')"
_slot = lambda slot: "CASE " + " ".join(f"WHEN contains(q,'{n}') THEN '{v}'" for s, _, n, v in ALIASES if s == slot) + " END"
SLOTS = "SELECT *, " + ", ".join(f"{_slot(s)} AS s_{s}" for s in Q.SLOTS if s != "search") + f", coalesce({_slot('search')}, CASE WHEN length(trim(question))>3 THEN trim(question) END) AS s_search FROM (SELECT *, lower(question) AS q FROM req)"
INTENT_SQL = f"""CASE WHEN {_like('count')} AND {_like('edge')} THEN 'edge_stats' WHEN {_like('count')} THEN 'stats' WHEN {_like('evidence')} THEN 'literature_evidence' WHEN {_like('neighbour')} THEN 'neighbors'
 WHEN {_like('equipment')} AND {_like('process')} THEN 'process_equipment' WHEN {_like('intervention')} THEN 'intervention_path' WHEN {_like('top')} THEN 'top_losses' WHEN {_like('recoverable')} THEN 'recoverable_losses'
 WHEN {_like('by_factory')} THEN 'factory_breakdown' WHEN s_search IS NOT NULL AND {_like('find')} THEN 'search_nodes' WHEN s_entity IS NOT NULL AND {{factory}} IS NULL THEN 'neighbors' ELSE 'search_nodes' END"""


def slots(spark, d):
    aliases = spark.createDataFrame(list(ALIASES), "slot string, seq int, needle string, value string")
    return Q.question_slots(V.requests(spark, d).select("request_id", "question"), aliases)


@query("x20_question_intent", sql("req", f"SELECT request_id, s_factory AS factory, s_metal AS metal, s_mineral_form AS mineral_form, s_size_class AS size_class, s_node_type AS node_type, s_entity AS entity, md5(s_search) AS search, {INTENT_SQL.format(factory='s_factory')} AS intent FROM slots", slots=SLOTS))
def x20(spark, d):
    s = slots(spark, d)
    intent = Q.classify_intent(F.lower("question"), WORDS, F.col("entity"), F.col("factory"), F.col("search"))
    return s.select("request_id", "factory", "metal", "mineral_form", "size_class", "node_type", "entity", F.md5("search").alias("search"), intent.alias("intent"))


SYN = [("the", "article"), ("of", "genitive"), ("and", "conjunction"), ("la", "artículo"), ("die", "artikel"), ("de", "von"), ("le", "il")]
SYN_SQL = "SELECT * FROM (VALUES " + ",".join(f"('{a}','{b}')" for a, b in SYN) + ") t(token, synonym)"


@query("x18_expansion", sql("eq", f"""SELECT eq.query_id, CASE WHEN added IS NULL THEN text ELSE text||' '||added END AS text FROM eq LEFT JOIN (SELECT query_id, string_agg(synonym, ' ' ORDER BY pos, synonym) AS added FROM (
 SELECT query_id, synonym, min(list_position(toks, token)) AS pos FROM (SELECT query_id, text, list_distinct_order AS toks, unnest(list_distinct_order) AS token FROM (SELECT query_id, text, {TOKENS_SQL.format('text')} AS list_distinct_order FROM eq)) JOIN syn USING (token) WHERE NOT contains(lower(text), synonym) GROUP BY 1,2
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(list_position(toks, token)), synonym)<=12) GROUP BY 1) USING (query_id)""", syn=SYN_SQL))
def x18(spark, d):
    return Q.expand_queries(V.eval_queries(spark, d), spark.createDataFrame(SYN, "token string, synonym string"))


@query("x19_enriched_query", sql("req loss", f"SELECT request_id, md5(question||' '||res.factory||' '||coalesce(l.size_class||' '||l.mineral_form,'')) AS digest FROM (SELECT req.request_id, question, req.factory, bucket FROM req JOIN r USING (request_id)) res LEFT JOIN loss l ON l.node_id=bucket".replace("coalesce(l.size_class||' '||l.mineral_form,'')", "coalesce(l.size_class||' '||l.mineral_form, '-')"), r=LQ.RESOLVE))
def x19(spark, d):
    b = V.loss_forms(spark, d)
    r = V.requests(spark, d).select("request_id", "question", F.col("factory").alias("f"))
    r = r.join(L.resolve_buckets(V.requests(spark, d), b), "request_id").join(b.select("node_id", "size_class", "mineral_form"), F.col("bucket") == F.col("node_id"), "left")
    text = F.concat_ws(" ", "question", "f", F.coalesce(F.concat("size_class", F.lit(" "), "mineral_form"), F.lit("-")))
    return r.select("request_id", F.md5(text).alias("digest"))


@query("la7_constraints", sql("equipment", "SELECT n_name AS factory, 3 AS n, 'tier|Доступное оборудование: '||string_agg(equipment, ', ' ORDER BY equipment)||'|own' AS items FROM equipment JOIN nation ON n_name=factory GROUP BY 1"))
def la7(spark, d):
    e = V.factory_equipment(spark, d).groupBy("factory").agg(F.collect_list("equipment").alias("e"))
    items = Q.constraint_items(F.lit("tier"), F.col("e"), F.array(F.lit("own"), F.lit("  ")))
    return e.select("factory", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@query("t8_channel_topk", sql("tags", "SELECT node_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY chunk_id) AS rank FROM tags) WHERE rank<=60"))
def t8(spark, d):
    s = V.tags(spark, d).withColumn("score", F.lit(1.0))
    return R.top_k(s, 60, query="node_id").select("node_id", "chunk_id", "rank")


@query("w2_carried_heading", sql("atoms", "SELECT doc_id, pos, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM atoms"))
def w2(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return V.atoms(spark, d).select("doc_id", "pos", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w).alias("section"))


@query("w3_carry_with_reset", "SELECT user_id, event_id, CASE WHEN seg>0 AND count(*) FILTER (event_type='error') OVER (PARTITION BY user_id, seg ORDER BY event_id)=0 THEN first_value(event_id) OVER (PARTITION BY user_id, seg ORDER BY event_id) END AS current FROM (SELECT *, count(*) FILTER (event_type='signup') OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM events)")
def w3(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = Window.partitionBy("user_id", "seg").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = V.table(spark, d, "events").withColumn("seg", F.count_if(F.col("event_type") == "signup").over(w))
    open_ = (F.col("seg") > 0) & (F.count_if(F.col("event_type") == "error").over(s) == 0)
    return e.select("user_id", "event_id", F.when(open_, F.first("event_id").over(s)).alias("current"))


@query("a17_profile_shares", sql("loss", "SELECT factory, mineral_form, round(100*t/sum(t) OVER (PARTITION BY factory),4) AS share FROM (SELECT factory, mineral_form, sum(tonnes) AS t FROM loss GROUP BY 1,2)"))
def a17(spark, d):
    t = V.loss_forms(spark, d).groupBy("factory", "mineral_form").agg(F.sum("tonnes").alias("t"))
    return t.select("factory", "mineral_form", F.round(100 * F.col("t") / F.sum("t").over(Window.partitionBy("factory")), 4).alias("share"))


@query("ch8_evidence_links", sql("tags paragraphs", "SELECT node_id, source, arg_min(chunk_id, (doc_id, paragraph_index)) AS first_chunk FROM tags JOIN paragraphs USING (chunk_id) GROUP BY 1,2"))
def ch8(spark, d):
    p = V.paragraphs(spark, d).select("chunk_id", "source", "doc_id", "paragraph_index")
    return V.tags(spark, d).join(p, "chunk_id").groupBy("node_id", "source").agg(F.min_by("chunk_id", F.struct("doc_id", "paragraph_index")).alias("first_chunk"))


@query("x14_chunk_ids", sql("paragraphs", "SELECT chunk_id AS old_id, 'book_'||doc_id||CASE WHEN lang='en' THEN '' ELSE '_'||lang END||'_i'||paragraph_index AS new_id FROM paragraphs"))
def x14(spark, d):
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return V.paragraphs(spark, d).select(F.col("chunk_id").alias("old_id"), F.concat_ws("_", F.lit("book"), "doc_id", lang, F.concat(F.lit("i"), "paragraph_index")).alias("new_id"))


TIERS = {"low": "до 10 млн", "medium": "до 100 млн", "high": "от 100 млн"}


def full_requests(spark, d):
    """Requests with what their question names, every fourth with a budget tier of its own."""
    named = slots(spark, d).select("request_id", "entity", "search")
    tier = F.when(F.col("request_id") % 4 == 0, "high").when(F.col("request_id") % 4 == 1, "any")
    own = F.array(F.concat(F.lit("own "), F.col("request_id") % 3), F.lit("  "))
    return V.requests(spark, d).join(named, "request_id").withColumns({"budget_tier": tier, "user_constraints": own})


CONTEXT = f"""SELECT s.request_id, {INTENT_SQL.format(factory='s.factory')} AS intent, bucket, method, s.factory, CASE WHEN s.request_id%4=0 THEN 'high' ELSE {LQ.TIER} END AS budget_tier, l.mineral_form, l.size_class, s.metal
 FROM slots s JOIN r USING (request_id) JOIN loss l ON l.node_id=bucket JOIN final ON final.node_id=bucket"""
TOP5 = "SELECT factory, metal, string_agg(node_id, '|' ORDER BY k) AS top FROM (SELECT factory, metal, node_id, row_number() OVER (PARTITION BY factory, metal ORDER BY tonnes DESC, node_id) AS k FROM loss) WHERE k<=5 GROUP BY 1,2"


@query("la8_session_context", sql("req loss equipment", f"""SELECT request_id, intent, bucket, method, c.factory, budget_tier,
 CASE WHEN intent IN ('top_losses','recoverable_losses','factory_breakdown','stats') THEN 'LossAttribution' ELSE {LQ.ROLE_SQL} END AS role,
 CASE budget_tier WHEN 'low' THEN '{TIERS["low"]}' WHEN 'medium' THEN '{TIERS["medium"]}' ELSE '{TIERS["high"]}' END||'|Доступное оборудование: '||e.listed||'|own '||(request_id%3) AS constraints, t.top AS top_buckets
 FROM ctx c JOIN (SELECT factory, string_agg(equipment, ', ' ORDER BY equipment) AS listed FROM equipment GROUP BY 1) e ON e.factory=c.factory LEFT JOIN top5 t ON t.factory=c.factory AND t.metal=c.metal""", slots=SLOTS, r=LQ.RESOLVE, **LQ.BUDGET, ctx=CONTEXT, top5=TOP5))
def la8(spark, d):
    c = Q.session_context(full_requests(spark, d), V.loss_forms(spark, d), V.factory_equipment(spark, d), TIERS, WORDS)
    return c.join(V.loss_forms(spark, d).select(F.col("node_id").alias("bucket")), "bucket", "left_semi").withColumns({x: F.array_join(x, "|") for x in ("constraints", "top_buckets")})


@query("t4_bucket_lookup", sql("req loss", """SELECT request_id, 1 AS rank, node_id, tonnes FROM req JOIN loss ON node_id=bucket_id UNION ALL
 SELECT request_id, rank, node_id, tonnes FROM (SELECT request_id, l.node_id, l.tonnes, row_number() OVER (PARTITION BY request_id ORDER BY l.tonnes DESC, l.node_id) AS rank FROM (SELECT *, CASE WHEN request_id%5<>0 THEN factory END AS f FROM req WHERE bucket_id IS NULL) q JOIN loss l ON (f IS NULL OR l.factory=f) AND l.metal=q.metal AND (q.size_class IS NULL OR l.size_class=q.size_class) AND (q.mineral_form IS NULL OR l.mineral_form=q.mineral_form)) WHERE rank<=5"""))
def t4(spark, d):
    r = V.requests(spark, d).withColumn("factory", F.when(F.col("request_id") % 5 != 0, F.col("factory")))
    return Q.bucket_or_top(r, V.loss_forms(spark, d))


def rewrites(spark, d):
    """Each item as a request of two rewrites: the whole text, and its second half."""
    b = V.table(spark, d, "benchmark")
    words = F.split("text", r"\s+")
    half = F.floor(F.size(words) / 2).cast("int")
    return b.select(F.col("item_id").alias("query_id"), F.posexplode(F.array("text", F.array_join(F.slice(words, half + 1, F.size(words)), " "))).alias("q_idx", "text"))


SUBS = "SELECT item_id||'#0' AS query_id, text FROM benchmark UNION ALL SELECT item_id||'#1', array_to_string(w[len(w)//2+1:],' ') FROM (SELECT item_id, string_split_regex(text,'\\s+') AS w FROM benchmark)"
_sub = lambda text: text.replace("query_tokens", "sub_tokens").replace("bm_top", "sbm_top").replace("ti_top", "sti_top")
SUB = dict(
    subs=SUBS, sub_tokens=f"SELECT query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM subs", terms=RQ.TERMS,
    sbm=_sub(RQ.BM), sbm_top=RQ.TOP.format("sbm", RQ.K), voc=RQ.VOC, cv=RQ.TI_PARTS["cv"], sqv=_sub(RQ.TI_PARTS["qv"]),
    sti=RQ.TI_PARTS["ti"].replace("qv.", "sqv.").replace("FROM qv", "FROM sqv"), sti_top=RQ.TOP.format("sti", RQ.K),
    both_=_sub(RQ.BOTH), srrf="SELECT query_id, chunk_id, round(sum(weight/(60+rank)),6) AS score FROM both_ GROUP BY 1,2", shy=RQ.TOP.format("srrf", RQ.K),
    hits="SELECT CAST(split_part(query_id,'#',1) AS BIGINT) AS query_id, CAST(split_part(query_id,'#',2) AS INT) AS q_idx, chunk_id, rank FROM shy",
)
SUB_NEEDS = "dfreq tf chunk_len stats paragraphs"


@query("rt14_rewrite_hits", sql(SUB_NEEDS, "SELECT query_id, q_idx, chunk_id, rank FROM hits", **SUB))
def rt14(spark, d):
    return Q.rewrite_hits(rewrites(spark, d), V.paragraphs(spark, d)).select("query_id", "q_idx", "chunk_id", "rank")


@query("j11_hypothesis_probes", sql(SUB_NEEDS, "SELECT h.query_id, h.q_idx, h.text, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS probe_top_chunks FROM (SELECT CAST(split_part(query_id,'#',1) AS BIGINT) AS query_id, CAST(split_part(query_id,'#',2) AS INT) AS q_idx, text FROM subs UNION ALL SELECT item_id, 2, 'no rewrite' FROM benchmark) h LEFT JOIN hits ON hits.query_id=h.query_id AND hits.q_idx=h.q_idx AND rank<=5 GROUP BY 1,2,3", **SUB))
def j11(spark, d):
    r = rewrites(spark, d)
    probes = Q.probe_top(Q.rewrite_hits(r, V.paragraphs(spark, d)))
    h = r.union(V.table(spark, d, "benchmark").select("item_id", F.lit(2), F.lit("no rewrite")))
    return Q.with_probes(h, probes).withColumn("probe_top_chunks", F.array_join("probe_top_chunks", ","))


def item_nodes(spark, d):
    """Entities of the item's text, and for even items what is on the paths from the largest recoverable bucket of a factory."""
    tagged = RQ.query_nodes(spark, d)
    top = L.top_of_scope(V.loss_forms(spark, d).where("recoverable"), ["factory"]).select("factory", F.col("node_id").alias("start_id"))
    n = V.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("factory"))
    starts = top.join(n, "factory").select("n_nationkey", "start_id")
    paths = G.traverse(starts.select("start_id").distinct(), V.edges(spark, d), max_paths=None).select("start_id", F.explode("nodes").alias("node_id")).where(G.has_prefix(F.col("node_id"))).distinct()
    even = V.table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.pmod("item_id", F.lit(25)).alias("k"))
    on_path = even.join(starts, F.col("k") == F.col("n_nationkey")).join(paths, "start_id").select("query_id", "node_id")
    return tagged.select("query_id", "node_id").union(on_path).distinct()


def scopes(spark, d):
    i = F.col("item_id")
    tier = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (i % 3 + 1).cast("int"))
    return V.table(spark, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("f"), i % 5).alias("factory"), tier.alias("budget_tier"))


CONS = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pr DESC, chunk_id) AS rank FROM (SELECT item_id AS query_id, chunk_id, CASE WHEN chunk_type='constraint_regulation' THEN 2 ELSE 1 END AS pr FROM benchmark JOIN typed ON (chunk_type IN ('constraint_budget','constraint_example') AND budget_tier=['low','medium','high'][item_id%3+1]) OR (chunk_type='constraint_regulation' AND (factory IS NULL OR factory='f'||(item_id%5)))) QUALIFY rank<=20"


@query("rt11_constraint_rankings", sql("paragraphs", "SELECT query_id, chunk_id, rank FROM cons", typed=SQ.TYPED, cons=CONS))
def rt11(spark, d):
    return Q.constraint_rankings(scopes(spark, d), SQ.typed_chunks(spark, d)).select("query_id", "chunk_id", "rank")


def candidates(spark, d, k_out=Q.K_OUT, graph=True, chunks=None, filters=(None, None), hits=None):
    chunks = V.paragraphs(spark, d) if chunks is None else chunks
    nodes, tags = (stored(item_nodes(spark, d)), stored(V.tags(spark, d))) if graph else (None, None)
    cons = Q.constraint_rankings(scopes(spark, d), SQ.typed_chunks(spark, d))
    even = V.table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"))
    return Q.rank_candidates(rewrites(spark, d), chunks, nodes, tags, cons, even if graph else None, k_out, *filters, hits=hits)


ITEM_NODES = "SELECT query_id, node_id FROM qn UNION SELECT item_id, p.node_id FROM benchmark JOIN nation ON item_id%25=n_nationkey JOIN tops ON tops.factory=n_name JOIN on_path p ON p.start_id=tops.node_id WHERE item_id%2=0"
PLAN = SUB | dict(
    qn=RQ.QN, tops="SELECT factory, node_id FROM loss WHERE recoverable QUALIFY row_number() OVER (PARTITION BY factory ORDER BY tonnes DESC, node_id)=1",
    **{k: v for k, v in GQ.walk(3, GQ.INT).items()},
    on_path="SELECT DISTINCT start_id, node_id FROM (SELECT start_id, unnest(nodes) AS node_id FROM paths WHERE hops>0) WHERE regexp_matches(node_id,'^(lossform_|mech_|process_|equip_|mineral_|reagent_)')",
    inodes=ITEM_NODES, shared="SELECT query_id, chunk_id, count(DISTINCT node_id) AS score FROM inodes JOIN tags USING (node_id) GROUP BY 1,2", gtop=RQ.TOP.format("shared", 30), typed=SQ.TYPED, cons=CONS,
    named="SELECT query_id, chunk_id, rank, 'hybrid' AS channel, 1.6 AS weight FROM hits UNION ALL SELECT query_id, chunk_id, rank, 'constraint', 2.0 FROM cons UNION ALL SELECT query_id, chunk_id, rank, 'graph', 2.5 FROM gtop UNION ALL SELECT query_id, chunk_id, rank, 'graph', 1.5 FROM gtop WHERE query_id%2=0",
    nrrf="SELECT query_id, chunk_id, round(sum(weight/(60+rank)),6) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS channels FROM named GROUP BY 1,2",
    fused=RQ.TOP.format("nrrf", 32).replace("SELECT query_id, chunk_id, score, rank", "SELECT query_id, chunk_id, score, rank, channels"),
    asked=f"SELECT CAST(split_part(query_id,'#',1) AS BIGINT) AS query_id, list_distinct({TOKENS_SQL.format(chr(115) + 'tring_agg(text, chr(32) ORDER BY query_id)')}) AS q FROM subs GROUP BY 1",
)


CANDIDATES = f"""SELECT f.query_id, f.chunk_id, f.channels, round(f.score + 0.25*coalesce(s.score,0)/greatest(coalesce(n.n,0),1) + 0.2*len(list_intersect(q, list_distinct({TOKENS_SQL.format('p.text')})))/greatest(len(q),1), 6) AS score
 FROM fused f JOIN paragraphs p USING (chunk_id) JOIN asked USING (query_id) LEFT JOIN shared s ON s.query_id=f.query_id AND s.chunk_id=f.chunk_id LEFT JOIN (SELECT query_id, count(DISTINCT node_id) AS n FROM inodes GROUP BY 1) n ON n.query_id=f.query_id"""


@query("rt16_candidates", sql(SUB_NEEDS + " tags edges loss", CANDIDATES, **PLAN))
def rt16_candidates(spark, d):
    return candidates(spark, d).select("query_id", "chunk_id", "channels", F.round("score", 6).alias("score"))


@query("rt16_retrieve")
def rt16(spark, d):
    return Q.retrieve(candidates(spark, d))


@query("rt13_pinned")
def rt13(spark, d):
    pinned = V.table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.concat(F.lit("book_"), "item_id", F.lit("_paragraph_i0")).alias("chunk_id"))
    chunks = V.paragraphs(spark, d)
    return Q.retrieve(candidates(spark, d), pinned=pinned.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id"), chunks=chunks)


K_EVAL = 12


def judged(ranked, relevant):
    """(query_id, rank, relevant) of ranked chunks."""
    hit = ranked.join(relevant.withColumn("_rel", F.lit(1)), ["query_id", "chunk_id"], "left")
    return R.judged_metrics(hit.select("query_id", "rank", F.coalesce("_rel", F.lit(0)).alias("relevant")), K_EVAL)


def means(metrics, **names):
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 3).alias(c) for c in ("hit_at_k", "precision", "mrr", "ndcg"))).select(*(F.lit(v).alias(k) for k, v in names.items()), "*")


@query("ev3_modes")
def ev3(spark, d):
    """Literature only, the full plan without a graph, and with it; items that name a bucket apart from the others."""
    relevant, rows = stored(RQ.relevant(spark, d)), None
    chunks = V.paragraphs(spark, d)
    post = stored(R.packed_postings(chunks))  # all modes search the same chunks, two of them with the same rewrites
    found = stored(Q.rewrite_hits(rewrites(spark, d), chunks, post=post))
    place = F.col("position").alias("rank")
    ranked = {
        "rag": RQ.hybrid(spark, d, K_EVAL, post).select("query_id", "chunk_id", "rank"),
        "full_rag": Q.retrieve(candidates(spark, d, K_EVAL, graph=False, hits=found), K_EVAL).select("query_id", "chunk_id", place),
        "graphrag": Q.retrieve(candidates(spark, d, K_EVAL, hits=found), K_EVAL).select("query_id", "chunk_id", place),
    }
    for mode, hits in ranked.items():
        m = stored(judged(hits, relevant))  # read by both suites
        for suite, part in (("bucket", m.where("query_id % 2 = 0")), ("literature", m.where("query_id % 2 = 1"))):
            row = means(part, mode=mode, suite=suite)
            rows = row if rows is None else rows.union(row)
    return rows


def holding(spark, d, chunks):
    """(query_id, chunk_id) of the chunks that hold the first line of an item."""
    head = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", "\n")[0].alias("head"))
    found = CH.tag_entities(chunks, head.select(F.col("query_id").cast("string").alias("node_id"), F.col("head").alias("keyword")))
    return found.select(F.col("node_id").cast("long").alias("query_id"), "chunk_id")


def granular(spark, d, granularity):
    """(chunk_id, text) of one granularity, written as several steps read it, and the chunks that hold the first line of an item."""
    c = stored(CH.rechunk(V.atoms(spark, d), granularity).select("chunk_id", "text"))
    return c, holding(spark, d, c)


@query("ev4_best_granularity")
def ev4(spark, d):
    """Mean metrics of hybrid search for each granularity, and which is best by hits, then by nDCG.

    All chunks are searched; the metrics are those of hits, so what holds an item's line is looked up among the chunks that are one.
    """
    rows, chunks = None, stored(every_granularity(V.atoms(spark, d)), by="granularity")
    for granularity in CH.GRANULARITIES:
        c = chunks.where(F.col("granularity") == granularity).drop("granularity")
        hits = stored(Q.hybrid_search(V.eval_queries(spark, d), c, K_EVAL, post=stored(R.packed_postings(c, spread=False))))
        relevant = holding(spark, d, c.join(F.broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi"))  # at most queries x K_EVAL
        row = means(judged(hits, relevant), granularity=granularity)
        rows = row if rows is None else rows.union(row)
    best = F.max_by("granularity", F.struct("hit_at_k", "ndcg", "granularity")).over(Window.partitionBy())
    return rows.withColumn("best", F.col("granularity") == best)


@query("ev4_granular_relevance", sql("atoms", "SELECT granularity, query_id, count(*) AS n FROM (SELECT 'page' AS granularity, item_id AS query_id FROM pages_ p JOIN benchmark b ON contains(lower(p.text), lower(string_split(b.text,chr(10))[1])) UNION ALL SELECT 'paragraph', item_id FROM sec p JOIN benchmark b ON contains(lower(p.text), lower(string_split(b.text,chr(10))[1]))) GROUP BY 1,2", bodies=TQ.BODY, sec=TQ.SEC, pages_="SELECT doc_id, page, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS text FROM sec GROUP BY 1,2"))
def ev4_relevance(spark, d):
    row = lambda g: granular(spark, d, g)[1].groupBy("query_id").agg(n_rows()).select(F.lit(g).alias("granularity"), "query_id", "n")
    return row("page").union(row("paragraph"))
