"""Queries on sources, sinks, predicates and message tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.operators import graph as G
from loregraph.operators import retrieval as R
from loregraph.plans import views as V
from loregraph.plans.text_queries import STRIP, marked
from loregraph.plans.views import n_rows, sql
from loregraph.sources import documents as S
from loregraph.streaming import ingest as I

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


@query("sc2_paged_books", "SELECT doc_id, k//3+1 AS page, row_number() OVER (PARTITION BY doc_id ORDER BY k)-1 AS paragraph_index, l AS text FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS raw, generate_subscripts(string_split(text,chr(10)),1)-1 AS k FROM documents), LATERAL (SELECT " + STRIP.format("raw") + " AS l) WHERE l<>''")
def sc2(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.when(i % 3 == 0, F.concat(F.lit("## Страница "), F.floor(i / 3) + 1, F.lit("\n"), p)).otherwise(p))
    return S.paged_book(V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("# Title\n"), F.array_join(lines, "\n")).alias("text")))


@query("sc3_chunked_documents", "SELECT doc_id, i AS chunk_index, CASE WHEN i=1 THEN 'own' ELSE lang END AS lang, CAST(doc_id AS VARCHAR) AS id FROM (SELECT doc_id, lang, unnest([0,1]) AS i FROM documents)")
def sc3(spark, d):
    raw = F.concat("raw", F.lit("\n---chunk---\n---\nlang: own\n---\nsecond"))
    c = S.chunked_documents(marked(spark, d).select("doc_id", raw.alias("raw")))
    return c.select("doc_id", "chunk_index", F.col("meta")["lang"].alias("lang"), F.col("meta")["doc_id"].alias("id"))


@query("sc6_prefix_types", "SELECT p_partkey, CASE WHEN p_partkey%11=0 THEN 'meta' WHEN starts_with(p_name,'part 1') THEN 'ones' WHEN starts_with(p_name,'part') THEN 'part' WHEN starts_with(p_type,'S') THEN 's' END AS chunk_type FROM (SELECT p_partkey, p_type||p_partkey AS p_name, p_type FROM part)".replace("starts_with(p_name,'part 1')", "starts_with(p_name,'SMALL1')").replace("starts_with(p_name,'part')", "starts_with(p_name,'SMALL')"))
def sc6(spark, d):
    rules = spark.createDataFrame([(1, "SMALL1", "ones"), (2, "SMALL", "part"), (3, "S", "s")], "seq int, prefix string, chunk_type string")
    p = V.table(spark, d, "part").select("p_partkey", F.concat("p_type", "p_partkey").alias("stem"), F.when(F.col("p_partkey") % 11 == 0, "meta").alias("meta_type"))
    return p.select("p_partkey", "stem").join(S.classify_by_prefix(p, rules), "stem").select("p_partkey", "chunk_type")


@query("sc7_image_stubs", "SELECT page_id FROM pages WHERE page_id%3<>0")
def sc7(spark, d):
    p = V.table(spark, d, "pages")
    images = p.select("page_id", F.concat(F.lit("img/p"), "page_id", F.lit(".png")).alias("path"))
    done = p.where("page_id % 3 = 0").select(F.concat(F.lit("md/p"), "page_id", F.lit(".md")).alias("path"))
    return S.missing_transcripts(images, done).select("page_id")


@query("sc9_elements", sql("paragraphs", "SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY paragraph_index)-1 AS number, text, last_value(CASE WHEN paragraph_index%4=0 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS section FROM (SELECT *, paragraph_index//5+1 AS page FROM paragraphs WHERE paragraph_index%7<>5)"))
def sc9(spark, d):
    p = V.paragraphs(spark, d)
    kind = F.when(F.col("paragraph_index") % 7 == 5, "table").when(F.col("paragraph_index") % 4 == 0, "heading").otherwise("paragraph")
    e = p.select("doc_id", F.struct("paragraph_index", kind.alias("type"), F.col("text").alias("content"), (F.floor(F.col("paragraph_index") / 5) + 1).cast("int").alias("page")).alias("e"))
    raw = e.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("e")), lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"), x["page"].alias("page")))).alias("json"))
    return S.flatten_elements(raw).select("doc_id", F.col("page").cast("long").alias("page"), "number", "text", "section")


@query("sc9_deep_elements", sql("paragraphs", """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i, lvl)-1 AS number, type, text, last_value(CASE WHEN type='heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i, lvl) AS section
 FROM (SELECT doc_id, paragraph_index AS i, lvl, paragraph_index//5+1 AS page, CASE WHEN lvl=0 THEN 'paragraph' WHEN lvl=3 THEN 'heading' ELSE 'list item' END AS type, 'L'||lvl||' '||text AS text FROM paragraphs, range(5) t(lvl) WHERE lvl<=paragraph_index%5 AND NOT (lvl=1 AND paragraph_index%2=0))"""))
def sc9_deep(spark, d):
    """Each paragraph as an element with kids up to four levels below it; a level of half of them is of a type that is left out, but not its kids."""
    p = V.paragraphs(spark, d)
    i, node = F.col("paragraph_index"), None
    for level in (4, 3, 2, 1, 0):
        kind = {0: F.lit("paragraph"), 1: F.when(i % 2 == 0, "table").otherwise("list item"), 3: F.lit("heading")}.get(level, F.lit("list item"))
        fields = [kind.alias("type"), F.concat(F.lit(f"L{level} "), "text").alias("content"), (F.floor(i / 5) + 1).cast("int").alias("page")]
        own = F.struct(*fields) if node is None else F.struct(*fields, F.when(i % 5 > level, F.array(node)).alias("kids"))
        node = own
    each = p.select("doc_id", "paragraph_index", F.to_json(node).alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "e"))).alias("es"))
    raw = each.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]")).alias("json"))
    return S.flatten_elements(raw)


@query("sc12_pages")
def sc12(spark, d):
    return S.extract_pages(V.table(spark, d, "pages")).select("page_id", "title", "text", "markdown", F.size("headings").alias("headings"), F.size("links").alias("links"))


@query("x30_page_metadata")
def x30(spark, d):
    return S.extract_pages(V.table(spark, d, "pages")).select("page_id", "title", "lang", "description", "canonical")


@query("sk1_bulk_load", "SELECT event_type AS relation, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id%7 AS k FROM events) GROUP BY 1")
def sk1(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("relation"), (F.col("event_id") % 7).cast("string").alias("target"))
    return G.distinct_edges(e).groupBy("relation").agg(n_rows())


@query("sk5_frontmatter_export", "SELECT doc_id, md5('---'||chr(10)||'lang: \"'||lang||'\"'||chr(10)||'source: \"'||source||'\"'||chr(10)||'---'||chr(10)||text) AS digest FROM documents")
def sk5(spark, d):
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return V.table(spark, d, "documents").select("doc_id", F.md5(S.render_frontmatter(meta, F.col("text"))).alias("digest"))


@query("sk7_incremental_nodes", sql("nodes", "SELECT node_id FROM (SELECT DISTINCT unnest(['user_'||user_id, 'metal_ni']) AS node_id FROM events) e WHERE node_id NOT IN (SELECT node_id FROM nodes)"))
def sk7(spark, d):
    new = V.table(spark, d, "events").select(F.explode(F.array(F.concat(F.lit("user_"), "user_id"), F.lit("metal_ni"))).alias("node_id")).distinct()
    return new.join(V.nodes(spark, d).select("node_id"), "node_id", "left_anti")


def typed_chunks(spark, d):
    kinds = ("book_text", "constraint_regulation", "constraint_budget", "constraint_example")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("paragraph_index") % 4 + 1).cast("int"))
    factory = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("f"), F.col("doc_id") % 5))
    return V.paragraphs(spark, d).select("chunk_id", "doc_id", kind.alias("chunk_type"), factory.alias("factory"), (F.col("doc_id") % 2 == 0).alias("external"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("doc_id") % 3 + 1).cast("int")).alias("budget_tier"))


TYPED = "SELECT chunk_id, doc_id, ['book_text','constraint_regulation','constraint_budget','constraint_example'][paragraph_index%4+1] AS chunk_type, CASE WHEN doc_id%3<>0 THEN 'f'||(doc_id%5) END AS factory, doc_id%2=0 AS external, ['low','medium','high'][doc_id%3+1] AS budget_tier FROM paragraphs"


for _name, _mode, _where in (("f1_factory_lenient", "lenient", "factory IS NULL OR factory='f2'"), ("f2_factory_strict", "strict", "factory='f2'"), ("f3_factory_shared", "shared", "factory='f2' OR chunk_type='constraint_regulation'")):

    def _filter(spark, d, mode=_mode):
        c = typed_chunks(spark, d)
        return c.where(R.factory_filter(F.col("factory"), F.col("chunk_type"), F.lit("f2"), mode, ("constraint_regulation",))).select("chunk_id", "chunk_type", "factory")

    query(_name, sql("paragraphs", f"SELECT chunk_id, chunk_type, factory FROM typed WHERE {_where}", typed=TYPED))(_filter)


@query("f4_external", sql("paragraphs", "SELECT chunk_type, count(*) AS n FROM typed WHERE external GROUP BY 1", typed=TYPED))
def f4(spark, d):
    return typed_chunks(spark, d).where("external").groupBy("chunk_type").agg(n_rows())


CONSTRAINT = "(chunk_type='constraint_budget' AND budget_tier='medium') OR (chunk_type='constraint_example' AND budget_tier='medium') OR (chunk_type='constraint_regulation' AND (factory IS NULL OR factory='f2'))"


@query("f11_constraints", sql("paragraphs", f"SELECT chunk_id, chunk_type, CASE WHEN chunk_type='constraint_regulation' THEN 2.0 ELSE 1.0 END::DOUBLE AS priority FROM typed WHERE {CONSTRAINT}", typed=TYPED))
def f11(spark, d):
    return typed_chunks(spark, d).where(CONSTRAINT).select("chunk_id", "chunk_type", F.when(F.col("chunk_type") == "constraint_regulation", 2.0).otherwise(1.0).alias("priority"))


@query("rt11_constraint_channel", sql("paragraphs", f"SELECT chunk_id, row_number() OVER (ORDER BY CASE WHEN chunk_type='constraint_regulation' THEN 2.0 ELSE 1.0 END DESC, chunk_id) AS rank FROM typed WHERE {CONSTRAINT} QUALIFY rank<=20", typed=TYPED))
def rt11(spark, d):
    top = f11(spark, d).orderBy(F.desc("priority"), "chunk_id").limit(20)
    return top.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("priority"), "chunk_id")).alias("rank"))


@query("a21_load_stats", sql("paragraphs", "SELECT chunk_type, count(*) AS n, count(factory) AS linked FROM typed GROUP BY 1", typed=TYPED))
def a21(spark, d):
    return typed_chunks(spark, d).groupBy("chunk_type").agg(n_rows(), F.count("factory").alias("linked"))


@query("a20_batch_summary", "SELECT source, count(*) AS total, count(*) FILTER (length(text)>500) AS succeeded, count(*) FILTER (length(text)<=500) AS failed FROM documents GROUP BY 1")
def a20(spark, d):
    ok = F.length("text") > 500
    return V.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


@query("d4_citation_dedupe", sql("paragraphs", "SELECT doc_id, source, min(chunk_id) AS chunk_id FROM paragraphs GROUP BY ALL"))
def d4(spark, d):
    return V.paragraphs(spark, d).groupBy("doc_id", "source").agg(F.min("chunk_id").alias("chunk_id"))


@query("d5_not_loaded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d5(spark, d):
    return V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j6_semi_anti", "SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS loaded, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents GROUP BY 1")
def j6(spark, d):
    docs, labels = V.table(spark, d, "documents").select("doc_id", "lang"), V.table(spark, d, "labels").select("doc_id")
    a = docs.join(labels, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("loaded"))
    b = docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))
    return a.join(b, "lang", "full").na.fill(0)


def messages(spark, d):
    """Events as JSON messages; every ninth has the legacy shape."""
    types = F.create_map(*[F.lit(x) for pair in (("purchase", "chunk.upsert"), ("signup", "graph.triplet"), ("view", I.QUERY), ("click", "chunk.get")) for x in pair])
    kind = F.coalesce(types[F.col("event_type")], F.lit("unknown"))
    value = F.when(F.col("event_id") % 9 == 0, F.to_json(F.struct(F.col("props").alias("query"), F.lit(5).alias("top_k")))).otherwise(F.to_json(F.struct(kind.alias("type"), F.col("props").alias("payload"))))
    return V.table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), value.alias("value"))


MSG = f"SELECT user_id AS key, ts, event_id AS seq, CASE WHEN event_id%9=0 THEN '{I.QUERY}' ELSE CASE event_type WHEN 'purchase' THEN 'chunk.upsert' WHEN 'signup' THEN 'graph.triplet' WHEN 'view' THEN '{I.QUERY}' WHEN 'click' THEN 'chunk.get' ELSE 'unknown' END END AS type, props AS payload FROM events"


@query("st1_envelopes", sql("", "SELECT type, count(*) AS n FROM msg GROUP BY 1", msg=MSG))
def st1(spark, d):
    return I.envelopes(messages(spark, d)).groupBy("type").agg(n_rows())


@query("st2_dispatch", sql("", "SELECT CASE WHEN type='unknown' THEN 'dead_letter' ELSE type END AS route, count(*) AS n FROM msg GROUP BY 1", msg=MSG))
def st2(spark, d):
    return I.dispatch(I.envelopes(messages(spark, d))).groupBy("route").agg(n_rows())


@query("st3_chunk_upserts", sql("", "SELECT key, payload, seq FROM msg WHERE type='chunk.upsert' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC)=1", msg=MSG))
def st3(spark, d):
    own = I.dispatch(I.envelopes(messages(spark, d))).where("route = 'chunk.upsert'")
    return I.latest_per_key(own).select("key", "payload", "seq")


@query("st7_progress", "SELECT user_id AS request_id, event_type AS step_id, count(*)>0 AS seen, epoch(date_trunc('second', max(ts)))-epoch(date_trunc('second', (SELECT min(ts) FROM events x WHERE x.user_id=events.user_id))) AS elapsed FROM events GROUP BY 1,2")
def st7(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("step_id"), F.lit("done").alias("status"), "ts", F.col("event_id").alias("seq"))
    return I.step_status(e).select("request_id", "step_id", (F.col("status") == "done").alias("seen"), F.col("elapsed").cast("double").alias("elapsed"))


