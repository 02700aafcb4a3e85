"""Queries on message batches: errors, attributes of triplets, steps, and what documents do to the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.plans import graph_queries as GQ
from loregraph.plans import views as V
from loregraph.plans.text_queries import STRIP
from loregraph.plans.views import slug_sql, sql
from loregraph.store import stored
from loregraph.streaming import ingest as I
from loregraph.streaming import knowledge as KB

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def faulty_messages(spark, d):
    """Events as messages of every kind; of five, one has a broken payload and one an empty one."""
    e = V.table(spark, d, "events")
    kinds = ("purchase", "chunk.upsert"), ("signup", "graph.triplet"), ("view", "graph_rag.query"), ("click", "chunk.get")
    types = F.create_map(*[F.lit(x) for pair in kinds for x in pair])
    whole = F.to_json(F.struct(F.concat(F.lit("c"), "event_id").alias("chunk_id"), F.col("props").alias("question"), F.struct(F.concat(F.lit("user_"), "user_id").alias("node_id")).alias("subject"), F.struct(F.lit("k").alias("node_id")).alias("object")))
    payload = F.when(F.col("event_id") % 5 == 1, "{broken").when(F.col("event_id") % 5 == 2, "{}").otherwise(whole)
    value = F.to_json(F.struct(F.coalesce(types[F.col("event_type")], F.lit("unknown")).alias("type"), payload.alias("payload")))
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), value.alias("value"))


@query("st2_errors", """SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'chunk.upsert' WHEN 'signup' THEN 'graph.triplet' WHEN 'view' THEN 'graph_rag.query' WHEN 'click' THEN 'chunk.get' ELSE 'dead_letter' END AS route,
 CASE WHEN event_type NOT IN ('purchase','signup','view','click') THEN 'unknown message type: unknown' WHEN event_id%5=1 THEN 'malformed payload' WHEN event_type='signup' THEN 'subject and object need a node_id' WHEN event_type='view' THEN 'question required' ELSE 'chunk_id required' END AS error
 FROM events WHERE event_id%5 IN (1,2) OR event_type NOT IN ('purchase','signup','view','click')""")
def st2(spark, d):
    return I.checked(I.envelopes(faulty_messages(spark, d))).where("error is not null").select("seq", "route", "error")


def attributed_triplets(spark, d):
    e = V.table(spark, d, "events")
    seen = F.create_map(F.lit("last"), F.col("event_id").cast("string"), F.col("event_type"), F.lit("seen"))
    subject = F.struct(F.concat(F.lit("user_"), "user_id").alias("node_id"), seen.alias("attributes"))
    target = F.struct(F.concat(F.lit("k_"), F.col("event_id") % 11).alias("node_id"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("even"), F.col("user_id").cast("string"))).alias("attributes"))
    payload = F.to_json(F.struct(subject.alias("subject"), target.alias("object"), F.create_map(F.lit("value"), F.col("event_id").cast("string")).alias("attributes")))
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.to_json(F.struct(F.lit("graph.triplet").alias("type"), payload.alias("payload"))).alias("value"))


@query("st4_node_attributes", """SELECT node_id, name, value FROM (SELECT 'user_'||user_id AS node_id, 'last' AS name, event_id::VARCHAR AS value, ts, event_id FROM events UNION ALL SELECT 'user_'||user_id, event_type, 'seen', ts, event_id FROM events
 UNION ALL SELECT 'k_'||(event_id%11), 'even', user_id::VARCHAR, ts, event_id FROM events WHERE event_id%2=0) QUALIFY row_number() OVER (PARTITION BY node_id, name ORDER BY ts DESC, event_id DESC)=1""")
def st4_nodes(spark, d):
    nodes, _ = I.triplet_rows(I.envelopes(attributed_triplets(spark, d)))
    return nodes.select("node_id", F.explode("attrs").alias("name", "value"))


@query("st4_edge_attributes", "SELECT 'user_'||user_id AS source, 'k_'||(event_id%11) AS target, event_id::VARCHAR AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id%11 ORDER BY ts DESC, event_id DESC)=1")
def st4_edges(spark, d):
    _, edges = I.triplet_rows(I.envelopes(attributed_triplets(spark, d)))
    return edges.select("source", "target", F.col("attrs")["value"].alias("value"))


def step_events(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, "done").otherwise("running")
    return V.table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("step_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


@query("st7_steps", """SELECT request_id, step_id, CASE WHEN status='running' AND step_id<>last_step THEN 'done' ELSE status END AS status, epoch(date_trunc('second', ts))-epoch(date_trunc('second', first_ts)) AS elapsed
 FROM (SELECT user_id AS request_id, event_type AS step_id, CASE WHEN event_id%3=0 THEN 'done' ELSE 'running' END AS status, ts, min(ts) OVER (PARTITION BY user_id) AS first_ts,
  first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_step, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1""")
def st7(spark, d):
    return I.step_status(step_events(spark, d)).withColumn("elapsed", F.col("elapsed").cast("double"))


def document_messages(spark, d):
    """A quarter of the documents as books in Markdown, a quarter as external texts, a twelfth as loss buckets."""
    docs, i = V.table(spark, d, "documents").where("text is not null"), F.col("doc_id")
    head = F.concat(F.lit("---\ndoc_id: n"), "doc_id", F.coalesce(F.concat(F.lit("\nsource: note "), "source"), F.lit("")), F.lit("\n---\n"))
    book = F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n---chunk---\n")), F.lit("\n"))
    bucket = F.concat(F.lit("---\nfactory: f"), i % 5, F.lit("\nsize_class: +71\nmineral_form: pyrite\nmetal: Ni\ntonnes: "), "doc_id", F.lit("\n---\n"))
    path = F.concat(F.lit("in/"), "doc_id", F.lit(".md"))
    payload = (
        F.when(i % 4 == 0, F.to_json(F.struct(book.alias("markdown"), path.alias("source_path"))))
        .when(i % 4 == 1, F.to_json(F.struct(F.concat(F.lit("Note "), "doc_id").alias("title"), "text")))
        .when(i % 12 == 2, F.to_json(F.struct(bucket.alias("markdown"), path.alias("source_path"))))
    )
    kind = F.when(i % 4 == 1, "external.ingest").otherwise("ingest.markdown")
    rows = docs.select(i.alias("key"), F.timestamp_seconds(i).alias("ts"), i.alias("seq"), kind.alias("type"), payload.alias("payload")).where("payload is not null")
    return rows.select("key", "ts", "seq", F.to_json(F.struct("type", "payload")).alias("value"))


def ingested(spark, d):
    """(new nodes, new edges, chunks, passage nodes, wiring) of the batch next to the graph of the given tables."""
    facts = I.document_facts(I.envelopes(document_messages(spark, d)), V.lexicon(spark)).stored()
    nodes, edges = stored(V.nodes(spark, d).select("node_id")), V.edges(spark, d)
    new, more = KB.admitted(facts, nodes, edges)
    return facts, nodes, new, more


LINES = f"SELECT doc_id, source, k-1 AS idx, t FROM (SELECT doc_id, source, k, {STRIP.format('l')} AS t FROM (SELECT doc_id, source, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1) AS k FROM documents)) WHERE t<>''"
CHUNK = """SELECT 'book_n'||doc_id||'_i'||idx AS chunk_id, coalesce('note '||source, doc_id||'.md') AS source, CAST(NULL AS VARCHAR) AS source_id, 'n'||doc_id AS doc_id, idx, t, 'book_text' AS kind FROM lines_ WHERE doc_id%4=0
 UNION ALL SELECT 'external_note_'||doc_id||'_paragraph_i'||(row_number() OVER (PARTITION BY doc_id ORDER BY idx)-1), 'Note '||doc_id, 'source_external_note_'||doc_id, 'source_external_note_'||doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx)-1, t, 'external_text' FROM lines_ WHERE doc_id%4=1"""
SOURCED = f"SELECT chunk_id, source, coalesce(source_id, {slug_sql(chr(39) + 'source' + chr(39), 'source')}) AS source_id, doc_id, idx, t, kind FROM chunk0"
BUCKETS = "SELECT DISTINCT 'lossform_f'||(doc_id%5)||'_+71_pyrite_ni' AS node_id, 'factory_f'||(doc_id%5) AS factory, doc_id FROM documents WHERE doc_id%12=2"
INGEST = dict(
    lines_=LINES, chunk0=CHUNK, newc=SOURCED, bucket=BUCKETS,
    newtags="SELECT DISTINCT chunk_id, source_id, node_id FROM newc JOIN lexicon ON contains(lower(t), keyword)",
    cand="SELECT node_id, 'LossForm' AS node_type FROM bucket UNION SELECT source_id, 'Source' FROM newtags WHERE starts_with(chunk_id,'book_') UNION SELECT 'source_external_note_'||doc_id, 'Source' FROM documents WHERE doc_id%4=1 AND trim(text)<>''",
    newn="SELECT node_id, node_type FROM cand WHERE node_id NOT IN (SELECT node_id FROM nodes)",
    ids="SELECT node_id FROM nodes UNION SELECT node_id FROM newn",
    tax="""SELECT factory AS source, 'HAS_LOSS' AS relation, node_id AS target FROM bucket UNION SELECT node_id, 'IN_SIZECLASS', 'size_+71' FROM bucket UNION SELECT node_id, 'OF_MINERAL', 'mineral_pyrite' FROM bucket
 UNION SELECT node_id, 'CARRIES_METAL', 'metal_ni' FROM bucket UNION SELECT node_id, 'NON_RECOVERABLE', 'metal_ni' FROM bucket UNION SELECT factory, 'RELATED_TO', 'size_+71' FROM bucket UNION SELECT node_id, 'EVIDENCED_BY', source_id FROM newtags""",
    newe="SELECT * FROM tax WHERE source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids) EXCEPT SELECT source, relation, target FROM edges",
    said="SELECT chunk_id, node_id FROM newtags WHERE regexp_matches(node_id,'^(mech_|process_|equip_|reagent_|mineral_|metal_)')",
    every="SELECT chunk_id, node_id FROM tags UNION SELECT chunk_id, node_id FROM said",
    rare="SELECT * FROM every WHERE node_id IN (SELECT node_id FROM every GROUP BY 1 HAVING count(*)<=350)",
    pairs="SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS shared FROM rare x JOIN newc n ON n.chunk_id=x.chunk_id JOIN rare y USING (node_id) WHERE x.chunk_id<>y.chunk_id GROUP BY 1,2 HAVING count(*)>=2",
    ranked="SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b)<=10",
)
NEEDS = "tags edges nodes lexicon"


@query("sk7_ingest_nodes", sql(NEEDS, "SELECT node_id, node_type FROM newn", **INGEST))
def sk7_nodes(spark, d):
    return ingested(spark, d)[2].select("node_id", "node_type")


@query("sk7_ingest_edges", sql(NEEDS, "SELECT source, relation, target FROM newe", **INGEST))
def sk7_edges(spark, d):
    return ingested(spark, d)[3].select("source", "relation", "target")


@query("sk7_ingest_chunks", sql(NEEDS, "SELECT chunk_id, source, kind AS chunk_type, md5(t) AS digest, (SELECT count(*) FROM newtags g WHERE g.chunk_id=newc.chunk_id)::BIGINT AS tagged FROM newc", **INGEST))
def sk7_chunks(spark, d):
    c = ingested(spark, d)[0].chunks.where("chunk_type <> 'excel_bucket'")
    tagged = F.size(F.filter("graph_node_ids", lambda x: ~x.startswith("source_"))).cast("long")
    return c.select("chunk_id", "source", "chunk_type", F.md5("text").alias("digest"), tagged.alias("tagged"))


def wired(spark, d):
    facts, nodes, new, _ = ingested(spark, d)
    hyps = GQ.hypotheses(spark, d)
    return KB.wire(facts.chunks, V.tags(spark, d), nodes.union(new.select("node_id")), hyps)


WIRING = """SELECT 'passage_'||chunk_id AS source, 'PART_OF' AS relation, source_id AS target FROM newc UNION ALL SELECT 'passage_'||chunk_id, 'MENTIONS', node_id FROM said
 UNION ALL SELECT * FROM (SELECT 'passage_'||chunk_id, 'NEXT_PASSAGE', 'passage_'||lead(chunk_id) OVER (PARTITION BY source, doc_id ORDER BY idx, chunk_id) AS nx FROM newc) WHERE nx IS NOT NULL
 UNION ALL SELECT DISTINCT 'passage_'||least(a,b), 'SHARES_TOPIC', 'passage_'||greatest(a,b) FROM ranked"""


@query("sk7_ingest_wiring", sql(NEEDS, WIRING, **INGEST))
def sk7_wiring(spark, d):
    return wired(spark, d)[1].where("relation <> 'SUPPORTS_HYPOTHESIS'").select("source", "relation", "target")


@query("sk7_ingest_support", sql(NEEDS, "SELECT hypothesis_id, count(*) AS passages, sum(shared)::BIGINT AS shared FROM (SELECT hypothesis_id, chunk_id, count(*) AS shared FROM said JOIN (SELECT DISTINCT * FROM hyp) USING (node_id) GROUP BY 1,2) GROUP BY 1", **INGEST, hyp=GQ.HYP))
def sk7_support(spark, d):
    e = wired(spark, d)[1].where("relation = 'SUPPORTS_HYPOTHESIS'")
    return e.groupBy(F.col("target").alias("hypothesis_id")).agg(F.count(F.lit(1)).alias("passages"), F.sum(F.col("attrs")["shared"].cast("long")).alias("shared"))
