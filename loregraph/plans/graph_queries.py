"""Queries on the property graph and on passage wiring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.operators import graph as G
from loregraph.operators import losses as L
from loregraph.operators.chunking import tag_entities
from loregraph.plans import views as V
from loregraph.plans.views import n_rows, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


@query("a1_graph_stats", sql("nodes", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE node_type='LossForm') AS loss_forms"))
def a1(spark, d):
    n = V.nodes(spark, d).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "LossForm").alias("loss_forms"))
    e = V.edges(spark, d).agg(F.count(F.lit(1)).alias("edges"))
    return n.join(F.broadcast(e), F.lit(True), "left").select("nodes", "edges", "loss_forms")  # one row each


@query("a3_edge_stats", sql("edges", "SELECT relation, count(*) AS n FROM edges GROUP BY 1"))
def a3(spark, d):
    return V.edges(spark, d).groupBy("relation").agg(n_rows())


@query("a4_node_counts", sql("nodes", "SELECT node_type, count(*) AS n, count(*) FILTER (node_id NOT IN (SELECT source FROM edges) AND node_id NOT IN (SELECT target FROM edges)) AS isolated FROM nodes GROUP BY 1"))
def a4(spark, d):
    e = V.edges(spark, d)
    ends = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct().withColumn("_in", F.lit(True))
    return V.nodes(spark, d).join(ends, "node_id", "left").groupBy("node_type").agg(n_rows(), F.count_if(F.col("_in").isNull()).alias("isolated"))


@query("gr5_rule_edges", sql("rule_edges", "SELECT source, relation, target FROM rule_edges"))
def gr5(spark, d):
    return L.rule_edges(V.loss_forms(spark, d), V.rules(spark))


@query("gr6_taxonomy_edges", sql("taxonomy", "SELECT source, relation, target FROM taxonomy"))
def gr6(spark, d):
    return L.taxonomy_edges(V.loss_forms(spark, d))


@query("gr7_factory_equipment", "SELECT factory, count(*) AS n, string_agg(equipment, ',' ORDER BY equipment) AS equipment FROM (" + V.CTES["equipment"] + ") GROUP BY 1")
def gr7(spark, d):
    return V.factory_equipment(spark, d).groupBy("factory").agg(n_rows(), F.array_join(F.array_sort(F.collect_list("equipment")), ",").alias("equipment"))


@query("f6_equipment_allowed", sql("equipment", "SELECT s_suppkey, e AS node_id FROM supplier JOIN nation ON s_nationkey=n_nationkey, (SELECT unnest(['equip_a','equip_b','mech_a']) AS e) WHERE NOT starts_with(e,'equip_') OR EXISTS (SELECT 1 FROM equipment q WHERE q.factory=n_name AND q.equipment=e)"))
def f6(spark, d):
    s = V.table(spark, d, "supplier").join(V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.col("n_name").alias("factory"), F.explode(F.array(F.lit("equip_a"), F.lit("equip_b"), F.lit("mech_a"))).alias("node_id"))
    allowed = V.factory_equipment(spark, d).select("factory", F.col("equipment").alias("node_id"), F.lit(True).alias("_ok"))
    known = V.factory_equipment(spark, d).select("factory").distinct().withColumn("_known", F.lit(True))
    s = s.join(allowed, ["factory", "node_id"], "left").join(known, "factory", "left")
    return s.where(~F.col("node_id").startswith("equip_") | F.col("_ok") | F.col("_known").isNull()).select("s_suppkey", "node_id")


@query("f5_retrieval_nodes", sql("nodes", "SELECT node_type, count(*) AS n FROM nodes WHERE regexp_matches(node_id,'^(lossform_|mech_|process_|equip_|mineral_|reagent_)') GROUP BY 1"))
def f5(spark, d):
    return V.nodes(spark, d).where(G.has_prefix(F.col("node_id"))).groupBy("node_type").agg(n_rows())


def starts(spark, d):
    return V.loss_forms(spark, d).where("recoverable").select(F.col("node_id").alias("start_id"))


def walk(hops: int, where: str) -> dict[str, str]:
    return dict(
        e=f"SELECT DISTINCT source, relation, target FROM edges WHERE {where}",
        paths=f"""SELECT node_id AS start_id, 0 AS hops, [node_id] AS nodes, CAST([] AS VARCHAR[]) AS rels, CAST([] AS VARCHAR[]) AS used FROM loss WHERE recoverable
          UNION ALL SELECT start_id, hops+1, list_append(nodes,target), list_append(rels,relation), list_append(used, source||chr(1)||relation||chr(1)||target) FROM paths JOIN e ON nodes[-1]=source
          WHERE hops<{hops} AND NOT list_contains(used, source||chr(1)||relation||chr(1)||target)""",
    )


INT = "relation IN ('EXPLAINED_BY','ADDRESSED_BY','USES_EQUIPMENT','RELATED_MECHANISM')"
PATH = "array_to_string(nodes,'>') AS nodes, array_to_string(rels,'>') AS relations"


def flat(paths):
    return paths.select("start_id", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"))


@query("gr1_paths", sql("edges", f"SELECT start_id, hops, {PATH} FROM (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY hops, array_to_string(nodes,'>'), array_to_string(rels,'>')) AS k FROM paths WHERE hops>0) WHERE k<=20", **walk(3, INT)))
def gr1(spark, d):
    return flat(G.traverse(starts(spark, d), V.edges(spark, d)))


@query("gr2_reachable", sql("edges", "SELECT start_id, nodes[-1] AS node_id, min(hops) AS hops FROM paths WHERE hops>0 GROUP BY 1,2", **walk(3, INT)))
def gr2(spark, d):
    return G.reachable(starts(spark, d), V.edges(spark, d))


@query("gr3_intervention_paths", sql("edges", f"SELECT start_id, hops, {PATH} FROM paths WHERE hops>0", **walk(4, INT)))
def gr3(spark, d):
    return flat(G.traverse(starts(spark, d), V.edges(spark, d), max_hops=4, max_paths=None))


@query("gr8_primary_path", sql("edges", f"SELECT start_id, hops, {PATH} FROM paths WHERE hops>0 QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY hops DESC, array_to_string(nodes,'>'))=1", **walk(3, INT)))
def gr8(spark, d):
    return flat(G.primary_path(G.traverse(starts(spark, d), V.edges(spark, d))))


NEAR = "SELECT source AS node_id, relation, 'out' AS direction, target AS neighbour FROM edges WHERE {0} UNION SELECT target, relation, 'in', source FROM edges WHERE {1}"


@query("gr4_neighbours", sql("edges", NEAR.format("starts_with(source,'mech_') OR starts_with(source,'process_')", "starts_with(target,'mech_') OR starts_with(target,'process_')")))
def gr4(spark, d):
    s = V.nodes(spark, d).where("node_type in ('Mechanism', 'Process')")
    return G.neighbours(s, V.edges(spark, d))


@query("d2_both_directions", sql("edges", f"SELECT node_id, count(DISTINCT neighbour) AS degree FROM ({NEAR.format('true', 'true')}) GROUP BY 1"))
def d2(spark, d):
    return G.neighbours(V.nodes(spark, d), V.edges(spark, d)).groupBy("node_id").agg(F.countDistinct("neighbour").alias("degree"))


@query("j7_one_hop", sql("edges loss", "SELECT node_id, relation, target FROM loss JOIN edges ON source=node_id WHERE relation IN ('EXPLAINED_BY','OF_MINERAL')"))
def j7(spark, d):
    e = V.edges(spark, d).where("relation in ('EXPLAINED_BY', 'OF_MINERAL')")
    return V.loss_forms(spark, d).join(e, F.col("node_id") == F.col("source")).select("node_id", "relation", "target")


@query("j8_optional_match", sql("edges loss", "SELECT node_id, target AS mechanism FROM loss LEFT JOIN (SELECT * FROM edges WHERE relation='EXPLAINED_BY') ON source=node_id"))
def j8(spark, d):
    e = V.edges(spark, d).where("relation = 'EXPLAINED_BY'")
    return V.loss_forms(spark, d).join(e, F.col("node_id") == F.col("source"), "left").select("node_id", F.col("target").alias("mechanism"))


@query("j9_process_equipment", sql("edges", "SELECT DISTINCT p, q FROM (SELECT a AS p, a AS q FROM u UNION SELECT a, b FROM u UNION SELECT u.a, v.b FROM u JOIN u v ON u.b=v.a) WHERE starts_with(p,'process_') AND starts_with(q,'equip_')", u="SELECT source AS a, target AS b FROM edges WHERE relation IN ('USES_EQUIPMENT','ADDRESSED_BY') UNION SELECT target, source FROM edges WHERE relation IN ('USES_EQUIPMENT','ADDRESSED_BY')"))
def j9(spark, d):
    e = V.edges(spark, d).where("relation in ('USES_EQUIPMENT', 'ADDRESSED_BY')")
    both = e.union(e.select("target", "relation", "source"))
    s = V.nodes(spark, d).where("node_type = 'Process'").select(F.col("node_id").alias("start_id"))
    r = G.reachable(s, both, hops=2, relations=None)
    return r.where(F.col("node_id").startswith("equip_")).select(F.col("start_id").alias("p"), F.col("node_id").alias("q"))


EVIDENCE = """SELECT h.start_id, h.hop, h.from_id, h.relation, h.to_id, h.hop>1 AS inferred, ev.target AS evidence FROM (
 SELECT start_id, unnest(range(1, hops+1)) AS hop, nodes[unnest(range(1, hops+1))] AS from_id, rels[unnest(range(1, hops+1))] AS relation, nodes[unnest(range(1, hops+1))+1] AS to_id FROM best) h
 LEFT JOIN (SELECT * FROM edges WHERE relation='EVIDENCED_BY') ev ON ev.source=h.to_id"""
BEST = "SELECT * FROM paths WHERE hops>0 QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY hops DESC, array_to_string(nodes,'>'))=1"


@query("gr9_evidence_hops", sql("edges", EVIDENCE, **walk(3, INT), best=BEST))
def gr9(spark, d):
    e = V.edges(spark, d)
    return G.evidence_hops(G.primary_path(G.traverse(starts(spark, d), e)), e)


@query("a22_chain_sources", sql("edges", "SELECT start_id, count(DISTINCT evidence) AS n_sources, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS sources FROM hops_ GROUP BY 1", **walk(3, INT), best=BEST, hops_=EVIDENCE))
def a22(spark, d):
    e = V.edges(spark, d)
    h = G.evidence_hops(G.primary_path(G.traverse(starts(spark, d), e)), e)
    s = F.array_sort(F.collect_set("evidence"))
    return h.groupBy("start_id").agg(F.size(s).cast("long").alias("n_sources"), F.nullif(F.array_join(s, ","), F.lit("")).alias("sources"))


@query("gr10_indirect_links", sql("edges", "SELECT a.source AS a, c.target AS c, count(DISTINCT a.target) AS via FROM edges a JOIN edges c ON a.target=c.source WHERE a.relation='EXPLAINED_BY' AND c.relation IN ('ADDRESSED_BY','EVIDENCED_BY') AND a.source<>c.target AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.source=a.source AND x.target=c.target) GROUP BY 1,2"))
def gr10(spark, d):
    return G.indirect_links(V.edges(spark, d), ("EXPLAINED_BY",), ("ADDRESSED_BY", "EVIDENCED_BY"))


@query("gr11_chain_checks", sql("edges", "SELECT count(*) AS buckets, count(*) FILTER (h>=1) AS explained, count(*) FILTER (h>=3) AS complete FROM (SELECT start_id, max(hops) AS h FROM paths GROUP BY 1)", **walk(3, INT)))
def gr11(spark, d):
    s = starts(spark, d)
    h = s.join(G.traverse(s, V.edges(spark, d), max_paths=None).groupBy("start_id").agg(F.max("hops").alias("h")), "start_id", "left")
    return h.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("h") >= 1).alias("explained"), F.count_if(F.col("h") >= 3).alias("complete"))


TRIPLES = "SELECT 'user_'||user_id AS subject, CASE WHEN event_id%5=0 THEN ' ' ELSE event_type||' of' END AS predicate, 'kind_'||(event_id%7) AS object FROM events WHERE event_type='signup'"


def triples(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'signup'")
    return e.select(F.concat(F.lit("user_"), "user_id").alias("subject"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat("event_type", F.lit(" of"))).alias("predicate"), F.concat(F.lit("kind_"), F.col("event_id") % 7).alias("object"))


@query("gr12_triplets", sql("", "SELECT DISTINCT subject AS source, CASE WHEN trim(predicate)='' THEN 'RELATED_TO' ELSE upper(replace(trim(predicate),' ','_')) END AS relation, object AS target FROM tr", tr=TRIPLES))
def gr12(spark, d):
    return G.triplets(triples(spark, d))[1]


@query("gr13_factory_subgraph", sql("edges nodes", "SELECT start_id, node_id, min(h) AS hops FROM (SELECT start_id, nodes[-1] AS node_id, hops AS h FROM fp WHERE hops>0) GROUP BY 1,2", e="SELECT DISTINCT source, target FROM edges WHERE relation IN ('HAS_EQUIPMENT','HAS_LOSS','EXPLAINED_BY','ADDRESSED_BY','USES_EQUIPMENT')", fp="SELECT node_id AS start_id, 0 AS hops, [node_id] AS nodes FROM nodes WHERE node_type='Factory' UNION ALL SELECT start_id, hops+1, list_append(nodes,target) FROM fp JOIN e ON nodes[-1]=source WHERE hops<6"))
def gr13(spark, d):
    s = V.nodes(spark, d).where("node_type = 'Factory'").select(F.col("node_id").alias("start_id"))
    return G.reachable(s, V.edges(spark, d), hops=6, relations=("HAS_EQUIPMENT", "HAS_LOSS", "EXPLAINED_BY", "ADDRESSED_BY", "USES_EQUIPMENT"))


NEAR = ("HAS_EQUIPMENT", "HAS_LOSS", "EXPLAINED_BY", "ADDRESSED_BY", "USES_EQUIPMENT", "EVIDENCED_BY")


@query("gr13_neighbourhood", sql("edges nodes", "SELECT start_id, hop, source, relation, target FROM (SELECT start_id, h+1 AS hop, e.source, e.relation, e.target FROM (SELECT start_id, node_id, min(h) AS h FROM near GROUP BY 1,2) n JOIN near_e e ON e.source=node_id WHERE h<6)", near_e="SELECT DISTINCT source, relation, target FROM edges WHERE relation IN ('HAS_EQUIPMENT','HAS_LOSS','EXPLAINED_BY','ADDRESSED_BY','USES_EQUIPMENT','EVIDENCED_BY')", near="SELECT node_id AS start_id, node_id, 0 AS h FROM nodes WHERE node_type='Factory' UNION SELECT start_id, e.target, h+1 FROM near JOIN near_e e ON e.source=node_id WHERE h<6"))
def gr13_edges(spark, d):
    """Each factory's edges of six hops, down to the sources that literature evidence leads to."""
    s = V.nodes(spark, d).where("node_type = 'Factory'").select(F.col("node_id").alias("start_id"))
    return G.neighbourhood(s, V.edges(spark, d), 6, NEAR)


@query("gr14_view_filter", sql("edges nodes", "SELECT e.source, e.relation, e.target FROM edges e JOIN nodes a ON a.node_id=e.source AND a.node_type IN ('LossForm','Mineral','Metal') JOIN nodes b ON b.node_id=e.target AND b.node_type IN ('LossForm','Mineral','Metal') WHERE e.relation IN ('OF_MINERAL','CARRIES_METAL')"))
def gr14(spark, d):
    return G.subgraph(V.nodes(spark, d), V.edges(spark, d), ("LossForm", "Mineral", "Metal"), ("OF_MINERAL", "CARRIES_METAL"))


@query("t5_search_nodes", sql("nodes", "SELECT node_id, node_type, label FROM nodes WHERE contains(lower(label),'an') OR contains(lower(node_id),'an') ORDER BY node_type, label, node_id LIMIT 10"))
def t5(spark, d):
    n = V.nodes(spark, d)
    return n.where(F.lower("label").contains("an") | F.lower("node_id").contains("an")).orderBy("node_type", "label", "node_id").limit(10)


@query("t6_list_by_type", sql("nodes", "SELECT node_id, label FROM nodes WHERE node_type='Factory' ORDER BY label, node_id LIMIT 10"))
def t6(spark, d):
    return V.nodes(spark, d).where("node_type = 'Factory'").orderBy("label", "node_id").limit(10).select("node_id", "label")


@query("t7_literature_evidence", sql("edges tags paragraphs", "SELECT t.node_id, 'source_'||p.source AS source, p.chunk_id FROM tags t JOIN paragraphs p USING (chunk_id) ORDER BY 1, 2, 3 LIMIT 10"))
def t7(spark, d):
    t = V.tags(spark, d).join(V.paragraphs(spark, d).select("chunk_id", F.concat(F.lit("source_"), "source").alias("source")), "chunk_id")
    return t.select("node_id", "source", "chunk_id").orderBy("node_id", "source", "chunk_id").limit(10)


@query("t10_graph_cap", sql("nodes", "SELECT node_id, node_type FROM nodes ORDER BY CASE node_type WHEN 'LossForm' THEN 0 WHEN 'Mechanism' THEN 1 WHEN 'Process' THEN 2 ELSE 9 END, node_id LIMIT 200"))
def t10(spark, d):
    first = F.when(F.col("node_type") == "LossForm", 0).when(F.col("node_type") == "Mechanism", 1).when(F.col("node_type") == "Process", 2).otherwise(9)
    return V.nodes(spark, d).orderBy(first, "node_id").limit(200).select("node_id", "node_type")


@query("d1_edge_dedupe", "SELECT DISTINCT 'user_'||user_id AS source, event_type AS relation, 'kind_'||(event_id%7) AS target FROM events")
def d1(spark, d):
    e = V.table(spark, d, "events").select(F.concat(F.lit("user_"), "user_id").alias("source"), F.col("event_type").alias("relation"), F.concat(F.lit("kind_"), F.col("event_id") % 7).alias("target"))
    return G.distinct_edges(e)


@query("sk2_upsert_nodes", "SELECT 'user_'||user_id AS node_id, arg_max(event_type, event_id) AS node_type, max(event_id) AS last_seq, count(DISTINCT event_type) AS n_attrs FROM events GROUP BY 1")
def sk2(spark, d):
    e = V.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("user_"), "user_id").alias("node_id"), F.col("event_type").alias("node_type"), F.lit("").alias("label"), F.create_map("event_type", F.col("event_id").cast("string")).alias("attrs"), F.col("event_id").alias("seq"))
    merged = G.upsert_nodes(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))
    last = F.array_max(F.transform(F.map_values("attrs"), lambda v: v.cast("long")))
    return merged.select("node_id", "node_type", last.alias("last_seq"), F.size("attrs").cast("long").alias("n_attrs"))


@query("sk3_upsert_edges", "SELECT 'user_'||user_id AS source, event_type AS relation, 'kind_'||(event_id%7) AS target, arg_max(event_id, event_id) AS weight FROM events WHERE event_id%7<>3 GROUP BY 1,2,3")
def sk3(spark, d):
    e = V.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("user_"), "user_id").alias("source"), F.col("event_type").alias("relation"), F.concat(F.lit("kind_"), F.col("event_id") % 7).alias("target"), F.col("event_id").alias("weight"), F.col("event_id").alias("seq"))
    nodes = rows.select(F.explode(F.array("source", "target")).alias("node_id")).where("node_id <> 'kind_3'")
    return G.upsert_edges(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), nodes)


@query("sk4_upsert_chunks", "SELECT user_id, event_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1")
def sk4(spark, d):
    return G.latest(V.table(spark, d, "events").select("user_id", "event_id", "event_type", "props"), "user_id", "event_id")


def passages(spark, d):
    return V.paragraphs(spark, d).withColumn("page", F.floor(F.col("paragraph_index") / 5) + 1)


NEXT = "SELECT 'passage_'||chunk_id AS source, 'NEXT_PASSAGE' AS relation, 'passage_'||lead(chunk_id) OVER (PARTITION BY source, doc_id ORDER BY paragraph_index//5, paragraph_index, chunk_id) AS target FROM paragraphs"


@query("w1_next_passage", sql("paragraphs", f"SELECT * FROM ({NEXT}) WHERE target IS NOT NULL"))
def w1(spark, d):
    return G.reading_order(passages(spark, d))


@query("pw1_passage_nodes", sql("paragraphs", "SELECT 'passage_'||chunk_id AS source, 'PART_OF' AS relation, 'source_'||source AS target FROM paragraphs"))
def pw1(spark, d):
    return V.paragraphs(spark, d).select(F.concat(F.lit("passage_"), "chunk_id").alias("source"), F.lit("PART_OF").alias("relation"), F.concat(F.lit("source_"), "source").alias("target"))


@query("pw2_mentions", sql("tags lexicon", "SELECT 'passage_'||chunk_id AS source, 'MENTIONS' AS relation, node_id AS target FROM tags"))
def pw2(spark, d):
    t = V.tags(spark, d).join(V.nodes(spark, d).select("node_id"), "node_id", "left_semi")
    return t.select(F.concat(F.lit("passage_"), "chunk_id").alias("source"), F.lit("MENTIONS").alias("relation"), F.col("node_id").alias("target"))


@query("a7_entity_frequency", sql("tags", "SELECT node_id, count(*) AS n FROM tags GROUP BY 1"))
def a7(spark, d):
    return V.tags(spark, d).groupBy("node_id").agg(n_rows())


TOPIC = dict(
    rare="SELECT * FROM tags WHERE node_id IN (SELECT node_id FROM tags GROUP BY 1 HAVING count(*)<=350)",
    pairs="SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS shared, string_agg(node_id, ',' ORDER BY node_id) AS entities FROM rare x JOIN rare y USING (node_id) WHERE x.chunk_id<>y.chunk_id GROUP BY 1,2 HAVING count(*)>=2",
    ranked="SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM pairs QUALIFY rank<=10",
)


@query("w6_top_neighbours", sql("tags", "SELECT a, b, shared, entities, rank FROM ranked", **TOPIC))
def w6(spark, d):
    return G.ranked_neighbours(G.topic_pairs(V.tags(spark, d)))


@query("pw4_topics", sql("tags", "SELECT DISTINCT least(a,b) AS source, 'SHARES_TOPIC' AS relation, greatest(a,b) AS target, shared AS shared_count, entities FROM ranked", **TOPIC))
def pw4(spark, d):
    return G.topic_edges(G.ranked_neighbours(G.topic_pairs(V.tags(spark, d))))


@query("pw5_related_sources", sql("tags", "SELECT least(x.source,y.source) AS source, greatest(x.source,y.source) AS target, count(*) AS pairs FROM ranked JOIN paragraphs x ON x.chunk_id=a JOIN paragraphs y ON y.chunk_id=b WHERE x.source<>y.source GROUP BY 1,2", **TOPIC))
def pw5(spark, d):
    return G.source_pairs(G.ranked_neighbours(G.topic_pairs(V.tags(spark, d))), V.paragraphs(spark, d))


HYP = "SELECT 'hyp_'||item_id AS hypothesis_id, node_id FROM benchmark JOIN lexicon ON contains(lower(text), keyword)"


def hypotheses(spark, d):
    b = V.table(spark, d, "benchmark").select(F.concat(F.lit("hyp_"), "item_id").alias("chunk_id"), "text")
    return tag_entities(b, V.lexicon(spark)).withColumnRenamed("chunk_id", "hypothesis_id")


@query("pw6_supports", sql("tags", "SELECT chunk_id, hypothesis_id, count(*) AS shared FROM rare JOIN hyp USING (node_id) GROUP BY 1,2 HAVING count(*)>=1", hyp=HYP, rare=TOPIC["rare"]))
def pw6(spark, d):
    t = V.tags(spark, d)
    rare = t.join(t.groupBy("node_id").agg(n_rows()).where("n <= 350"), "node_id", "left_semi")
    return G.supports(rare, hypotheses(spark, d))


@query("pw8_incremental_topics", sql("tags paragraphs", "SELECT a, b, shared, rank FROM ranked JOIN paragraphs p ON p.chunk_id=a WHERE p.source='src3'", **TOPIC))
def pw8(spark, d):
    new = V.paragraphs(spark, d).where("source = 'src3'").select("chunk_id")
    return G.ranked_neighbours(G.topic_pairs(V.tags(spark, d), new_ids=new)).select("a", "b", "shared", "rank")


@query("rt12_expanded_nodes", sql("edges", "SELECT start_id, count(DISTINCT node_id) AS n, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS nodes FROM (SELECT start_id, unnest(nodes) AS node_id FROM paths WHERE hops>0 UNION SELECT source, target FROM edges JOIN loss ON node_id=source AND recoverable WHERE relation='OF_MINERAL') GROUP BY 1", **walk(3, INT)))
def rt12(spark, d):
    e = V.edges(spark, d)
    s = starts(spark, d)
    on_path = G.traverse(s, e, max_paths=None).select("start_id", F.explode("nodes").alias("node_id"))
    mineral = s.join(e.where("relation = 'OF_MINERAL'"), F.col("start_id") == F.col("source")).select("start_id", F.col("target").alias("node_id"))
    every = F.array_sort(F.collect_set("node_id"))
    return on_path.union(mineral).where(G.has_prefix(F.col("node_id"))).groupBy("start_id").agg(F.size(every).cast("long").alias("n"), F.array_join(every, ",").alias("nodes"))


SETS = "SELECT {0}, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS nodes FROM {1} GROUP BY 1"


@query("pw6_support_classes", sql("tags", "SELECT x.nodes AS left_nodes, y.nodes AS right_nodes, x.n AS left_n, y.n AS right_n, len(list_intersect(string_split(x.nodes,','), string_split(y.nodes,',')))::BIGINT AS shared FROM (SELECT nodes, count(*) AS n FROM ps GROUP BY 1) x JOIN (SELECT nodes, count(*) AS n FROM hs GROUP BY 1) y ON len(list_intersect(string_split(x.nodes,','), string_split(y.nodes,',')))>0", hyp=HYP, ps=SETS.format("chunk_id", "tags"), hs=SETS.format("hypothesis_id", "hyp")))
def pw6_classes(spark, d):
    """Support by classes of equal entities, over all entities, however frequent: what pairs of passages and hypotheses would tell, without listing them."""
    t, h = V.tags(spark, d), hypotheses(spark, d)
    a, b, pairs = G.shared_classes(t, h, "chunk_id", "hypothesis_id")
    x = a.groupBy("left_set").agg(F.count(F.lit(1)).alias("left_n")).join(G.node_sets(t, "chunk_id").select(F.col("set_id").alias("left_set"), F.array_join("nodes", ",").alias("left_nodes")).distinct(), "left_set")
    y = b.groupBy("right_set").agg(F.count(F.lit(1)).alias("right_n")).join(G.node_sets(h, "hypothesis_id").select(F.col("set_id").alias("right_set"), F.array_join("nodes", ",").alias("right_nodes")).distinct(), "right_set")
    return pairs.join(x, "left_set").join(y, "right_set").select("left_nodes", "right_nodes", "left_n", "right_n", "shared")
