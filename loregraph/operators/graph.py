"""The property graph as tables: upserts, expansion, bounded traversal, evidence chains, passage wiring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.text import slug
from loregraph.store import stored

# Relations of intervention paths, prefixes of retrieval and topic nodes, limits of topic wiring.
INTERVENTION = ("EXPLAINED_BY", "ADDRESSED_BY", "USES_EQUIPMENT", "RELATED_MECHANISM")
RETRIEVAL_PREFIXES = ("lossform_", "mech_", "process_", "equip_", "mineral_", "reagent_")
TOPIC_PREFIXES = ("mech_", "process_", "equip_", "reagent_", "mineral_", "metal_")
MAX_TOPIC_FREQUENCY, MIN_SHARED, MAX_NEIGHBOURS = 350, 2, 10


def has_prefix(node_id: Column, prefixes: tuple[str, ...] = RETRIEVAL_PREFIXES) -> Column:
    return node_id.rlike("^(" + "|".join(prefixes) + ")")


def node_type(node_id: Column) -> Column:
    names = {"lossform_": "LossForm", "mech_": "Mechanism", "process_": "Process", "equip_": "Equipment", "mineral_": "Mineral", "reagent_": "Reagent", "metal_": "Metal", "factory_": "Factory", "size_": "SizeClass", "passage_": "Passage", "hyp_": "Hypothesis"}
    out = F.lit("Source")
    for prefix, name in names.items():
        out = F.when(node_id.startswith(prefix), name).otherwise(out)
    return out


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source", "relation", "target"])


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge (node_id, node_type, label, attrs) by id: attributes of later rows (seq) win, a missing label becomes the id."""
    rows = old.unionByName(new)
    each = rows.select("node_id", "seq", F.explode("attrs").alias("key", "value")).groupBy("node_id", "key").agg(F.max_by("value", "seq").alias("value"))
    attrs = each.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attrs"))
    out = rows.groupBy("node_id").agg(F.max_by("node_type", "seq").alias("node_type"), F.max_by("label", "seq").alias("label")).join(attrs, "node_id", "left")
    return out.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.col("node_id")))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by (source, relation, target), later ones (seq) winning; both ends must exist."""
    ids = nodes.select("node_id").distinct()
    e = old.unionByName(new).groupBy("source", "relation", "target").agg(F.max_by("weight", "seq").alias("weight"))
    e = e.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def neighbours(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (node_id, relation, direction, neighbour) of both directions."""
    s = starts.select("node_id").distinct()
    out = s.join(edges, F.col("node_id") == F.col("source")).select("node_id", "relation", F.lit("out").alias("direction"), F.col("target").alias("neighbour"))
    into = s.join(edges, F.col("node_id") == F.col("target")).select("node_id", "relation", F.lit("in").alias("direction"), F.col("source").alias("neighbour"))
    return out.union(into).distinct()


def traverse(starts: DataFrame, edges: DataFrame, max_hops: int = 3, relations: tuple[str, ...] | None = INTERVENTION, max_paths: int | None = 20, maximal_only: bool = False) -> DataFrame:
    """Every path of 1 to max_hops edges from each start, no edge twice: start_id, hops, nodes and relations."""
    e = edges.select("source", "relation", "target").distinct()
    if relations:
        e = e.where(F.col("relation").isin(*relations))
    e = e.select(F.col("source").alias("_s"), F.col("relation").alias("_r"), F.col("target").alias("_t"))
    frontier = starts.select("start_id", F.array("start_id").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<string>").alias("_used"))
    out = None
    for hop in range(1, max_hops + 1):
        step = frontier.join(e, F.element_at("nodes", -1) == F.col("_s"))
        key = F.concat_ws("\u0001", "_s", "_r", "_t")
        step = step.where(~F.array_contains("_used", key))
        frontier = step.select("start_id", F.concat("nodes", F.array("_t")).alias("nodes"), F.concat("relations", F.array("_r")).alias("relations"), F.concat("_used", F.array(key)).alias("_used"))
        part = frontier.select("start_id", F.lit(hop).alias("hops"), "nodes", "relations")
        if maximal_only and hop < max_hops:
            part = part.join(e, F.element_at("nodes", -1) == F.col("_s"), "left_anti")
        out = part if out is None else out.union(part)
    if max_paths is None:
        return out
    w = Window.partitionBy("start_id").orderBy("hops", F.array_join("nodes", ">"), F.array_join("relations", ">"))
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_paths).drop("_n")


def reachable(starts: DataFrame, edges: DataFrame, hops: int = 3, relations: tuple[str, ...] | None = INTERVENTION) -> DataFrame:
    """Distinct (start_id, node_id, hops) with the fewest hops. Of each hop only the nodes that no earlier one has reached go on."""
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    e = stored(e.select("source", "target").distinct())
    frontier, seen = starts.select("start_id", F.col("start_id").alias("node_id")).distinct(), None
    for hop in range(1, hops + 1):
        new = frontier.join(e, F.col("node_id") == F.col("source")).select("start_id", F.col("target").alias("node_id")).distinct()
        if seen is not None:
            new = new.join(seen, ["start_id", "node_id"], "left_anti")
        frontier = stored(new)
        part = frontier.withColumn("hops", F.lit(hop))
        seen = part if seen is None else seen.union(part)
        if hop < hops and frontier.isEmpty():
            break
    return seen


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 6, relations: tuple[str, ...] | None = None) -> DataFrame:
    """The edges within ``hops`` of each start: start_id, hop (the first on which an edge can be gone), source, relation, target."""
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    near = reachable(starts, edges, hops - 1, relations).select("start_id", F.col("node_id").alias("source"), "hops") if hops > 1 else None
    own = starts.select("start_id", F.col("start_id").alias("source"), F.lit(0).alias("hops")).distinct()
    at = own if near is None else own.union(near.where("source <> start_id"))
    return at.join(e.select("source", "relation", "target").distinct(), "source").select("start_id", (F.col("hops") + 1).alias("hop"), "source", "relation", "target")


def primary_path(paths: DataFrame, allowed: tuple[str, ...] = INTERVENTION) -> DataFrame:
    """The longest path of each start that has intervention relations only, else the first."""
    ok = F.forall("relations", lambda r: r.isin(*allowed))
    w = Window.partitionBy("start_id").orderBy(F.desc(ok), F.when(ok, -F.col("hops")).otherwise(F.col("hops")), F.array_join("nodes", ">"))
    return paths.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evidence_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The hops of each path with the sources that evidence their target: start_id, hop, from_id, relation, to_id, inferred, source."""
    h = paths.select("start_id", "nodes", F.posexplode("relations").alias("i", "relation"))
    h = h.select("start_id", (F.col("i") + 1).alias("hop"), F.col("nodes")[F.col("i")].alias("from_id"), "relation", F.col("nodes")[F.col("i") + 1].alias("to_id"), (F.col("i") > 0).alias("inferred"))
    ev = edges.where("relation = 'EVIDENCED_BY'").select(F.col("source").alias("to_id"), F.col("target").alias("evidence"))
    return h.join(ev, "to_id", "left")


def evidence_chain(starts: DataFrame, paths: DataFrame, edges: DataFrame, citations: DataFrame) -> DataFrame:
    """The hops of each start's path with what cites them: start_id, hop, from_id, relation, to_id, inferred, source.

    A hop is cited by the sources of its target, the first one also by its bucket's own citation (citations: start_id, citation). A start
    without a path has one hop, to itself, if it has a citation.
    """
    h = evidence_hops(paths, edges).withColumnRenamed("evidence", "source")
    own = citations.select(F.col("start_id").alias("_at"), "citation")
    first = h.where(F.col("from_id") == F.col("start_id")).select("start_id", "hop", "from_id", "relation", "to_id", "inferred").distinct()
    first = first.join(own, F.col("start_id") == F.col("_at")).drop("_at").withColumnRenamed("citation", "source")
    alone = starts.join(paths.select("start_id"), "start_id", "left_anti").join(own, F.col("start_id") == F.col("_at"))
    alone = alone.select("start_id", F.lit(0).alias("hop"), F.col("start_id").alias("from_id"), F.lit("BUCKET").alias("relation"), F.col("start_id").alias("to_id"), F.lit(False).alias("inferred"), F.col("citation").alias("source"))
    cols = ("start_id", "hop", "from_id", "relation", "to_id", "inferred", "source")
    every = h.select(*cols).unionByName(first.select(*cols)).unionByName(alone).distinct()
    names = F.array(*map(F.lit, ("A", "A→B", "B→C", "C→D", "D→E")))
    return every.withColumn("hop", F.coalesce(F.get(names, F.col("hop")), F.concat(F.lit("hop-"), "hop")))


def indirect_links(edges: DataFrame, first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """A-C pairs joined through some B without a direct edge, with the number of such B."""
    a = edges.where(F.col("relation").isin(*first)).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    c = edges.where(F.col("relation").isin(*second)).select(F.col("source").alias("b"), F.col("target").alias("c")).distinct()
    pairs = shared_nodes(a.select("a", F.col("b").alias("node_id")), c.select("c", F.col("b").alias("node_id")), "a", "c", counted="via").where("a <> c")
    direct = edges.select(F.col("source").alias("a"), F.col("target").alias("c")).distinct()
    return pairs.join(direct, ["a", "c"], "left_anti")


def node_sets(tags: DataFrame, key: str) -> DataFrame:
    """Classes of keys that have the very same nodes: set_id, nodes (sorted) and members, the number of keys."""
    own = tags.where("node_id is not null").groupBy(key).agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    return own.withColumn("set_id", F.xxhash64("nodes"))


def shared_classes(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes of left keys (lkey, left_set), classes of right keys (rkey, right_set), pairs of classes (left_set, right_set, shared)).

    Keys with the very same nodes are one class, and a pair of classes stands for all pairs of their members. A node that half of all keys
    have is then met once for each different set of nodes, not once for each key, and no pair of keys is listed.
    """
    a, b = stored(node_sets(left, lkey)), stored(node_sets(right, rkey))
    sets = lambda df, name: df.groupBy(F.col("set_id").alias(name)).agg(F.first("nodes").alias("nodes"))
    x = sets(a, "left_set").select("left_set", F.explode("nodes").alias("node_id"))
    y = sets(b, "right_set").select("right_set", F.explode("nodes").alias("node_id"))
    pairs = x.join(y, "node_id").groupBy("left_set", "right_set").agg(F.count(F.lit(1)).alias("shared"))
    return a.select(lkey, F.col("set_id").alias("left_set")), b.select(rkey, F.col("set_id").alias("right_set")), stored(pairs)


def shared_nodes(left: DataFrame, right: DataFrame, lkey: str, rkey: str, least: int = 1, counted: str = "shared") -> DataFrame:
    """(lkey, rkey, number of shared nodes) of keys that share ``least`` or more; counted over classes, then told out to their members."""
    a, b, pairs = shared_classes(left, right, lkey, rkey)
    pairs = pairs.where(F.col("shared") >= least)
    return pairs.join(a, "left_set").join(b, "right_set").select(lkey, rkey, F.col("shared").alias(counted))


def subgraph(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], relations: tuple[str, ...]) -> DataFrame:
    """Edges of some relations whose ends both have one of the types."""
    ids = nodes.where(F.col("node_type").isin(*types)).select("node_id")
    e = edges.where(F.col("relation").isin(*relations)).select("source", "relation", "target").distinct()
    e = e.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "relation", "target")


def triplets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (subject, predicate, object) rows; a blank predicate becomes RELATED_TO."""
    nodes = rows.select(F.explode(F.array("subject", "object")).alias("node_id")).distinct()
    relation = F.upper(F.replace(F.trim("predicate"), F.lit(" "), F.lit("_")))
    edges = rows.select(F.col("subject").alias("source"), F.when(F.coalesce(F.trim("predicate"), F.lit("")) == "", "RELATED_TO").otherwise(relation).alias("relation"), F.col("object").alias("target")).distinct()
    return nodes, edges


def reading_order(passages: DataFrame) -> DataFrame:
    """NEXT_PASSAGE edges within (source, doc_id) in order of (page, paragraph_index, chunk_id)."""
    w = Window.partitionBy("source", "doc_id").orderBy("page", "paragraph_index", "chunk_id")
    p = passages.withColumn("_next", F.lead("chunk_id").over(w)).where("_next is not null")
    return p.select(F.concat(F.lit("passage_"), "chunk_id").alias("source"), F.lit("NEXT_PASSAGE").alias("relation"), F.concat(F.lit("passage_"), "_next").alias("target"))


def topic_pairs(tags: DataFrame, max_frequency: int = MAX_TOPIC_FREQUENCY, min_shared: int = MIN_SHARED, new_ids: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of passages (a, b) that share min_shared or more entities of at most max_frequency passages.

    The frequency limit is part of the rule and keeps the self join from growing with an entity's square; it counts all
    passages. With new_ids (chunk_id), only pairs that start at a new passage.
    """
    freq = tags.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_frequency).select("node_id")
    t = tags.join(freq, "node_id", "left_semi").select("chunk_id", "node_id").distinct()
    a = t.select(F.col("chunk_id").alias("a"), "node_id")
    if new_ids is not None:
        a = a.join(new_ids.select(F.col("chunk_id").alias("a")), "a", "left_semi")
    pairs = a.join(t.select(F.col("chunk_id").alias("b"), "node_id"), "node_id").where("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("entities"))
    return pairs.where(F.col("shared") >= min_shared)


def ranked_neighbours(pairs: DataFrame, most: int = MAX_NEIGHBOURS) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def topic_edges(ranked: DataFrame) -> DataFrame:
    """Undirected SHARES_TOPIC edges from ranked neighbour pairs."""
    return ranked.select(F.least("a", "b").alias("source"), F.lit("SHARES_TOPIC").alias("relation"), F.greatest("a", "b").alias("target"), F.col("shared").alias("shared_count"), "entities").distinct()


def source_pairs(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs of different sources with the number of ranked passage pairs between them, counted from both sides."""
    p = passages.select("chunk_id", F.col("source").alias("_src"))
    r = ranked.join(p.toDF("a", "sa"), "a").join(p.toDF("b", "sb"), "b").where("sa <> sb")
    return r.groupBy(F.least("sa", "sb").alias("source"), F.greatest("sa", "sb").alias("target")).agg(F.count(F.lit(1)).alias("pairs"))


def supports(passages: DataFrame, hypotheses: DataFrame, least: int = 1) -> DataFrame:
    """SUPPORTS_HYPOTHESIS pairs by shared entities: tags (chunk_id, node_id) against (hypothesis_id, node_id)."""
    return shared_nodes(passages, hypotheses, "chunk_id", "hypothesis_id", least)


def example_hypotheses(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hypothesis nodes of example chunks (chunk_id, chunk_type, summary, text, source_id), and their edges to passage and source."""
    c = chunks.where("chunk_type = 'constraint_example'").withColumn("node_id", slug(F.lit("hypothesis"), F.col("chunk_id")))
    nodes = c.select("node_id", F.lit("Hypothesis").alias("node_type"), F.coalesce(F.nullif("summary", F.lit("")), F.left("text", F.lit(72))).alias("label"), F.col("text").alias("claim"), "chunk_id")
    ends = F.array(F.struct(F.lit("HAS_PASSAGE").alias("relation"), F.concat(F.lit("passage_"), "chunk_id").alias("target")), F.struct(F.lit("EVIDENCED_BY").alias("relation"), F.col("source_id").alias("target")))
    edges = c.select(F.col("node_id").alias("source"), F.inline(ends)).where("target is not null").distinct()
    return nodes.dropDuplicates(["node_id"]), edges
