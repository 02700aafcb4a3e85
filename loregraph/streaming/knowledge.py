"""Ingest of documents and triplets into the knowledge base: nodes, edges, chunks, passage wiring and the postings index in one commit.

A batch is worked out as tables first: what its documents say (``Facts``), then what of it is admitted next to what is there:
nodes that are new, edges whose ends both exist, chunks by their last version, and the wiring of new passages only, against
the passages that share an entity with them. Only buckets that the batch touches are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import excerpt, slug
from loregraph.operators import graph as G
from loregraph.operators.chunking import assemble_chunks, external_chunks, tag_entities
from loregraph.operators.losses import taxonomy_edges
from loregraph.sources.documents import bucket_documents, chunked_documents
from loregraph.store import stored
from loregraph.streaming.index import add_chunks
from loregraph.streaming.ledger import BUCKETS, Change

# Types of chunks that are passages, and of those that documents' entities are looked for in.
PASSAGE_TYPES = ("book_text", "pdf_text", "external_text", "constraint_regulation", "constraint_example")
LITERATURE_TYPES = ("book_text", "pdf_text", "external_text")
NODES, EDGES, CHUNKS, MENTIONS = "nodes", "edges", "chunks", "mentions"
ATTRS = "map<string, string>"
NODE = ("node_id", "node_type", "label", "attrs")
EDGE = ("source", "relation", "target", "attrs")
CHUNK = ("chunk_id", "text", "source", "source_id", "chunk_type", "factory", "external", "source_url", "doc_id", "page", "paragraph_index", "graph_node_ids", "metadata")


@dataclass
class Facts:
    """nodes (NODE), edges (EDGE) and chunks (CHUNK)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame

    def union(self, other: Facts) -> Facts:
        return Facts(*(getattr(self, t).unionByName(getattr(other, t)) for t in ("nodes", "edges", "chunks")))

    def stored(self) -> Facts:
        return Facts(stored(self.nodes), stored(self.edges), stored(self.chunks))


def _attrs(**values: Column) -> Column:
    """The values that aren't null, as a map of strings."""
    every = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def external_facts(texts: DataFrame, lexicon: DataFrame) -> Facts:
    """What external texts (title, source_url, text, explicit) say; entities that aren't there yet come as placeholders."""
    chunks, edges, nodes = external_chunks(texts, lexicon)
    source = slug(F.lit("source"), F.lit("external"), F.col("source"))
    c = chunks.select("chunk_id", "text", "source", source.alias("source_id"), "chunk_type", _null().alias("factory"), "external", "source_url", source.alias("doc_id"), F.lit(None).cast("int").alias("page"), F.col("paragraph_index").cast("int").alias("paragraph_index"), "graph_node_ids", _attrs(source_url=F.col("source_url")).alias("metadata"))
    n = nodes.select("node_id", "node_type", "label", F.when(F.col("node_type") == "Source", _attrs(source_type=F.lit("external"))).alias("attrs"))
    return Facts(n, edges.select("source", "relation", "target", _attrs(chunk_id=F.col("chunk_id")).alias("attrs")), c)


def markdown_facts(docs: DataFrame, lexicon: DataFrame) -> Facts:
    """What Markdown documents (path, raw, source_url, factory) say: a loss bucket with its taxonomy, or the chunks of a book, tagged and linked."""
    d = docs.select("path", "raw", "source_url", F.nullif("factory", F.lit("")).alias("_factory"))
    b = bucket_documents(d, "path", "source_url", "_factory")
    slots = [F.col(c) for c in ("factory", "size_class", "mineral_form", "metal", "tonnes", "recoverable")]
    bucket_nodes = b.select("node_id", F.lit("LossForm").alias("node_type"), "label", _attrs(**dict(zip(("factory", "size_class", "mineral_form", "metal", "tonnes", "recoverable"), slots, strict=True))).alias("attrs"))
    taxonomy = taxonomy_edges(b).select("source", "relation", "target", _null(ATTRS).alias("attrs"))
    of_bucket = b.select("chunk_id", "text", "source", _null().alias("source_id"), "chunk_type", F.coalesce("_factory", "factory").alias("factory"), F.lit(False).alias("external"), "source_url", "path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("paragraph_index"), F.array("node_id").alias("graph_node_ids"), _attrs(source_path=F.col("path")).alias("metadata"))
    of_bucket = of_bucket.withColumnRenamed("path", "doc_id")

    rest = d.join(b.select("path"), "path", "left_anti")
    parts = chunked_documents(rest.select(F.col("path").alias("doc_id"), "raw"))
    at = lambda key: F.nullif(F.col("meta")[key], F.lit(""))
    named = parts.withColumn("_doc", F.coalesce(at("doc_id"), F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]*)?$", 1)))
    meta = F.map_concat(F.map_filter("meta", lambda k, _: k != "chunk_index"), F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    own = assemble_chunks(named.select(F.struct(F.col("doc_id").alias("path"), F.col("_doc").alias("name")).alias("key"), F.col("_doc").alias("doc_id"), meta.alias("meta"), "text"), "key")
    own = own.select("chunk_id", "chunk_type", "text", F.col("key.path").alias("path"), F.col("key.name").alias("doc_id"), "metadata").join(rest.select("path", "source_url", "_factory"), "path")
    got = lambda key: F.nullif(F.col("metadata")[key], F.lit(""))
    source = F.coalesce(got("source"), F.regexp_extract("path", r"([^/]+)$", 1))
    own = own.select("chunk_id", "text", source.alias("source"), slug(F.lit("source"), source).alias("source_id"), "chunk_type", F.coalesce("_factory", got("factory")).alias("factory"), F.lit(False).alias("external"), "source_url", "doc_id", got("page").try_cast("int").alias("page"), got("chunk_index").try_cast("int").alias("paragraph_index"), F.map_concat(F.map_filter("metadata", lambda k, _: k != "source_path"), F.create_map(F.lit("source_path"), F.col("path"))).alias("metadata"))
    own = stored(G.latest(own.withColumn("_by", F.col("doc_id")), "chunk_id", "_by").drop("_by"))
    tags = stored(tag_entities(own.where(F.col("chunk_type").isin(*LITERATURE_TYPES)), lexicon))
    sets = tags.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("graph_node_ids"))
    books = own.join(sets, "chunk_id", "left").withColumn("graph_node_ids", F.coalesce("graph_node_ids", F.array().cast("array<string>")))
    linked = tags.join(own.select("chunk_id", "source_id", "source", "paragraph_index"), "chunk_id")
    edges = linked.groupBy(F.col("node_id").alias("source"), F.lit("EVIDENCED_BY").alias("relation"), F.col("source_id").alias("target")).agg(_attrs(chunk_id=F.min_by("chunk_id", F.struct("paragraph_index", "chunk_id"))).alias("attrs"))
    sources = linked.groupBy(F.col("source_id").alias("node_id")).agg(F.lit("Source").alias("node_type"), F.min("source").alias("label"), _null(ATTRS).alias("attrs"))
    return Facts(bucket_nodes.unionByName(sources), taxonomy.unionByName(edges), of_bucket.unionByName(books))


def admitted(facts: Facts, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new edges whose ends both exist) of facts next to what is there: nodes (node_id), edges (source, relation, target)."""
    new = facts.nodes.groupBy("node_id").agg(F.min_by(F.struct("node_type", "label", "attrs"), F.struct("node_type", "label")).alias("n")).select("node_id", "n.*")
    new = stored(new.join(nodes.select("node_id"), "node_id", "left_anti"))
    ids = stored(nodes.select("node_id").union(new.select("node_id")).distinct())
    e = facts.edges.groupBy("source", "relation", "target").agg(F.first("attrs", ignorenulls=True).alias("attrs"))
    e = e.join(edges.select("source", "relation", "target"), ["source", "relation", "target"], "left_anti")
    for end in ("source", "target"):
        e = e.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return new, e.select(*EDGE)


def wire(chunks: DataFrame, mentions: DataFrame, catalog: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passage nodes, edges, mentions (chunk_id, node_id)) of new passages.

    chunks: CHUNK, those of new passages. mentions: of the passages that are there, for the entities in question. catalog: node_id of the
    entities that exist. hypotheses: (hypothesis_id, node_id), the entities of each one's passage.
    """
    passage = lambda c: F.concat(F.lit("passage_"), c)
    p = stored(chunks.where(F.col("chunk_type").isin(*PASSAGE_TYPES)).withColumn("source_id", F.coalesce("source_id", slug(F.lit("source"), F.col("source")))))
    about = _attrs(**{c: F.col(c) for c in ("chunk_id", "chunk_type", "source", "source_id", "doc_id", "page", "paragraph_index", "factory", "external", "source_url")}, excerpt=F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(320)))
    nodes = p.select(passage("chunk_id").alias("node_id"), F.lit("Passage").alias("node_type"), excerpt(F.col("text"), 72).alias("label"), about.alias("attrs"))
    own = p.select("chunk_id", F.explode("graph_node_ids").alias("node_id")).where(G.has_prefix(F.col("node_id"), G.TOPIC_PREFIXES)).distinct()
    own = stored(own.join(catalog.select("node_id"), "node_id", "left_semi").select("chunk_id", "node_id"))
    every = stored(mentions.select("chunk_id", "node_id").union(own).distinct())

    def edge(df: DataFrame, source: Column, relation: str, target: Column, attrs: Column | None = None) -> DataFrame:
        return df.select(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"), (_null(ATTRS) if attrs is None else attrs).alias("attrs"))

    part_of = edge(p, passage("chunk_id"), "PART_OF", F.col("source_id"))
    said = edge(own, passage("chunk_id"), "MENTIONS", F.col("node_id"), _attrs(chunk_id=F.col("chunk_id")))
    order = G.reading_order(p.select("source", "doc_id", "page", "paragraph_index", "chunk_id")).withColumn("attrs", _null(ATTRS))
    topics = G.topic_edges(G.ranked_neighbours(G.topic_pairs(every, new_ids=p.select("chunk_id"))))
    topics = edge(topics, passage("source"), "SHARES_TOPIC", passage("target"), _attrs(shared_count=F.col("shared_count"), entities=F.col("entities")))
    held = edge(G.supports(own, hypotheses), passage("chunk_id"), "SUPPORTS_HYPOTHESIS", F.col("hypothesis_id"), _attrs(shared=F.col("shared")))
    return nodes, part_of.union(said).union(order).union(topics).union(held), own


def keyed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("key", F.concat_ws("\t", "source", "relation", "target"))


def _near(change: Change, table: str, keys: DataFrame, columns: tuple[str, ...], schema: str) -> DataFrame:
    """The rows of the buckets that ``keys`` (one column) fall in; none if the table isn't there."""
    touched = [r[0] for r in keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(BUCKETS)).cast("string")).distinct().collect()]  # at most BUCKETS
    rows = change.read(table, touched)
    return change.ledger.spark.createDataFrame([], schema) if rows is None else rows.select(*columns)


def merge_attrs(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key (ts, seq) with the attributes of all: of one name, the last value."""
    at = F.struct("ts", "seq")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "attrs"))), at).alias("_r")).select(key, "_r.*")
    each = rows.select(key, "ts", "seq", F.explode("attrs").alias("_k", "_v")).groupBy(key, "_k").agg(F.max_by("_v", at).alias("_v"))
    attrs = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("attrs"))
    return last.join(attrs, key, "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast(ATTRS))).select(*rows.columns)


def add_facts(change: Change, facts: Facts, at: tuple) -> dict[str, int]:
    """Stage a batch's facts with the time and number ``at`` of its last message; how many chunks, nodes and edges are added."""
    spark = change.ledger.spark
    facts = facts.stored()
    stamp = lambda df: df.withColumns({"ts": F.lit(at[0]), "seq": F.lit(at[1]).cast("long")})
    ends = facts.edges.select(F.explode(F.array("source", "target")).alias("k")).union(facts.nodes.select("node_id")).union(facts.chunks.select(F.explode("graph_node_ids"))).union(facts.chunks.select(F.concat(F.lit("passage_"), "chunk_id")))
    there = stored(_near(change, NODES, ends, ("node_id",), "node_id string"))
    known = _near(change, EDGES, keyed_edges(facts.edges).select("key"), ("source", "relation", "target"), "source string, relation string, target string")
    nodes, edges = admitted(facts, there, known)
    fresh = stored(facts.chunks.withColumn("_p", F.concat(F.lit("passage_"), "chunk_id")).join(there.withColumnRenamed("node_id", "_p"), "_p", "left_anti").drop("_p"))
    entities = fresh.select(F.explode("graph_node_ids").alias("node_id")).distinct()
    mentions = _near(change, MENTIONS, entities, ("chunk_id", "node_id"), "chunk_id string, node_id string").join(entities, "node_id", "left_semi")
    every = change.read(EDGES)
    held = spark.createDataFrame([], "hypothesis_id string, node_id string")
    if every is not None:
        first = every.where("relation = 'HAS_PASSAGE'").groupBy(F.col("source").alias("hypothesis_id")).agg(F.min("target").alias("_p"))
        said = every.where("relation = 'MENTIONS'").select(F.col("source").alias("_p"), F.col("target").alias("node_id"))
        held = first.join(said, "_p").select("hypothesis_id", "node_id")
    passages, wires, own = wire(fresh, mentions, there.union(nodes.select("node_id")), held)
    nodes, edges = stored(nodes.unionByName(passages)), stored(edges.unionByName(wires))
    change.upsert(NODES, stamp(nodes), "node_id")
    change.upsert(EDGES, stamp(keyed_edges(edges)), "key")
    change.upsert(CHUNKS, stamp(facts.chunks), "chunk_id")
    bucket = F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("string")
    touched = [r[0] for r in own.select(bucket).distinct().collect()]  # at most BUCKETS
    if touched:
        old = change.read(MENTIONS, touched)
        rows = own.select("chunk_id", "node_id")
        rows = rows if old is None else rows.union(old.select("chunk_id", "node_id")).distinct()
        change.put(MENTIONS, rows.withColumn("part", bucket).repartition("part"))
    add_chunks(change, facts.chunks)
    return {"chunks": facts.chunks.count(), "nodes": nodes.count(), "edges": edges.count()}


def add_triplets(change: Change, nodes: DataFrame, edges: DataFrame) -> None:
    """Stage nodes (NODE, ts, seq), whose attributes are merged into those that are there, and edges (EDGE, ts, seq)."""
    for table, rows, key in ((NODES, nodes, "node_id"), (EDGES, keyed_edges(edges), "key")):
        rows = stored(rows)
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("string")
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most BUCKETS
        if touched:
            old = change.read(table, touched)
            both = rows if old is None else rows.unionByName(old.select(*rows.columns))
            change.put(table, merge_attrs(both, key).withColumn("part", bucket).repartition("part"))
