"""Chunks of documents at several granularities, from atoms (doc_id, pos, page, is_heading, text), and entity tags."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.text import slug, split_blocks, split_sentences, split_windows

LEXICON_BLOCK = 200_000
# Types of nodes by the first part of their ids.
PLACEHOLDERS = {"mech": "Mechanism", "process": "Process", "equip": "Equipment", "mineral": "Mineral", "reagent": "Reagent", "metal": "Metal"}


def with_section(atoms: DataFrame) -> DataFrame:
    """Carry the last heading forward as section, and number sections."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return atoms.withColumns({"section": F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w), "section_no": F.sum(F.col("is_heading").cast("int")).over(w)})


def renumber(chunks: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    return chunks.withColumn("paragraph_index", F.row_number().over(w) - 1)


def paragraph_chunks(atoms: DataFrame) -> DataFrame:
    return renumber(with_section(atoms).where(~F.col("is_heading")), "pos").select("doc_id", "paragraph_index", "page", "section", "text")


def sentence_chunks(atoms: DataFrame) -> DataFrame:
    s = with_section(atoms).where(~F.col("is_heading")).select("doc_id", "pos", "page", "section", F.posexplode(split_sentences(F.col("text"))).alias("i", "text"))
    return renumber(s, "pos", "i").select("doc_id", "paragraph_index", "page", "section", "text")


def _joined(grouped) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return grouped.agg(text.alias("text"), F.min("pos").alias("pos"), F.min_by("page", "pos").alias("_page"), F.max_by("section", "pos").alias("_section"))


def page_chunks(atoms: DataFrame) -> DataFrame:
    p = _joined(with_section(atoms).where(~F.col("is_heading")).groupBy("doc_id", "page"))
    return renumber(p, "page").select("doc_id", "paragraph_index", "page", F.col("_section").alias("section"), "text")


def section_chunks(atoms: DataFrame) -> DataFrame:
    p = _joined(with_section(atoms).where(~F.col("is_heading")).groupBy("doc_id", "section_no"))
    return renumber(p, "section_no").select("doc_id", "paragraph_index", F.col("_page").alias("page"), F.col("_section").alias("section"), "text")


def window_chunks(atoms: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Stretches of the joined body; page and section are those of the atom in which a stretch starts."""
    body = with_section(atoms).where(~F.col("is_heading"))
    whole = _joined(body.groupBy("doc_id")).select("doc_id", F.posexplode(split_windows(F.col("text"), size, overlap)).alias("i", "text"))
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = body.select("doc_id", F.coalesce(F.sum(F.length("text") + 2).over(ahead), F.lit(0)).alias("at"), F.struct("page", "section").alias("place"))
    # Atoms and stretches in one order of characters; each stretch takes the place of the last atom that has begun.
    marks = starts.select("doc_id", "at", F.lit(0).alias("kind"), "place", F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("text"))
    marks = marks.unionByName(whole.select("doc_id", (F.col("i") * (size - overlap)).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["place"].dataType).alias("place"), "i", "text"))
    upto = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = marks.withColumn("place", F.last("place", ignorenulls=True).over(upto)).where("kind = 1")
    return out.select("doc_id", F.col("i").alias("paragraph_index"), "place.page", "place.section", "text")


GRANULARITIES = {"paragraph": paragraph_chunks, "sentence": sentence_chunks, "page": page_chunks, "section": section_chunks, "window": window_chunks}


def rechunk(atoms: DataFrame, granularity: str) -> DataFrame:
    """Chunks of one of GRANULARITIES with ids that name it."""
    return GRANULARITIES[granularity](atoms).withColumn("chunk_id", granular_id(F.lit(granularity)))


def granular_id(granularity: Column) -> Column:
    return F.concat_ws("_", F.lit("book"), "doc_id", granularity, F.concat(F.lit("i"), "paragraph_index"))


def register_chunker(spark: SparkSession, name: str = "rechunk_text") -> None:
    """A table function for SQL: SELECT ... FROM documents, LATERAL rechunk_text(text, granularity) of (i, piece).

    Its body are the SQL functions that the column functions of this library stand for, so it stays in the JVM.
    """
    blocks, lines = r"\\n\\s*\\n+", r"\\n"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING, granularity STRING) RETURNS TABLE (i INT, piece STRING) RETURN
        SELECT pos, trim(p) FROM (SELECT posexplode(filter(CASE granularity
            WHEN 'line' THEN split(t, '{lines}')
            WHEN 'window' THEN transform(sequence(0, greatest(length(t) - 1, 0), 1000), x -> substring(t, x + 1, 1200))
            WHEN 'block' THEN split(t, '{blocks}') ELSE array(t) END, x -> trim(x) <> '')) AS (pos, p))""")


def size_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Count, total, average (1 place), p50 = sorted[n // 2], p95 = sorted[int(.95 n)], least and most characters.

    Lengths are counted first, so windows run over distinct lengths and not over chunks.
    """
    c = chunks.groupBy(*by, F.length("text").alias("_len")).agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(*by)
    c = c.withColumns({"_n": F.sum("_c").over(every), "_upto": F.sum("_c").over(every.orderBy("_len"))})
    at = lambda i: F.min(F.when(F.col("_upto") > F.floor(i), F.col("_len")))
    total = F.sum(F.col("_c") * F.col("_len"))
    return c.groupBy(*by).agg(F.sum("_c").alias("n"), total.alias("total"), F.round(total / F.sum("_c"), 1).alias("average"), at(F.col("_n") / 2).alias("p50"), at(F.col("_n") * 0.95).alias("p95"), F.min("_len").alias("least"), F.max("_len").alias("most"))


def tag_entities(chunks: DataFrame, lexicon: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Distinct (chunk_id, node_id) whose keyword is a substring of the lower-cased text; keywords of any length but empty ones.

    Each text is gone through once by an automaton of all keywords. The lexicon (node_id, keyword) is sent to all tasks in
    blocks of about LEXICON_BLOCK keywords; of more, each block goes through the texts in turn.
    """
    words = lexicon.select("node_id", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    kind, node = chunks.schema[id_col].dataType.simpleString(), words.schema["node_id"].dataType.simpleString()
    low = chunks.select(id_col, F.lower("text").alias("_t"))
    blocks = 1 + words.count() // LEXICON_BLOCK
    out = None
    for b in range(blocks):
        own = words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b).toPandas()
        shared = chunks.sparkSession.sparkContext.broadcast((own["keyword"].tolist(), own["node_id"].tolist()))
        part = low.mapInArrow(_tagger(shared, id_col), f"{id_col} {kind}, node_id {node}")
        out = part if out is None else out.union(part)
    return out.distinct() if blocks > 1 else out


def _tagger(shared, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, nodes = ahocorasick.Automaton(), {}
        for keyword, node in zip(*shared.value, strict=True):
            nodes.setdefault(keyword, []).append(node)
        for keyword, own in nodes.items():
            automaton.add_word(keyword, own)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch["_t"].to_pylist()):
                if text and nodes:
                    own = {n for _, group in automaton.iter(text) for n in group}
                    at += [i] * len(own)
                    found += sorted(own)
            kind = pa.array(shared.value[1][:1]).type if shared.value[1] else pa.string()
            yield pa.RecordBatch.from_arrays([batch[id_col].take(pa.array(at, pa.int64())), pa.array(found, kind)], [id_col, "node_id"])

    return run


def default_chunk_id(doc_id: Column, granularity: Column, index: Column) -> Column:
    """book_<document>[_<granularity, if not paragraph>]_i<number>."""
    return F.concat_ws("_", F.lit("book"), doc_id, F.when(granularity != "paragraph", granularity), F.concat(F.lit("i"), index))


def assemble_chunks(docs: DataFrame, *more: str) -> DataFrame:
    """Documents (doc_id, meta, text) as typed chunks: type and id of the metadata (map), else book_text and the default id;
    metadata without nulls and without what has a column of its own; columns ``more`` stay."""
    at = lambda key: F.nullif(F.col("meta")[key], F.lit(""))
    granularity, index = F.coalesce(at("granularity"), F.lit("paragraph")), F.coalesce(at("chunk_index"), F.lit("0"))
    chunk_id = F.coalesce(at("chunk_id"), default_chunk_id(F.col("doc_id"), granularity, index))
    rest = F.map_filter("meta", lambda k, v: v.isNotNull() & ~k.isin("chunk_id", "chunk_type"))
    return docs.select(chunk_id.alias("chunk_id"), F.coalesce(at("chunk_type"), F.lit("book_text")).alias("chunk_type"), "text", rest.alias("metadata"), *more)


def external_chunks(texts: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """External texts (title, source_url, text, explicit) -> (chunks, evidence edges, nodes).

    Texts are cut into blocks, tagged with the lexicon's entities and the ``explicit`` ids, and linked with the entity by
    one EVIDENCED_BY edge for each (entity, source), which names the first chunk. Nodes: the sources, and a placeholder with a
    type from the id's prefix for each entity. Of titles that give the same chunk id, the first in order keeps it.
    """
    t = texts.withColumns({"source_id": slug(F.lit("source"), F.lit("external"), F.col("title")), "_slug": slug(F.left("title", F.lit(48)))})
    c = t.select("title", "source_url", "source_id", "_slug", "explicit", F.posexplode(split_blocks(F.col("text"))).alias("paragraph_index", "text"))
    c = c.withColumn("chunk_id", F.concat(F.lit("external_"), "_slug", F.lit("_paragraph_i"), "paragraph_index"))
    first = F.min_by(F.struct("title", "source_url", "source_id", "explicit", "paragraph_index", "text"), F.struct("title", "source_url", "text"))
    c = c.groupBy("chunk_id").agg(first.alias("_c")).select("chunk_id", "_c.*")
    tags = tag_entities(c, lexicon).union(c.select("chunk_id", F.explode("explicit"))).where("node_id <> ''").distinct()
    tagged = tags.groupBy("chunk_id").agg(F.collect_set("node_id").alias("_nodes"))
    none = F.array().cast("array<string>")
    c = c.join(tagged, "chunk_id", "left").withColumn("graph_node_ids", F.array_sort(F.array_union(F.coalesce("_nodes", none), F.array("source_id"))))
    chunks = c.select("chunk_id", "text", F.col("title").alias("source"), F.lit("external_text").alias("chunk_type"), "graph_node_ids", F.lit(True).alias("external"), "source_url", "paragraph_index")
    edges = tags.join(c.select("chunk_id", "source_id", "paragraph_index"), "chunk_id").groupBy(F.col("node_id").alias("source"), F.lit("EVIDENCED_BY").alias("relation"), F.col("source_id").alias("target"))
    edges = edges.agg(F.min_by("chunk_id", F.struct("paragraph_index", "chunk_id")).alias("chunk_id"))
    kind = F.create_map(*[F.lit(x) for p in PLACEHOLDERS.items() for x in p])
    nodes = tags.select("node_id").distinct().select("node_id", F.coalesce(kind[F.substring_index("node_id", "_", 1)], F.lit("Mechanism")).alias("node_type"), F.col("node_id").alias("label"))
    return chunks, edges, nodes.union(t.select("source_id", F.lit("Source"), "title").distinct())


def image_chunks(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Image references (doc_id, ref, alt, summary) -> chunk_id, text, caption, image_path, image_missing, original_format.

    A reference is found by its file name among the listed files (path); of several, the first path counts.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    listed = files.groupBy(name(F.col("path")).alias("_name")).agg(F.min("path").alias("image_path"))
    r = refs.withColumns({"_name": name(F.col("ref")), "alt": F.coalesce(F.nullif(F.trim("alt"), F.lit("")), name(F.col("ref")))})
    r = r.join(listed, "_name", "left").withColumn("image_missing", F.col("image_path").isNull())
    caption = F.when(F.col("image_missing"), F.col("alt")).otherwise(F.coalesce(F.nullif("summary", F.lit("")), F.col("alt")))
    text = F.when(F.col("image_missing"), F.concat(caption, F.lit("\n\n[image not found: "), "ref", F.lit("]"))).otherwise(F.concat(caption, F.lit("\n\nИллюстрация: "), "_name"))
    stem = F.regexp_replace("_name", r"\.[^.]+$", "")
    suffix = F.lower(F.regexp_extract("_name", r"\.([^.]+)$", 1))
    chunk_id = F.concat_ws("_", F.lit("image"), slug(F.col("doc_id").cast("string")), slug(stem))
    return r.select(chunk_id.alias("chunk_id"), text.alias("text"), caption.alias("caption"), F.coalesce("image_path", "ref").alias("image_path"), "image_missing", F.coalesce(F.nullif(suffix, F.lit("")), F.lit("image")).alias("original_format"))


