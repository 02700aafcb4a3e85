"""Reading of documents, tables, graphs and pages, and writing them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.text import body, frontmatter, is_noise, slug, strip
from loregraph.operators.losses import is_recoverable
from loregraph.sources.pages import extract_page, extract_pages  # noqa: F401
from loregraph.store import stored


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row per Markdown file below ``path``, but those whose name starts with _: path, meta and text."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    d = d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value").where(~F.col("name").startswith("_"))
    return d.select("path", frontmatter(F.col("value")).alias("meta"), body(F.col("value")).alias("text"))


def paged_book(docs: DataFrame) -> DataFrame:
    """Paragraphs of monolithic books with ``## Страница N`` marks: doc_id, page, paragraph_index (over the book), text."""
    marked = F.concat(F.lit("\n"), F.col("text"))
    pages = docs.select("doc_id", F.posexplode(F.split(marked, r"(?=\n## Страница \d+)")).alias("i", "part"))
    pages = pages.withColumn("page", F.expr("try_cast(regexp_extract(part, '## Страница ([0-9]+)', 1) as int)")).where("page is not null")
    lines = pages.select("doc_id", "page", "i", F.posexplode(F.split(F.regexp_replace("part", r"\n## Страница \d+", ""), "\n")).alias("j", "line"))
    lines = lines.withColumn("text", strip(F.col("line"))).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("i", "j")
    return lines.select("doc_id", "page", (F.row_number().over(w) - 1).alias("paragraph_index"), "text")


def page_marked_markdown(docs: DataFrame) -> DataFrame:
    """Paragraphs of extractor Markdown (doc_id, text) with ``---page-N---`` lines: doc_id, page, paragraph_index (in the page), text.

    Blank lines and page marks end a paragraph; lines that are an image are left out; leading # are dropped; noise goes.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "raw")).withColumn("line", strip(F.col("raw")))
    mark = F.expr("try_cast(nullif(regexp_extract(line, '^---page-([0-9]+)---$', 1), '') as int)")
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = mark.isNotNull() | (F.col("line") == "")
    lines = lines.withColumns({"page": F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(1)), "group": F.sum(ends.cast("int")).over(upto)})
    kept = lines.where(mark.isNull() & ~F.col("line").rlike(r"^!\[.*\]\(.*\)\s*$")).withColumn("line", strip(F.regexp_replace("raw", r"^#+\s*", ""))).where("line <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    p = kept.groupBy("doc_id", "page", "group").agg(text.alias("text")).where(~is_noise(F.col("text")))
    w = Window.partitionBy("doc_id", "page").orderBy("group")
    return p.select("doc_id", "page", (F.row_number().over(w) - 1).alias("paragraph_index"), "text")


def bucket_documents(docs: DataFrame, *more: str) -> DataFrame:
    """Loss buckets from documents (path, raw) that are frontmatter: node and chunk of each in one row; columns ``more`` stay.

    A document counts if it names a factory or is of type excel_bucket. The id is graph_node_id, else node_id, else the slug.
    """
    d = docs.select("path", frontmatter(F.col("raw")).alias("m"), strip(body(F.col("raw"))).alias("_body"), F.struct(F.lit(1), *more).alias("_more"))
    at = lambda key: F.nullif(F.col("m")[key], F.lit(""))
    d = d.where(at("factory").isNotNull() | F.coalesce(at("chunk_type") == "excel_bucket", F.lit(False)))
    slots = {c: F.coalesce(at(c), F.lit("")) for c in ("factory", "size_class", "mineral_form")}
    d = d.withColumns(slots | {"metal": F.coalesce(at("metal"), F.lit("Ni")), "tonnes": F.coalesce(F.round(at("tonnes").try_cast("double"), 2), F.lit(0.0))})
    given = F.lower(at("recoverable"))
    d = d.withColumn("recoverable", F.when(given.isNotNull(), ~given.isin("false", "0")).otherwise(is_recoverable(F.col("mineral_form"), F.col("metal"))))
    named = slug(F.lit("lossform"), F.col("factory"), F.col("size_class"), F.col("mineral_form"), F.col("metal"))
    d = d.withColumn("node_id", F.coalesce(at("graph_node_id"), at("node_id"), named))
    form = F.replace("mineral_form", F.lit("_"), F.lit(" "))
    label = F.coalesce(at("title"), F.concat_ws(" ", "factory", "size_class", form, "metal"))
    text = F.concat(F.lit("Фабрика "), "factory", F.lit(". Класс "), "size_class", F.lit(". Форма: "), "mineral_form", F.lit(". Потери "), "metal", F.lit(": "), F.col("tonnes").cast("string"), F.lit(" т. Извлекаемо: "), F.when(F.col("recoverable"), "да").otherwise("нет"), F.lit("."))
    source = F.coalesce(at("source"), F.regexp_extract("path", r"([^/]+)$", 1))
    return d.select("node_id", F.coalesce(at("chunk_id"), F.concat(F.lit("excel_"), "node_id")).alias("chunk_id"), label.alias("label"), "factory", "size_class", "mineral_form", "metal", "tonnes", "recoverable", F.coalesce(F.nullif("_body", F.lit("")), text).alias("text"), source.alias("source"), F.coalesce(at("chunk_type"), F.lit("excel_bucket")).alias("chunk_type"), *(F.col(f"_more.{c}").alias(c) for c in more))


def chunked_documents(docs: DataFrame) -> DataFrame:
    """Blocks between ``---chunk---`` lines with the document's metadata under their own: doc_id, chunk_index, meta, text."""
    d = docs.select("doc_id", frontmatter(F.col("raw")).alias("top"), F.posexplode(F.split(body(F.col("raw")), r"(?m)^---chunk---\s*$")).alias("i", "part"))
    d = d.withColumn("part", F.regexp_replace("part", r"^\s+", "")).withColumn("own", frontmatter(F.col("part")))
    meta = F.map_concat(F.map_filter("top", lambda k, v: ~F.map_contains_key(F.col("own"), k)), F.col("own"))
    return d.select("doc_id", F.coalesce(F.col("own")["chunk_index"].cast("int"), F.col("i")).alias("chunk_index"), meta.alias("meta"), strip(body(F.col("part"))).alias("text")).where("text <> ''")


def missing_transcripts(images: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Images (path) without a transcript of the same stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    return images.withColumn("stem", stem("path")).join(transcripts.select(stem("path").alias("stem")), "stem", "left_anti")


def classify_by_prefix(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule (seq, prefix, chunk_type) whose prefix starts the file's stem; a type in the metadata goes first."""
    hit = files.join(rules, F.startswith("stem", "prefix"), "left")
    first = hit.groupBy("stem").agg(F.min_by("chunk_type", "seq").alias("_type"), F.first("meta_type").alias("meta_type"))
    return first.select("stem", F.coalesce("meta_type", "_type").alias("chunk_type"))


def flatten_elements(raw: DataFrame) -> DataFrame:
    """Text elements of extractor JSON (doc_id, json) whose kids nest to any depth, in document order: doc_id, page, number (in the page),
    type, text, and the last heading before as section.

    A level is worked out from the one above it until no element has kids. JSON that isn't an array of elements gives none.
    """
    at = lambda field, kind: F.try_variant_get("e", F.lit(f"$.{field}"), kind)
    top = raw.select("doc_id", F.posexplode(F.expr("try_cast(try_parse_json(json) as array<variant>)")).alias("i", "e"))
    level, every = top.select("doc_id", F.array("i").alias("path"), "e"), None
    while True:
        kids = F.transform(at("kids", "array<variant>"), lambda k: F.to_json(k))
        level = stored(level.select("doc_id", "path", at("type", "string").alias("type"), at("content", "string").alias("content"), at("page", "int").alias("page"), kids.alias("kids")))
        own = level.where("type in ('paragraph', 'heading', 'list item') and content is not null").drop("kids")
        every = own if every is None else every.union(own)
        level = level.where("size(kids) > 0")
        if level.isEmpty():
            break
        below = level.select("doc_id", "path", F.posexplode("kids").alias("i", "_e"))
        level = below.select("doc_id", F.array_append("path", F.col("i")).alias("path"), F.parse_json("_e").alias("e"))
    w = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    e = every.withColumn("section", F.last(F.when(F.col("type") == "heading", F.col("content")), ignorenulls=True).over(w))
    n = Window.partitionBy("doc_id", "page").orderBy("path")
    return e.select("doc_id", "page", (F.row_number().over(n) - 1).alias("number"), "type", F.col("content").alias("text"), "section")


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A delimited file with all columns as strings, bad lines left out, and the delimiter: the most frequent of tab, ; and , in the first line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0]["value"] if head else ""
    sep = max("\t;,", key=line.count)
    return spark.read.option("sep", sep).option("header", True).option("mode", "DROPMALFORMED").csv(path), sep


def render_frontmatter(meta, text):
    """A document with its metadata (map) as frontmatter."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), text)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as they are, edges deduplicated and partitioned by relation."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.dropDuplicates(["source", "relation", "target"]).write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str, schemas: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas[0]).json(f"{path}/nodes"), spark.read.schema(schemas[1]).json(f"{path}/edges")
