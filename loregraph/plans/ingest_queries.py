"""Queries on documents and files as they come in, sources of evidence, and the routes of the message stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from loregraph.functions import files as FI
from loregraph.functions import text as X
from loregraph.operators import chunking as CH
from loregraph.operators import graph as G
from loregraph.operators import losses as L
from loregraph.operators import requests as Q
from loregraph.operators import retrieval as R
from loregraph.operators.chunk_table import register_rechunker
from loregraph.plans import text_queries as TQ
from loregraph.plans import views as V
from loregraph.plans.text_queries import STRIP
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


def bucket_files(spark, d):
    """Loss buckets as frontmatter documents: with a node id, another one, none, or without a factory (no bucket)."""
    k = F.floor("tonnes") % 4
    head = F.concat(F.lit("---\nsize_class: "), "size_class", F.lit("\nmineral_form: "), "mineral_form", F.lit("\nmetal: "), "metal", F.lit("\ntonnes: "), F.col("tonnes").cast("string"))
    ids = F.when(k == 0, F.concat(F.lit('\ngraph_node_id: "g_'), "node_id", F.lit('"'))).when(k == 1, F.concat(F.lit("\nnode_id: n_"), "node_id")).otherwise("")
    factory = F.when(k != 3, F.concat(F.lit("\nfactory: "), "factory")).otherwise("")
    return V.loss_forms(spark, d).select(F.concat(F.lit("md/"), "node_id", F.lit(".md")).alias("path"), F.concat(head, ids, factory, F.lit("\n---\n")).alias("raw"))


BUCKETS_SQL = "SELECT *, CASE CAST(floor(tonnes) AS BIGINT)%4 WHEN 0 THEN 'g_' WHEN 1 THEN 'n_' ELSE '' END||node_id AS own FROM loss WHERE CAST(floor(tonnes) AS BIGINT)%4<>3"


@query("sc5_bucket_documents", sql("loss", "SELECT own AS node_id, 'excel_'||own AS chunk_id, factory||' '||size_class||' '||replace(mineral_form,'_',' ')||' '||metal AS label, tonnes, recoverable, node_id||'.md' AS source FROM files", files=BUCKETS_SQL))
def sc5(spark, d):
    return S.bucket_documents(bucket_files(spark, d)).select("node_id", "chunk_id", "label", "tonnes", "recoverable", "source")


@query("sc5_bucket_edges", sql("loss rules", f"SELECT DISTINCT coalesce(r_source,own) AS source, relation, target FROM (SELECT *, {V.SIZE_KIND_SQL} AS kind FROM files WHERE recoverable) JOIN rules ON mineral_form=r_form AND (r_size IS NULL OR r_size=kind) AND (r_metal IS NULL OR r_metal=metal)", files=BUCKETS_SQL))
def sc5_edges(spark, d):
    return L.rule_edges(S.bucket_documents(bucket_files(spark, d)), V.rules(spark))


MARKED = f"""SELECT doc_id, (k-1)//4+1 AS page, k, CASE WHEN k%4=2 THEN k ELSE k-k%3 END AS g, {STRIP.format('l')} AS t FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1) AS k FROM documents)"""


@query("sc10_page_marked", sql("", """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k)-1 AS paragraph_index, text FROM (
 SELECT doc_id, page, min(k) AS k, string_agg(t, chr(10) ORDER BY k) AS text FROM (SELECT *, sum(CASE WHEN k%3=0 OR t='' OR (k-1)%4=0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM (SELECT *, regexp_replace(t, '^#+\\s*', '') AS u FROM lines)) WHERE t<>'' AND k%5<>0 GROUP BY doc_id, page, grp)
 WHERE length(text)>=8 AND NOT starts_with(text,'![') AND regexp_matches(text,'[\\p{L}_]')""", lines=MARKED))
def sc10(spark, d):
    """Every fourth line begins a page, every third is set apart by a blank line, every fifth is an image, every second a heading."""
    line = lambda p, i: F.concat(
        F.when(i % 4 == 0, F.concat(F.lit("---page-"), F.floor(i / 4) + 1, F.lit("---\n"))).otherwise(""),
        F.when((i + 1) % 3 == 0, "\n").otherwise(""),
        F.when((i + 1) % 5 == 0, F.lit("![x](img.png)")).when(i % 2 == 1, F.concat(F.lit("## "), p)).otherwise(p),
    )
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return S.page_marked_markdown(V.table(spark, d, "documents").select("doc_id", text.alias("text")))


@query("x13_image_chunks", "SELECT 'image_'||doc_id||'_pic_'||doc_id AS chunk_id, CASE WHEN doc_id%3=0 THEN CASE WHEN doc_id%2=0 THEN 'drawn '||lang ELSE alt END||chr(10)||chr(10)||'Иллюстрация: pic_'||doc_id||'.PNG' ELSE alt||chr(10)||chr(10)||'[image not found: img/pic_'||doc_id||'.PNG]' END AS text, CASE WHEN doc_id%3=0 THEN '/data/a/pic_' ELSE 'img/pic_' END||doc_id||'.PNG' AS image_path, doc_id%3<>0 AS image_missing, 'png' AS original_format FROM (SELECT *, CASE WHEN doc_id%5=0 THEN 'pic_'||doc_id||'.PNG' ELSE source END AS alt FROM documents WHERE source IS NOT NULL)")
def x13(spark, d):
    docs = V.table(spark, d, "documents").where("source is not null")
    name = F.concat(F.lit("pic_"), "doc_id", F.lit(".PNG"))
    refs = docs.select("doc_id", F.concat(F.lit("img/"), name).alias("ref"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source")).alias("alt"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("drawn "), "lang")).otherwise("").alias("summary"))
    there = docs.where("doc_id % 3 = 0")
    listed = there.select(F.explode(F.array(F.concat(F.lit("/data/b/"), name), F.concat(F.lit("/data/a/"), name))).alias("path"))
    return CH.image_chunks(refs, listed).select("chunk_id", "text", "image_path", "image_missing", "original_format")


def external_texts(spark, d):
    none = F.array().cast("array<string>")
    docs = V.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("Text "), "doc_id").alias("title"), F.concat(F.lit("https://x.org/"), "doc_id").alias("source_url"), "text", F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("mineral_z"), F.lit(""))).otherwise(none).alias("explicit"))


EXT = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k)-1 AS i, t FROM (SELECT doc_id, k, {STRIP.format('l')} AS t FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1) AS k FROM documents)) WHERE t<>''"
EXT_TAGS = "SELECT DISTINCT doc_id, i, node_id FROM ext JOIN lexicon ON contains(lower(t), keyword) UNION SELECT doc_id, i, 'mineral_z' FROM ext WHERE doc_id%10=0"


@query("ch7_external_chunks", sql("lexicon", "SELECT 'external_text_'||ext.doc_id||'_paragraph_i'||i AS chunk_id, array_to_string(list_sort(list_concat(coalesce(n,[]), ['source_external_text_'||ext.doc_id])), ',') AS nodes FROM ext LEFT JOIN (SELECT doc_id, i, list(node_id) AS n FROM et GROUP BY 1,2) USING (doc_id, i)", ext=EXT, et=EXT_TAGS))
def ch7(spark, d):
    return CH.external_chunks(external_texts(spark, d), V.lexicon(spark))[0].select("chunk_id", F.array_join("graph_node_ids", ",").alias("nodes"))


@query("ch7_external_edges", sql("lexicon", "SELECT node_id AS source, 'source_external_text_'||doc_id AS target, 'external_text_'||doc_id||'_paragraph_i'||min(i) AS chunk_id FROM et GROUP BY node_id, doc_id", ext=EXT, et=EXT_TAGS))
def ch7_edges(spark, d):
    return CH.external_chunks(external_texts(spark, d), V.lexicon(spark))[1].select("source", "target", "chunk_id")


@query("ch7_external_nodes", sql("lexicon", "SELECT node_id, CASE split_part(node_id,'_',1) WHEN 'process' THEN 'Process' WHEN 'equip' THEN 'Equipment' WHEN 'mineral' THEN 'Mineral' WHEN 'reagent' THEN 'Reagent' WHEN 'metal' THEN 'Metal' ELSE 'Mechanism' END AS node_type, node_id AS label FROM (SELECT DISTINCT node_id FROM et) UNION ALL SELECT 'source_external_text_'||doc_id, 'Source', 'Text '||doc_id FROM documents", ext=EXT, et=EXT_TAGS))
def ch7_nodes(spark, d):
    return CH.external_chunks(external_texts(spark, d), V.lexicon(spark))[2]


@query("ch6_typed_chunks", "SELECT coalesce(CASE WHEN doc_id%4=0 THEN 'own_'||doc_id END, 'book_'||doc_id||CASE WHEN doc_id%3=0 THEN '_page' ELSE '' END||'_i'||(doc_id%7)) AS chunk_id, CASE WHEN doc_id%5=0 THEN 'scheme_caption' ELSE 'book_text' END AS chunk_type, 3+(doc_id%2) + CASE WHEN source IS NULL THEN -1 ELSE 0 END AS n_meta, length(text) AS chars FROM documents WHERE text<>''")
def ch6(spark, d):
    row = F.col("doc_id")
    meta = F.create_map(*[x for k, v in {"chunk_id": F.when(row % 4 == 0, F.concat(F.lit("own_"), row)), "chunk_type": F.when(row % 5 == 0, "scheme_caption"), "granularity": F.when(row % 3 == 0, "page").otherwise("paragraph"), "chunk_index": (row % 7).cast("string"), "source": F.col("source"), "section": F.when(row % 2 == 1, "s")}.items() for x in (F.lit(k), v)])
    return CH.assemble_chunks(V.table(spark, d, "documents").where("text <> ''").select("doc_id", meta.alias("meta"), "text")).select("chunk_id", "chunk_type", F.size("metadata").alias("n_meta"), F.length("text").alias("chars"))


def page_files(spark, d):
    ends = F.array(*map(F.lit, (".py", ".HTML", ".csv", ".zzz", ".bin", "", ".docx", ".yml")))
    k = (F.col("page_id") % 8 + 1).cast("int")
    content = F.when(F.col("page_id") % 16 == 5, F.concat("html", F.lit("\x00"))).when(F.col("page_id") % 16 == 13, "").otherwise(F.col("html"))
    return V.table(spark, d, "pages").select("page_id", F.concat(F.lit("dir.d/f"), "page_id", F.element_at(ends, k)).alias("name"), content.alias("content"))


ASCII = "length(regexp_replace(left(html,1024),'[^ -~\\t\\n\\r]','','g'))>0.9*length(left(html,1024))"
KIND_SQL = f"CASE page_id%8 WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'csv' WHEN 3 THEN CASE WHEN {ASCII} THEN 'text' ELSE 'binary' END WHEN 4 THEN 'binary' WHEN 5 THEN CASE WHEN page_id%16=13 OR (({ASCII}) AND length(html)>=1024) THEN 'text' ELSE 'binary' END WHEN 6 THEN 'docx' ELSE 'code' END"


@query("x22_file_types", f"SELECT page_id, {KIND_SQL} AS kind FROM pages")
def x22(spark, d):
    return page_files(spark, d).select("page_id", FI.file_type(F.col("name"), F.col("content")).alias("kind"))


@query("u3_converted_files", f"SELECT page_id, kind, kind NOT IN ('binary','docx') AND page_id%16<>5 AS success, CASE WHEN kind IN ('binary','docx') THEN 'No converter for file type: '||kind WHEN page_id%16=5 THEN 'File is not valid UTF-8 text' END AS error, CASE WHEN kind NOT IN ('binary','docx') AND page_id%16<>5 THEN md5('```'||CASE page_id%8 WHEN 0 THEN 'python' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' WHEN 7 THEN 'yaml' ELSE 'text' END||chr(10)||CASE WHEN page_id%16=13 THEN '' ELSE html END||chr(10)||'```'||chr(10)) END AS digest FROM (SELECT *, {KIND_SQL} AS kind FROM pages)")
def u3(spark, d):
    f = page_files(spark, d)
    c = FI.convert_files(f).select("name", "kind", "success", F.try_element_at("errors", F.lit(1)).alias("error"), F.md5("markdown").alias("digest"))
    return f.select("page_id", "name").join(c, "name").drop("name")


@query("x23_fenced_markdown", "SELECT event_id, '```json'||chr(10)||CASE event_id%4 WHEN 0 THEN 'bad {'||props WHEN 1 THEN '{'||chr(10)||'  \"z\": ['||chr(10)||'    '||regexp_replace(props, '^\\{\"k\": (\\d+)\\}$', '{'||chr(10)||'      \"k\": \\1'||chr(10)||'    }')||','||chr(10)||'    \"é\"'||chr(10)||'  ],'||chr(10)||'  \"a\": null'||chr(10)||'}' ELSE regexp_replace(props, '^\\{\"k\": (\\d+)\\}$', '{'||chr(10)||'  \"k\": \\1'||chr(10)||'}') END||chr(10)||'```'||chr(10) AS markdown FROM events")
def x23(spark, d):
    """Broken JSON, nested JSON and a flat object."""
    k = F.col("event_id") % 4
    nested = F.concat(F.lit('{"z": ['), "props", F.lit(', "é"], "a":null}'))
    content = F.when(k == 0, F.concat(F.lit("bad {"), "props")).when(k == 1, nested).otherwise(F.col("props"))
    return V.table(spark, d, "events").select("event_id", FI.CONVERTERS["code"](F.lit("a.json"), content).alias("markdown"))


CLEAN_CASES = ("Sure.\n```\n{0}\n```\nBye", "flowchart TD\n{0}\n\n Let me explain", "The table:\n| a | b |\n|---|---|\n| {0} | x |\ndone", "  {0} ")


@query("x26_clean_output", "SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN t WHEN 1 THEN 'flowchart TD'||chr(10)||t WHEN 2 THEN '| a | b |'||chr(10)||'|---|---|'||chr(10)||'| '||t||' | x |' ELSE t END AS kept FROM (SELECT conv_id, turn, " + STRIP.format("regexp_replace(text,'[^a-z]+',' ','g')") + " AS t FROM conversations) WHERE t<>'' AND NOT regexp_matches(t, '(?i)graph |pie|flowchart |gantt')")
def x26(spark, d):
    t = X.strip(F.regexp_replace("text", "[^a-z]+", " "))
    c = V.table(spark, d, "conversations").withColumn("t", t).where("t <> ''").where(~F.col("t").rlike("(?i)graph |pie|flowchart |gantt"))
    parts = [case.split("{0}") for case in CLEAN_CASES]
    said = F.element_at(F.array(*[F.concat(F.lit(a), "t", F.lit(b)) for a, b in parts]), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", FI.clean_output(said).alias("kept"))


@query("x25_model_json", "SELECT event_id, CASE event_id%4 WHEN 1 THEN '['||props||','||props||']' WHEN 3 THEN 'no json' ELSE props END AS found FROM events")
def x25(spark, d):
    said = F.element_at(F.array(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")), F.concat(F.lit("List: ["), "props", F.lit(","), "props", F.lit("] and so on")), F.col("props"), F.lit("  no json\n")), (F.col("event_id") % 4 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", X.json_from_output(said).alias("found"))


@query("x24_table_markdown", "SELECT n_nationkey, count(*) AS n, md5('| supplier | balance | whole |'||chr(10)||'|---|---|---|'||chr(10)||string_agg('| '||s_suppkey||' | '||regexp_replace(CAST(CAST(s_acctbal AS DOUBLE) AS VARCHAR), '\\.0$', '')||' | '||CASE WHEN s_suppkey%3=0 THEN '' ELSE CAST(round(s_acctbal)::BIGINT AS VARCHAR) END||' |', chr(10) ORDER BY s_suppkey)) AS digest FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY 1")
def x24(spark, d):
    """Ragged rows: each third supplier lacks its last cell."""
    s = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")
    value = lambda c: FI.markdown_cell(F.col(c).cast("double"))
    body = s.withColumn("_whole", F.round("s_acctbal")).select("n_nationkey", F.col("s_suppkey").alias("row"), F.posexplode(F.array(value("s_suppkey"), value("s_acctbal"), value("_whole"))).alias("col", "value"), "s_suppkey").where("not (col = 2 and s_suppkey % 3 = 0)").drop("s_suppkey")
    head = s.select("n_nationkey").distinct().select("n_nationkey", F.lit(-1).cast("long").alias("row"), F.posexplode(F.array(F.lit("supplier"), F.lit("balance"), F.lit("whole"))).alias("col", "value"))
    tables = FI.markdown_tables(body.withColumn("row", F.col("row").cast("long")).unionByName(head), ["n_nationkey"])
    return tables.join(s.groupBy("n_nationkey").agg(n_rows()), "n_nationkey").select("n_nationkey", "n", F.md5("markdown").alias("digest"))


def cited(spark, d):
    """Paragraphs with a citation: English ones with metadata, others with page and part in their id, each fifth from a sheet."""
    p = V.paragraphs(spark, d)
    i, en = F.col("paragraph_index"), F.col("lang") == "en"
    sheet = (F.col("doc_id") % 5 == 0) & en
    pairs = {"page": F.when(en, F.floor(i / 5) + 1), "paragraph_index": F.when(en, i), "metal": F.when(sheet, F.when(i % 2 == 0, "Ni").otherwise("Cu")), "excel_cell_ni": F.when(sheet, "E7"), "excel_cell_cu": F.when(sheet, "G7"), "excel_cell": F.lit(None), "sheet": F.when(sheet, "A")}
    meta = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    chunk_id = F.when(en, F.col("chunk_id")).otherwise(F.concat(F.lit("pdf_"), "doc_id", F.lit("_p"), F.floor(i / 5) + 1, F.lit("_"), i))
    kind = F.when(sheet, "excel_bucket").when(~en, "pdf_text").otherwise("external_text")
    url = F.when(en & ~sheet, F.concat(F.lit("https://x.org/"), "doc_id"))
    p = p.select(chunk_id.alias("chunk_id"), "source", kind.alias("chunk_type"), "text", meta.alias("meta"), url.alias("source_url"))
    return p.withColumn("c", X.citation(F.col("chunk_id"), F.col("source"), F.col("chunk_type"), F.col("text"), F.col("meta"), F.col("source_url")))


CITED = f"""SELECT CASE WHEN lang='en' THEN chunk_id ELSE 'pdf_'||doc_id||'_p'||(paragraph_index//5+1)||'_'||paragraph_index END AS chunk_id, source,
 CASE WHEN lang='en' AND doc_id%5=0 THEN 'excel' WHEN lang='en' THEN 'external' ELSE 'pdf' END AS source_type, CAST(paragraph_index//5+1 AS INT) AS page, CAST(paragraph_index AS INT) AS paragraph_index,
 CASE WHEN lang='en' AND doc_id%5=0 THEN CASE WHEN paragraph_index%2=0 THEN 'E7' ELSE 'G7' END END AS cell, CASE WHEN lang='en' AND doc_id%5<>0 THEN 'https://x.org/'||doc_id END AS url,
 CASE WHEN lang='en' AND doc_id%5=0 THEN 'A' END AS sheet, CASE WHEN length(t)>320 THEN left(t,319)||'…' ELSE t END AS excerpt FROM (SELECT *, {STRIP.format('text')} AS t FROM paragraphs)"""
REF = "concat_ws(', ', coalesce(source, chunk_id), 'стр. '||page, '§'||(paragraph_index+1), 'ячейка '||cell, url, 'лист «'||sheet||'»')"


@query("x17_citation", sql("paragraphs", f"SELECT chunk_id, source_type, page, paragraph_index, cell AS excel_cell, excerpt, {REF} AS display_ref FROM cited", cited=CITED))
def x17(spark, d):
    return cited(spark, d).select("chunk_id", "c.source_type", "c.page", "c.paragraph_index", "c.excel_cell", "c.excerpt", "c.display_ref")


@query("x29_source_mapping", sql("paragraphs", f"SELECT chunk_id, {REF} AS title, source_type AS type, md5(excerpt) AS digest, '/api/v1/sources/chunks/'||chunk_id AS url FROM cited UNION ALL SELECT '', 'Источник', 'db', md5(''), url FROM pages", cited=CITED))
def x29(spark, d):
    c = cited(spark, d).select("chunk_id", F.col("c.display_ref").alias("title"), F.col("c.source_type").alias("type"), F.col("c.excerpt").alias("excerpt"), F.lit("").alias("relevance"), "source_url")
    p = V.table(spark, d, "pages").select(F.lit("").alias("chunk_id"), F.lit("").alias("title"), F.lit(None).cast("string").alias("type"), F.lit("").alias("excerpt"), F.lit(None).cast("string").alias("relevance"), F.col("url").alias("source_url"))
    return Q.source_details(c.unionByName(p)).select("chunk_id", "title", "type", F.md5("excerpt").alias("digest"), "url")


def said_sources(spark, d):
    c = V.table(spark, d, "conversations").where("role = 'assistant'")
    chunk = F.when(F.col("turn") % 5 != 0, F.concat(F.lit("book_"), F.col("conv_id") % 300, F.lit("_paragraph_i0")))
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), chunk.alias("chunk_id"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.left("text", F.lit(30))).alias("title"), F.lit("").alias("type"), F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise("").alias("relevance"))


SAID = "SELECT conv_id AS request_id, turn AS seq, CASE WHEN turn%5<>0 THEN 'book_'||(conv_id%300)||'_paragraph_i0' END AS chunk_id, CASE WHEN turn%2=0 THEN '' ELSE left(text,30) END AS title, CASE WHEN turn%3=0 THEN text ELSE '' END AS relevance FROM conversations WHERE role='assistant'"


@query("j10_enriched_sources", sql("paragraphs", "SELECT request_id, seq, CASE WHEN k.chunk_id IS NOT NULL THEN source ELSE coalesce(nullif(title,''),'Источник') END AS title, CASE WHEN k.chunk_id IS NOT NULL THEN 'book' ELSE 'reference' END AS type, md5(CASE WHEN k.chunk_id IS NOT NULL THEN k.text ELSE relevance END) AS excerpt, coalesce(nullif(relevance,''), k.lang, '') AS relevance FROM said LEFT JOIN paragraphs k ON said.chunk_id=k.chunk_id", said=SAID))
def j10(spark, d):
    known = V.paragraphs(spark, d).select("chunk_id", F.col("source").alias("title"), F.lit("book").alias("type"), F.col("text").alias("excerpt"), F.col("lang").alias("relevance"))
    return Q.enrich_sources(said_sources(spark, d), known).select("request_id", "seq", "title", "type", F.md5("excerpt").alias("excerpt"), "relevance")


@query("a23_retrieved_paragraphs", "SELECT request_id, seq, chunk_id, title FROM (SELECT conv_id AS request_id, CASE role WHEN 'user' THEN turn ELSE 1000+turn END AS seq, CASE WHEN turn%3=0 THEN '' ELSE 'c'||(length(text)%7) END AS chunk_id, coalesce(text,'') AS title FROM conversations) QUALIFY row_number() OVER (PARTITION BY request_id, coalesce(nullif(chunk_id,''), title) ORDER BY seq)=1")
def a23(spark, d):
    """A request's own sources first, then those of its hypotheses."""
    c = V.table(spark, d, "conversations")
    row = lambda df, seq: df.select(F.col("conv_id").alias("request_id"), seq.alias("seq"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.length("text") % 7)).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("title"))
    return Q.merge_sources(row(c.where("role = 'user'"), F.col("turn").cast("long")).union(row(c.where("role is distinct from 'user'"), F.col("turn").cast("long") + 1000)))


@query("x28_confidence", "SELECT l_orderkey, l_linenumber, round(c,4) AS confidence, CASE WHEN c>=0.85 THEN 'high' WHEN c>=0.7 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN lower(p) IN ('high','medium','low') THEN lower(p) ELSE 'medium' END AS novelty FROM (SELECT l_orderkey, l_linenumber, o_orderpriority[3:] AS p, CASE WHEN l_quantity%10=0 THEN 0.7 ELSE least(1.0, (l_quantity%10)/5.0) END::DOUBLE AS c FROM lineitem JOIN orders ON l_orderkey=o_orderkey)")
def x28(spark, d):
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = X.confidence((F.col("l_quantity") % 10).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", F.round(c, 4).alias("confidence"), X.impact_band(c).alias("impact"), X.novelty(F.expr("substring(o_orderpriority, 3)")).alias("novelty"))


def triplet_messages(spark, d):
    e = V.table(spark, d, "events")
    user = F.concat(F.lit("user_"), "user_id")
    node = lambda i, kind: F.struct(i.alias("node_id"), kind.alias("node_type"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("label"))
    subject, target = node(user, F.lit("User")), node(F.concat(F.lit("k_"), F.col("event_id") % 11), F.when(F.col("event_id") % 3 == 0, "Key"))
    payload = F.to_json(F.struct(subject.alias("subject"), F.when(F.col("event_id") % 4 != 0, F.upper("event_type")).alias("predicate"), target.alias("object")))
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.to_json(F.struct(F.when(F.col("event_type") == "view", "other").otherwise("graph.triplet").alias("type"), payload.alias("payload"))).alias("value"))


@query("st4_triplet_edges", "SELECT DISTINCT 'user_'||user_id AS source, CASE WHEN event_id%4<>0 THEN upper(event_type) ELSE 'RELATED_TO' END AS relation, 'k_'||(event_id%11) AS target FROM events WHERE event_type<>'view'")
def st4(spark, d):
    return I.triplet_rows(I.envelopes(triplet_messages(spark, d)))[1].select("source", "relation", "target")


@query("st4_triplet_nodes", "SELECT node_id, node_type, label FROM (SELECT 'user_'||user_id AS node_id, 'User' AS node_type, CASE WHEN event_id%2=0 THEN event_type ELSE 'user_'||user_id END AS label, ts, event_id FROM events WHERE event_type<>'view' UNION ALL SELECT 'k_'||(event_id%11), CASE WHEN event_id%3=0 THEN 'Key' ELSE 'Entity' END, CASE WHEN event_id%2=0 THEN event_type ELSE 'k_'||(event_id%11) END, ts, event_id FROM events WHERE event_type<>'view') QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC)=1")
def st4_nodes(spark, d):
    return I.triplet_rows(I.envelopes(triplet_messages(spark, d)))[0].select("node_id", "node_type", "label")


def text_messages(spark, d):
    c = V.table(spark, d, "conversations")
    payload = F.to_json(F.struct(F.concat(F.lit("Conv "), "conv_id").alias("title"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("markdown")))
    kind = F.when(F.col("turn") % 2 == 0, "external.ingest").otherwise("ingest.markdown")
    return c.select(F.col("conv_id").alias("key"), F.timestamp_seconds(F.col("turn")).alias("ts"), F.col("turn").alias("seq"), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("value"))


LAST = f"SELECT conv_id, text FROM conversations WHERE trim(coalesce(text,''))<>'' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)=1"
ST5 = f"SELECT conv_id, k, t FROM (SELECT conv_id, k, {STRIP.format('l')} AS t FROM (SELECT conv_id, unnest(string_split(text,chr(10))) AS l, generate_subscripts(string_split(text,chr(10)),1) AS k FROM last_text)) WHERE t<>''"


@query("st5_ingested_texts", sql("lexicon", "SELECT 'source_external_conv_'||conv_id AS source_id, count(DISTINCT k) AS chunks, count(DISTINCT node_id) AS edges FROM parts LEFT JOIN lexicon ON contains(lower(t), keyword) GROUP BY 1", last_text=LAST, parts=ST5))
def st5(spark, d):
    chunks, edges, _ = CH.external_chunks(I.ingested_texts(I.envelopes(text_messages(spark, d))), V.lexicon(spark))
    source = F.array_max(F.filter("graph_node_ids", lambda x: x.startswith("source_external_")))
    n = chunks.groupBy(source.alias("source_id")).agg(F.count(F.lit(1)).alias("chunks"))
    e = edges.groupBy(F.col("target").alias("source_id")).agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "source_id", "left").select("source_id", "chunks", F.coalesce("edges", F.lit(0)).alias("edges"))


def query_messages(spark, d):
    b = V.table(spark, d, "benchmark")
    typed = F.to_json(F.struct(F.lit("graphrag.query").alias("type"), F.to_json(F.struct(F.col("text").alias("question"), F.array("text", F.reverse("text"), F.lit(" ")).alias("retrieval_queries"))).alias("payload")))
    legacy = F.to_json(F.struct(F.col("text").alias("query"), F.lit(3).alias("top_k")))
    return b.select(F.col("item_id").alias("key"), F.timestamp_seconds(F.col("item_id")).alias("ts"), F.col("item_id").alias("seq"), F.when(F.col("item_id") % 2 == 0, typed).otherwise(legacy).alias("value"))


@query("st6_asked_queries", "SELECT item_id AS query_id, q_idx, text FROM (SELECT item_id, 0 AS q_idx, text FROM benchmark UNION ALL SELECT item_id, 1, reverse(text) FROM benchmark WHERE item_id%2=0 AND reverse(text)<>text)")
def st6(spark, d):
    return I.asked_queries(I.envelopes(query_messages(spark, d)))


@query("st6_answers")
def st6_answers(spark, d):
    return Q.rewrite_hits(I.asked_queries(I.envelopes(query_messages(spark, d))), V.paragraphs(spark, d)).where("rank <= 8")


@query("u1_embedded_topk")
def u1(spark, d):
    """Hashed bags of words by a plugged-in embedder over whole batches, then the exact top 10 of each query."""
    import numpy as np

    def embedder(texts):
        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, sum(w.encode()) % 64] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)

    chunks = R.embed(V.paragraphs(spark, d).select(F.col("chunk_id"), "text"), embedder)
    queries = R.embed(V.eval_queries(spark, d).select(F.col("query_id").cast("string").alias("query_id"), "text"), embedder, key="query_id")
    return R.vector_topk(queries, chunks, 10).select("query_id", "chunk_id", "rank", "score")


@query("u2_encoded_terms", sql("tf stats chunk_len", "SELECT chunk_id, term, round(tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl)),6) AS weight FROM tf JOIN chunk_len USING (chunk_id), stats"))
def u2(spark, d):
    return R.encode_terms(V.paragraphs(spark, d)).withColumn("weight", F.round("weight", 6))


@query("u4_chunker_function", "SELECT doc_id, i, w AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text)-1,0)//1000+1)) AS j FROM documents), LATERAL (SELECT trim(substr(text, j*1000+1, 1200)) AS w, j AS i) WHERE w<>''")
def u4(spark, d):
    CH.register_chunker(spark)
    return spark.sql("SELECT doc_id, i, piece FROM {docs}, LATERAL rechunk_text(text, 'window')", docs=V.table(spark, d, "documents").where("text is not null"))


@query("u4_rechunked_atoms", sql("atoms", """SELECT granularity, doc_id, paragraph_index, page, section, md5(text) AS digest FROM (SELECT 'paragraph' AS granularity, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)-1 AS paragraph_index, page, section, text FROM sec
 UNION ALL SELECT 'page', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page)-1, page, arg_max(coalesce(section,'~'), pos), string_agg(text, chr(10)||chr(10) ORDER BY pos) FROM sec GROUP BY doc_id, page)""".replace("page, section, md5", "page, nullif(section,'~') AS section, md5"), bodies=TQ.BODY, sec=TQ.SEC))
def u4_atoms(spark, d):
    """The table function over all atoms at two granularities; the test has all five."""
    register_rechunker(spark)
    atoms, out = V.atoms(spark, d), None
    for g in ("paragraph", "page"):
        rows = spark.sql(f"SELECT '{g}' AS granularity, doc_id, paragraph_index, page, section, md5(text) AS digest FROM rechunk_atoms(TABLE({{atoms}}), '{g}')", atoms=atoms)
        out = rows if out is None else out.union(rows)
    return out


@query("pw7_hypotheses", sql("paragraphs", "SELECT 'hypothesis_'||chunk_id AS source, 'HAS_PASSAGE' AS relation, 'passage_'||chunk_id AS target FROM paragraphs WHERE paragraph_index%4=3 UNION ALL SELECT 'hypothesis_'||chunk_id, 'EVIDENCED_BY', 'source_'||source FROM paragraphs WHERE paragraph_index%4=3 AND source IS NOT NULL"))
def pw7(spark, d):
    kind = F.when(F.col("paragraph_index") % 4 == 3, "constraint_example").otherwise("book_text")
    p = V.paragraphs(spark, d).withColumns({"chunk_type": kind, "summary": F.lit(""), "source_id": F.concat(F.lit("source_"), "source")})
    return G.example_hypotheses(p)[1]


@query("pw7_hypothesis_nodes", sql("paragraphs", "SELECT 'hypothesis_'||chunk_id AS node_id, left(text,72) AS label, md5(text) AS claim FROM paragraphs WHERE paragraph_index%4=3"))
def pw7_nodes(spark, d):
    kind = F.when(F.col("paragraph_index") % 4 == 3, "constraint_example").otherwise("book_text")
    p = V.paragraphs(spark, d).withColumns({"chunk_type": kind, "summary": F.lit(""), "source_id": F.concat(F.lit("source_"), "source")})
    return G.example_hypotheses(p)[0].select("node_id", "label", F.md5("claim").alias("claim"))
