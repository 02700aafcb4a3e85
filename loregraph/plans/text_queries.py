"""Queries on text functions, chunking, documents with frontmatter and tagging."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions import files as FI
from loregraph.functions import text as X
from loregraph.operators import chunking as CH
from loregraph.plans import views as V
from loregraph.plans.views import TOKENS_SQL, n_rows, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("x1_tokenize", sql("paragraphs", f"SELECT chunk_id, len(t) AS n, t[1] AS first_token, t[-1] AS last_token FROM (SELECT chunk_id, {TOKENS_SQL.format('text')} AS t FROM paragraphs)"))
def x1(spark, d):
    p = V.paragraphs(spark, d).withColumn("t", X.tokenize(F.col("text")))
    return p.select("chunk_id", F.size("t").alias("n"), F.try_element_at("t", F.lit(1)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


@query("x2_expansion_tokens", sql("loss", "SELECT node_id, array_to_string(regexp_extract_all(lower(factory||' '||size_class||' cu-'||mineral_form),'[a-zA-Zа-яА-ЯёЁ0-9]+(?:[-+]\\d+)?'),'|') AS tokens FROM loss"))
def x2(spark, d):
    q = F.concat("factory", F.lit(" "), "size_class", F.lit(" cu-"), "mineral_form")
    return V.loss_forms(spark, d).select("node_id", F.array_join(X.tokenize(q, X.EXPANSION_TOKEN), "|").alias("tokens"))


WINDOWS = f"SELECT doc_id, i, {STRIP.format('substr(t, i*1000+1, 1200)')} AS w FROM (SELECT doc_id, t, unnest(range(0, (length(t)+999)//1000)) AS i FROM (SELECT doc_id, {STRIP.format('text')} AS t FROM documents) WHERE length(t)>0)"


@query("x7_windows", sql("", "SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, md5(string_agg(w, '|' ORDER BY i)) AS digest FROM win WHERE w<>'' GROUP BY 1", win=WINDOWS))
def x7(spark, d):
    w = V.table(spark, d, "documents").withColumn("w", X.split_windows(F.col("text"))).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"), F.md5(F.array_join("w", "|")).alias("digest"))


@query("x6_sentences")
def x6(spark, d):
    return V.paragraphs(spark, d).select("chunk_id", F.posexplode(X.split_sentences(F.col("text"))).alias("i", "sentence"))


def spaced(spark, d):
    """Documents with a blank line after every third line."""
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.when(i % 3 == 2, F.concat(p, F.lit("\n"))).otherwise(p))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


SPACED = "SELECT doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda x, i: CASE WHEN (i-1)%3=2 THEN x||chr(10) ELSE x END), chr(10)) AS text FROM documents"
PIECES = "SELECT doc_id, k, p FROM (SELECT doc_id, k, " + STRIP.format("raw") + " AS p FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l,1) AS k FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS l FROM spaced))) WHERE p<>''"
GROUPED = "SELECT *, sum(CASE WHEN first OR NOT (length(p)<80 AND NOT regexp_matches(p,'[.!?»\"]$')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k)=1 AS first FROM pieces)"


@query("x8_paragraph_merge", sql("", "SELECT doc_id, CAST(g-1 AS INT) AS i, string_agg(p, chr(10) ORDER BY k) AS paragraph FROM grouped GROUP BY doc_id, g", spaced=SPACED, pieces=PIECES, grouped=GROUPED))
def x8(spark, d):
    return spaced(spark, d).select("doc_id", F.posexplode(X.split_paragraphs(F.col("text"))).alias("i", "paragraph"))


@query("x9_blocks", "SELECT doc_id, count(*) AS n, sum(length(b)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) t(doc_id, l), LATERAL (SELECT " + STRIP.format("l") + " AS b) WHERE b<>'' GROUP BY 1")
def x9(spark, d):
    b = V.table(spark, d, "documents").select("doc_id", F.explode(X.split_blocks(F.col("text"))).alias("b"))
    return b.groupBy("doc_id").agg(n_rows(), F.sum(F.length("b")).alias("chars"))


@query("x10_spaced_letters")
def x10(spark, d):
    text = F.when(F.col("paragraph_index") % 2 == 0, F.array_join(F.split("text", ""), " ")).otherwise(F.col("text"))
    return V.paragraphs(spark, d).select("chunk_id", X.join_spaced_letters(text).alias("text"))


@query("f9_noise", sql("paragraphs", f"SELECT lang, count(*) FILTER (length({STRIP.format('text')})<8 OR starts_with({STRIP.format('text')},'![') OR NOT regexp_matches(text,'[\\p{{L}}_]')) AS noise, count(*) AS n FROM paragraphs GROUP BY 1"))
def f9(spark, d):
    return V.paragraphs(spark, d).groupBy("lang").agg(F.count_if(X.is_noise(F.col("text"))).alias("noise"), n_rows())


@query("f10_reextract", sql("paragraphs", f"SELECT lang, count(*) FILTER (length({STRIP.format('text')})<80 OR regexp_matches(text,'(^|[^\\p{{L}}\\p{{N}}_])([\\p{{L}}\\p{{N}}_]\\s){{4,}}[\\p{{L}}\\p{{N}}_]($|[^\\p{{L}}\\p{{N}}_])') OR length(regexp_replace(text,'[^\\p{{L}}]','','g'))<0.35*length(text)) AS bad, count(*) AS n FROM paragraphs GROUP BY 1"))
def f10(spark, d):
    return V.paragraphs(spark, d).groupBy("lang").agg(F.count_if(X.needs_reextraction(F.col("text"))).alias("bad"), n_rows())


@query("f13_valid_url", "SELECT page_id, regexp_matches(url,'^https?://[^/?#]+') AS valid FROM pages")
def f13(spark, d):
    url = F.col("url")
    ok = F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "")
    return V.table(spark, d, "pages").select("page_id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("f12_text_sniff", "SELECT conv_id, turn, (length(text)=0 OR position(chr(0) IN text)=0 AND length(regexp_replace(text,'[^ -~\\t\\n\\r]','','g'))>0.9*length(text)) AS is_text FROM (SELECT conv_id, turn, left(text,1024) AS text FROM conversations)")
def f12(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", FI.is_text(F.col("text")).alias("is_text"))


def marked(spark, d):
    """Documents with a frontmatter block."""
    head = F.concat(F.lit('---\ndoc_id: "'), "doc_id", F.lit('"\npage: '), F.pmod("doc_id", F.lit(40)) + 1, F.lit('\nlang: '), "lang", F.lit('\ntags: ["a","b"]\n---\n'))
    return V.table(spark, d, "documents").select("doc_id", "lang", F.concat(head, "text").alias("raw"), "text")


@query("x11_frontmatter", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS meta_id, CAST(doc_id%40+1 AS VARCHAR) AS page, lang, '[\"a\",\"b\"]' AS tags, length(text) AS chars FROM documents")
def x11(spark, d):
    m = marked(spark, d).withColumn("m", X.frontmatter(F.col("raw")))
    return m.select("doc_id", F.col("m")["doc_id"].alias("meta_id"), F.col("m")["page"].alias("page"), F.col("m")["lang"].alias("lang"), F.col("m")["tags"].alias("tags"), F.length(X.body(F.col("raw"))).alias("chars"))


@query("x12_image_refs", sql("paragraphs", "SELECT chunk_id, CASE WHEN paragraph_index%2=0 THEN 'img/'||doc_id||'.png' END AS ref, text AS plain FROM (SELECT *, " + STRIP.format("text") + " AS t FROM paragraphs)"))
def x12(spark, d):
    with_image = F.when(F.col("paragraph_index") % 2 == 0, F.concat(F.lit("![x y](img/"), "doc_id", F.lit(".png) "), "text")).otherwise(F.col("text"))
    p = V.paragraphs(spark, d).withColumn("raw", with_image)
    return p.select("chunk_id", F.try_element_at(X.image_refs(F.col("raw")), F.lit(1)).alias("ref"), F.trim(X.strip_images(F.col("raw"))).alias("plain"))


@query("x15_embed_text", sql("paragraphs", "SELECT chunk_id, md5(text||CASE WHEN paragraph_index%3=0 THEN '' ELSE chr(10)||lang END||chr(10)||'q1 q2') AS digest FROM paragraphs"))
def x15(spark, d):
    summary = F.when(F.col("paragraph_index") % 3 == 0, "").otherwise(F.col("lang"))
    return V.paragraphs(spark, d).select("chunk_id", F.md5(X.embed_text(F.col("text"), summary, F.array(F.lit("q1"), F.lit("q2")))).alias("digest"))


WANTED = f"SELECT chunk_id, text, list_sort(list_transform(list_filter(list_distinct({TOKENS_SQL.format('text')}), lambda x: length(x)>3 AND contains(lower(text),x)), lambda x: {{'n': -length(x), 't': x}}))[1].t AS tok FROM paragraphs"
SNIPPET = "SELECT chunk_id, text, tok, " + STRIP.format("substr(text, greatest(strpos(lower(text),tok)-40,1), strpos(lower(text),tok)+length(tok)+80-greatest(strpos(lower(text),tok)-40,1))") + " AS s FROM wanted"


@query("x16_highlight", sql("paragraphs", "SELECT chunk_id, CASE WHEN tok IS NULL THEN CASE WHEN length(text)>120 THEN left(text,120)||'…' ELSE text END WHEN length(s)>120 THEN left(s,119)||'…' ELSE s END AS highlight FROM snippet", wanted=WANTED, snippet=SNIPPET))
def x16(spark, d):
    """Each paragraph as the query for itself."""
    return V.paragraphs(spark, d).select("chunk_id", X.highlight(F.col("text"), F.col("text")).alias("highlight"))


@query("x27_roadmap", "SELECT doc_id, i AS \"order\", left(l,120) AS title FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, l FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS raw, generate_subscripts(string_split(text,chr(10)),1) AS k FROM documents), LATERAL (SELECT " + STRIP.format("raw") + " AS l) WHERE l<>'')")
def x27(spark, d):
    numbered = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda p: X.strip(p) != ""), lambda p, i: F.concat(i + 1, F.lit(". "), p)), "\n")
    return V.table(spark, d, "documents").select("doc_id", F.inline(X.roadmap_steps(numbered)))


@query("x31_passage_label", sql("paragraphs", "SELECT chunk_id, source||' · '||lang||' · §'||(paragraph_index+1) AS label, left(text,320) AS excerpt FROM paragraphs"))
def x31(spark, d):
    label = F.concat_ws(" · ", "source", "lang", F.concat(F.lit("§"), F.col("paragraph_index") + 1))
    return V.paragraphs(spark, d).select("chunk_id", label.alias("label"), F.left("text", F.lit(320)).alias("excerpt"))


@query("x32_source_entry", "SELECT page_id, 'Page '||page_id AS title, url FROM pages")
def x32(spark, d):
    title, url = X.source_entry(F.concat(F.lit("Page "), "page_id", F.lit(" "), "url"))
    return V.table(spark, d, "pages").select("page_id", title.alias("title"), url.alias("url"))


@query("j3_lexicon_tags", sql("tags", "SELECT chunk_id, node_id FROM tags"))
def j3(spark, d):
    return V.tags(spark, d)


BODY = "SELECT *, max(CASE WHEN is_heading THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS h, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM atoms"
SEC = "SELECT b.doc_id, b.pos, b.page, b.text, b.section_no, a.text AS section FROM bodies b LEFT JOIN atoms a ON a.doc_id=b.doc_id AND a.pos=b.h WHERE NOT b.is_heading"
PARTS = dict(bodies=BODY, sec=SEC)


@query("ch1_paragraphs", sql("atoms", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)-1 AS paragraph_index, page, section, text FROM sec", **PARTS))
def ch1(spark, d):
    return CH.paragraph_chunks(V.atoms(spark, d))


@query("ch2_sentences")
def ch2(spark, d):
    return CH.sentence_chunks(V.atoms(spark, d))


@query("ch3_pages", sql("atoms", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page)-1 AS paragraph_index, page, section, text FROM (SELECT doc_id, page, arg_max(section,pos) FILTER (section IS NOT NULL) AS section, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS text FROM sec GROUP BY 1,2)", **PARTS))
def ch3(spark, d):
    return CH.page_chunks(V.atoms(spark, d))


@query("ch4_sections", sql("atoms", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no)-1 AS paragraph_index, page, section, text FROM (SELECT doc_id, section_no, arg_min(page,pos) AS page, max(section) AS section, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS text FROM sec GROUP BY 1,2)", **PARTS))
def ch4(spark, d):
    return CH.section_chunks(V.atoms(spark, d))


CHW = f"SELECT doc_id, i, {STRIP.format('substr(t, i*1000+1, 1200)')} AS text FROM (SELECT doc_id, t, unnest(range(0, (length(t)+999)//1000)) AS i FROM (SELECT doc_id, {STRIP.format('string_agg(text, chr(10)||chr(10) ORDER BY pos)')} AS t FROM sec GROUP BY 1) WHERE length(t)>0)"
ENDS = "SELECT *, sum(length(text)+2) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM sec"


@query("ch5_windows", sql("atoms", "SELECT w.doc_id, i AS paragraph_index, arg_min(page,e) AS page, md5(w.text) AS digest FROM win w JOIN ends ON w.doc_id=ends.doc_id AND i*1000<e WHERE w.text<>'' GROUP BY 1,2,w.text", bodies=BODY, sec=SEC, ends=ENDS, win=CHW))
def ch5(spark, d):
    return CH.window_chunks(V.atoms(spark, d)).select("doc_id", "paragraph_index", "page", F.md5("text").alias("digest"))


@query("a12_chunk_sizes", sql("paragraphs", "SELECT lang, count(*) AS n, sum(l) AS total, round(avg(l),1) AS average, list_sort(list(l))[count(*)//2+1] AS p50, list_sort(list(l))[CAST(floor(count(*)*0.95) AS BIGINT)+1] AS p95, min(l) AS least, max(l) AS most FROM (SELECT lang, length(text) AS l FROM paragraphs) GROUP BY 1"))
def a12(spark, d):
    return CH.size_stats(V.paragraphs(spark, d), ["lang"])


@query("a13_extraction_quality", sql("atoms", "SELECT doc_id, count(*) AS paragraphs, sum(length(text)) AS chars, count(DISTINCT page) AS pages, min(length(text)) AS least, max(length(text)) AS most FROM atoms GROUP BY 1"))
def a13(spark, d):
    n = F.length("text")
    return V.atoms(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(n).alias("chars"), F.countDistinct("page").alias("pages"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("a24_document_catalog", sql("paragraphs", "SELECT doc_id, source, count(*) AS chunks FROM paragraphs GROUP BY ALL"))
def a24(spark, d):
    return V.paragraphs(spark, d).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("chunks"))


@query("w10_offsets", sql("atoms", "SELECT doc_id, pos, CAST(e AS BIGINT) AS ends FROM ends", bodies=BODY, sec=SEC, ends=ENDS))
def w10(spark, d):
    body = CH.with_section(V.atoms(spark, d)).where("not is_heading")
    return body.select("doc_id", "pos", F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("pos")).alias("ends"))
