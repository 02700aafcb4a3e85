"""Views of the knowledge model over the driver tables, and the same views as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions.text import slug
from loregraph.operators import graph, losses
from loregraph.operators.chunking import tag_entities

# The keyword lexicon and rule table of the fixtures.
LEXICON = (
    ("mech_a", "schkeit"),
    ("mech_b", "ungl"),
    ("mech_c", "erblest"),
    ("process_a", "eaux"),
    ("process_b", "ouche"),
    ("equip_a", "ation"),
    ("equip_b", "esth"),
    ("mineral_a", "ción"),
    ("mineral_b", "mento"),
    ("reagent_a", "iez"),
    ("reagent_b", "heit"),
    ("metal_ni", "tzer"),
)
RULES = (
    ("closed_pnt_cp", "coarse", None, None, "EXPLAINED_BY", "mech_a"),
    ("closed_pnt_cp", "coarse", None, "mech_a", "ADDRESSED_BY", "process_a"),
    ("closed_pnt_cp", "coarse", None, "process_a", "USES_EQUIPMENT", "equip_a"),
    ("closed_pnt_cp", "coarse", None, "process_a", "USES_EQUIPMENT", "equip_b"),
    ("open_pnt_cp", "fine", None, None, "EXPLAINED_BY", "mech_b"),
    ("open_pnt_cp", "fine", None, "mech_b", "ADDRESSED_BY", "process_b"),
    ("open_pnt_cp", "fine", None, "process_b", "USES_EQUIPMENT", "equip_b"),
    ("millerite", None, "Ni", None, "EXPLAINED_BY", "mech_c"),
    ("millerite", None, "Ni", "mech_c", "ADDRESSED_BY", "process_a"),
)

LOSS_SELECT = """
SELECT n_name AS factory,
  CASE WHEN p_size>=40 THEN '+125' WHEN p_size>=30 THEN '+71' WHEN p_size>=20 THEN '-71 + 45'
       WHEN p_size>=10 THEN '-45 + 20' WHEN p_size>=5 THEN '-20 + 10' ELSE '-10' END AS size_class,
  CASE WHEN p_type='SMALL' THEN 'open_pnt_cp' WHEN p_type='MEDIUM' THEN 'closed_pnt_cp' WHEN p_type='LARGE' THEN 'pyrrhotite_impurity'
       WHEN p_type='ECONOMY' THEN 'silicate_valleriite' WHEN p_type='STANDARD' THEN 'pyrite' ELSE 'millerite' END AS mineral_form,
  CASE l_linestatus WHEN 'O' THEN 'Ni' ELSE 'Cu' END AS metal,
  round(sum(l_quantity),2) AS tonnes
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey JOIN {supplier} ON l_suppkey=s_suppkey JOIN {nation} ON s_nationkey=n_nationkey
GROUP BY 1,2,3,4"""


def n_rows():
    return F.count(F.lit(1)).alias("n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "p"))
    d = d.withColumn("text", F.trim("p")).where("text <> ''").drop("p")
    return d.withColumn("chunk_id", F.concat(F.lit("book_"), "doc_id", F.lit("_paragraph_i"), "paragraph_index"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as document atoms: five to a page, short ones are headings."""
    p = paragraphs(spark, sf_dir)
    return p.select("doc_id", F.col("paragraph_index").alias("pos"), (F.floor(F.col("paragraph_index") / 5) + 1).cast("int").alias("page"), (F.length("text") < 40).alias("is_heading"), "text")


def loss_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    rows = spark.sql(LOSS_SELECT, lineitem=read("lineitem"), part=read("part"), supplier=read("supplier"), nation=read("nation"))
    node = losses.bucket_id(F.col("factory"), F.col("size_class"), F.col("mineral_form"), F.col("metal"))
    return rows.withColumns({"recoverable": losses.is_recoverable(F.col("mineral_form"), F.col("metal")), "node_id": node})


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "node_id string, keyword string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "mineral_form string, size string, metal string, source string, relation string, target string")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_entities(paragraphs(spark, sf_dir), lexicon(spark))


def factory_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factories have equip_a, those of odd nations equip_b too."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("factory"), F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("equip_a"), F.lit("equip_b"))).otherwise(F.array(F.lit("equip_a"))).alias("e"))
    return n.select("factory", F.explode("e").alias("equipment"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxonomy, rule, equipment and evidence edges."""
    b = loss_forms(spark, sf_dir)
    equipment = factory_equipment(spark, sf_dir).select(slug(F.lit("factory"), F.col("factory")).alias("source"), F.lit("HAS_EQUIPMENT").alias("relation"), F.col("equipment").alias("target"))
    chunk_source = paragraphs(spark, sf_dir).select("chunk_id", "source")
    evidence = tags(spark, sf_dir).join(chunk_source, "chunk_id").select(F.col("node_id").alias("source"), F.lit("EVIDENCED_BY").alias("relation"), F.concat(F.lit("source_"), "source").alias("target"))
    return graph.distinct_edges(losses.taxonomy_edges(b).union(losses.rule_edges(b, rules(spark))).union(equipment).union(evidence))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end of an edge and every catalog entity, with type and label."""
    e = edges(spark, sf_dir)
    ids = e.select(F.col("source").alias("node_id")).union(e.select("target")).union(lexicon(spark).select("node_id")).distinct()
    return ids.withColumns({"node_type": graph.node_type(F.col("node_id")), "label": F.replace("node_id", F.lit("_"), F.lit(" "))})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests with a factory, a metal and, for odd conversations, an explicit bucket of that factory."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("factory"))
    r = c.join(n, F.pmod("conv_id", F.lit(25)) == F.col("n_nationkey"))
    r = r.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("question"), "factory", F.when(F.col("turn") % 2 == 0, "Ni").otherwise("Cu").alias("metal"), "conv_id")
    odd = F.col("conv_id") % 2 == 1
    third = F.col("conv_id") % 3 == 0
    r = r.withColumns({"size_class": F.when(third, "+71"), "mineral_form": F.when(third, "closed_pnt_cp")})
    explicit = losses.bucket_id(F.col("factory"), F.lit("+125"), F.lit("pyrite"), F.col("metal"))
    return r.withColumn("bucket_id", F.when(odd, explicit)).drop("conv_id")


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def slug_sql(*parts: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(concat_ws('_',{','.join(parts)})),'[^\\p{{L}}\\p{{N}}_+]+','_','g'),'_+','_','g'),'_')"


TOKENS_SQL = "regexp_extract_all(lower({}),'[a-zA-Zа-яА-ЯёЁ0-9]+')"
_rows = lambda rows: ",".join("(" + ",".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)
COARSE_SQL = "size_class IN ('+125','+71','-125+71','-71+45','-71 + 45')"
SIZE_KIND_SQL = f"CASE WHEN {COARSE_SQL} THEN 'coarse' WHEN size_class='-10' THEN 'fine' END"

CTES = {
    "paragraphs": "SELECT 'book_'||doc_id||'_paragraph_i'||(i-1) AS chunk_id, doc_id, source, lang, i-1 AS paragraph_index, trim(p) AS text FROM (SELECT doc_id, source, lang, unnest(string_split(text,chr(10))) p, generate_subscripts(string_split(text,chr(10)),1) i FROM documents) WHERE trim(p)<>''",
    "atoms": "SELECT doc_id, paragraph_index AS pos, CAST(paragraph_index//5+1 AS INT) AS page, length(text)<40 AS is_heading, text FROM paragraphs",
    "loss0": LOSS_SELECT.format(lineitem="lineitem", part="part", supplier="supplier", nation="nation"),
    "loss": f"SELECT *, (mineral_form IN ('open_pnt_cp','closed_pnt_cp') OR (mineral_form='millerite' AND metal='Ni')) AS recoverable, {slug_sql(chr(39) + 'lossform' + chr(39), 'factory', 'size_class', 'mineral_form', 'metal')} AS node_id FROM loss0",
    "lexicon": f"SELECT * FROM (VALUES {_rows(LEXICON)}) t(node_id, keyword)",
    "tags": "SELECT DISTINCT chunk_id, node_id FROM paragraphs JOIN lexicon ON contains(lower(text), keyword)",
    "rules": f"SELECT * FROM (VALUES {_rows(RULES)}) t(r_form, r_size, r_metal, r_source, relation, target)",
    "equipment": "SELECT n_name AS factory, unnest(CASE WHEN n_nationkey%2=1 THEN ['equip_a','equip_b'] ELSE ['equip_a'] END) AS equipment FROM nation",
    "taxonomy": f"""SELECT DISTINCT unnest(e).source AS source, unnest(e).relation AS relation, unnest(e).target AS target FROM (SELECT [
        {{'source':f,'relation':'HAS_LOSS','target':node_id}}, {{'source':node_id,'relation':'IN_SIZECLASS','target':s}},
        {{'source':node_id,'relation':'OF_MINERAL','target':m}}, {{'source':node_id,'relation':'CARRIES_METAL','target':x}},
        {{'source':node_id,'relation':CASE WHEN recoverable THEN 'RECOVERABLE' ELSE 'NON_RECOVERABLE' END,'target':x}},
        {{'source':f,'relation':'RELATED_TO','target':s}}] AS e FROM (SELECT *, {slug_sql("'factory'", 'factory')} f, {slug_sql("'size'", 'size_class')} s, {slug_sql("'mineral'", 'mineral_form')} m, {slug_sql("'metal'", 'metal')} x FROM loss))""",
    "rule_edges": f"SELECT DISTINCT coalesce(r_source,node_id) AS source, relation, target FROM (SELECT *, {SIZE_KIND_SQL} AS kind FROM loss WHERE recoverable) JOIN rules ON mineral_form=r_form AND (r_size IS NULL OR r_size=kind) AND (r_metal IS NULL OR r_metal=metal)",
    "edges": f"SELECT * FROM taxonomy UNION SELECT * FROM rule_edges UNION SELECT {slug_sql(chr(39) + 'factory' + chr(39), 'factory')}, 'HAS_EQUIPMENT', equipment FROM equipment UNION SELECT node_id, 'EVIDENCED_BY', 'source_'||source FROM tags JOIN paragraphs USING (chunk_id)",
    "node_ids": "SELECT source AS node_id FROM edges UNION SELECT target FROM edges UNION SELECT node_id FROM lexicon",
    "nodes": "SELECT node_id, CASE " + " ".join(f"WHEN starts_with(node_id,'{p}') THEN '{n}'" for p, n in (("lossform_", "LossForm"), ("mech_", "Mechanism"), ("process_", "Process"), ("equip_", "Equipment"), ("mineral_", "Mineral"), ("reagent_", "Reagent"), ("metal_", "Metal"), ("factory_", "Factory"), ("size_", "SizeClass"), ("passage_", "Passage"), ("hyp_", "Hypothesis"))) + " ELSE 'Source' END AS node_type, replace(node_id,'_',' ') AS label FROM node_ids",
    "req": f"""SELECT conv_id*1000+turn AS request_id, text AS question, n_name AS factory, CASE WHEN turn%2=0 THEN 'Ni' ELSE 'Cu' END AS metal,
        CASE WHEN conv_id%3=0 THEN '+71' END AS size_class, CASE WHEN conv_id%3=0 THEN 'closed_pnt_cp' END AS mineral_form,
        CASE WHEN conv_id%2=1 THEN {slug_sql("'lossform'", 'n_name', "'+125'", "'pyrite'", "CASE WHEN turn%2=0 THEN 'Ni' ELSE 'Cu' END")} END AS bucket_id
        FROM conversations JOIN nation ON conv_id%25=n_nationkey WHERE role='user'""",
    "eq": "SELECT item_id AS query_id, text FROM benchmark",
    "chunk_tokens": f"SELECT chunk_id, unnest({TOKENS_SQL.format('text')}) AS term FROM paragraphs",
    "query_tokens": f"SELECT query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM eq",
    "tf": "SELECT chunk_id, term, count(*) AS tf FROM chunk_tokens GROUP BY 1,2",
    "dfreq": "SELECT term, count(*) AS df FROM tf GROUP BY 1",
    "stats": f"SELECT count(*) AS n, avg(len({TOKENS_SQL.format('text')})) AS avgdl FROM paragraphs",
    "chunk_len": f"SELECT chunk_id, len({TOKENS_SQL.format('text')}) AS dl FROM paragraphs",
}
NEEDS = {
    "atoms": ["paragraphs"],
    "loss": ["loss0"],
    "tags": ["paragraphs", "lexicon"],
    "taxonomy": ["loss"],
    "rule_edges": ["loss", "rules"],
    "edges": ["taxonomy", "rule_edges", "equipment", "tags"],
    "node_ids": ["edges"],
    "nodes": ["node_ids"],
    "chunk_tokens": ["paragraphs"],
    "query_tokens": ["eq"],
    "tf": ["chunk_tokens"],
    "dfreq": ["tf"],
    "stats": ["paragraphs"],
    "chunk_len": ["paragraphs"],
}


def sql(needs: str, body: str, **more: str) -> str:
    """``body`` with the named views, and what they need, as common table expressions; ``more`` adds others after them."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
