"""Requests: routing of questions, expansion, session context, and the whole retrieval plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.text import EXPANSION_TOKEN, citation, highlight, tokenize
from loregraph.operators import losses as L
from loregraph.operators import retrieval as R
from loregraph.operators.chunking import tag_entities
from loregraph.store import stored

# Channel weights and depths of retrieval.
WEIGHTS = {"graph": 2.5, "hybrid": 1.6, "constraint": 2.0, "dense": 1.0, "bm25": 1.3}
GRAPH_REPEAT = 1.5
K_CHANNEL, K_GRAPH, K_CONSTRAINT, K_OUT = 60, 30, 20, 8
SLOTS = ("factory", "metal", "mineral_form", "size_class", "node_type", "entity", "search")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_alias(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """The value of the first alias (in the list's order) that is a substring."""
    out = F.lit(None).cast("string")
    for needle, value in reversed(aliases):
        out = F.when(text.contains(needle), value).otherwise(out)
    return out


def classify_intent(text: Column, words: dict[str, tuple[str, ...]], entity: Column, factory: Column, search: Column) -> Column:
    """The intent of a lower-cased question by ordered word rules; ``words`` names the word list of each rule."""
    w = lambda name: has_any(text, words[name])
    return (
        F.when(w("count") & w("edge"), "edge_stats")
        .when(w("count"), "stats")
        .when(w("evidence"), "literature_evidence")
        .when(w("neighbour"), "neighbors")
        .when(w("equipment") & w("process"), "process_equipment")
        .when(w("intervention"), "intervention_path")
        .when(w("top"), "top_losses")
        .when(w("recoverable"), "recoverable_losses")
        .when(w("by_factory"), "factory_breakdown")
        .when(search.isNotNull() & w("find"), "search_nodes")
        .when(entity.isNotNull() & factory.isNull(), "neighbors")
        .otherwise("search_nodes")
    )


def expand_queries(queries: DataFrame, synonyms: DataFrame, most: int = 12) -> DataFrame:
    """query_id and text with synonyms (token, synonym) of its tokens added: at most ``most``, by token position, then synonym; none that is there already."""
    q = queries.select("query_id", "text", F.posexplode(F.array_distinct(tokenize(F.col("text"), EXPANSION_TOKEN))).alias("pos", "token"))
    hits = q.join(synonyms, "token").where(~F.contains(F.lower("text"), F.col("synonym")))
    hits = hits.groupBy("query_id", "synonym").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy("pos", "synonym")
    hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    added = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "synonym"))), lambda x: x["synonym"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "added").alias("text"))


def constraint_items(tier_text: Column, equipment: Column, user_items: Column, regulations: Column | None = None) -> Column:
    """The list of constraint texts that apply to a request: tier, equipment, regulations, its own; without blanks."""
    listed = F.when(F.size(equipment) > 0, F.concat(F.lit("Доступное оборудование: "), F.array_join(F.array_sort(equipment), ", ")))
    none = F.array().cast("array<string>")
    rules = none if regulations is None else F.coalesce(regulations, none)
    every = F.concat(F.array(tier_text, listed), rules, F.coalesce(user_items, none))
    return F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != ""))


def factory_regulations(factories: DataFrame, regulations: DataFrame) -> DataFrame:
    """factory and the texts of the regulations (seq, factory, text) that hold there, in order: its own and those of no factory."""
    rows = F.collect_list(F.struct("seq", "text"))
    own = regulations.where("factory is not null").groupBy("factory").agg(rows.alias("_own"))
    every = regulations.where("factory is null").agg(rows.alias("_every"))  # one row
    f = factories.select("factory").distinct().join(own, "factory", "left").join(F.broadcast(every), F.lit(True), "left")
    both = F.array_sort(F.concat(F.coalesce("_own", F.expr("array()").cast(f.schema["_every"].dataType)), "_every"))
    return f.select("factory", F.transform(both, lambda x: x["text"]).alias("regulations"))


def cited(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, source, chunk_type, text, metadata, source_url) with their citation's source_type, excerpt and display_ref."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string, string>"))
    c = chunks.withColumn("_c", citation(F.col("chunk_id"), F.col("source"), F.col("chunk_type"), F.col("text"), meta, F.col("source_url")))
    return c.withColumns({x: F.col(f"_c.{x}") for x in ("source_type", "excerpt", "display_ref")}).drop("_c")


def pin_first(ranked: DataFrame, pinned: DataFrame) -> DataFrame:
    """Put the pinned chunk (query_id, chunk_id) first with score 1.0; its other row goes."""
    rest = ranked.select("query_id", "chunk_id", "score", "position").join(pinned, ["query_id", "chunk_id"], "left_anti")
    return rest.union(pinned.select("query_id", "chunk_id", F.lit(1.0), F.lit(0)))


def question_slots(questions: DataFrame, aliases: DataFrame, text: str = "question") -> DataFrame:
    """Add the slots that a question names: a column for each slot of SLOTS with the value of its first alias in the text.

    aliases: slot, seq, needle, value, of any number. ``search`` is the last alias of slot search, else the whole question
    if it is longer than 3 characters.
    """
    q = questions.withColumn("_id", F.monotonically_increasing_id()) if "request_id" not in questions.columns else questions.withColumn("_id", F.col("request_id"))
    named = aliases.select(F.to_json(F.struct("slot", "seq", "value")).alias("node_id"), F.col("needle").alias("keyword"))
    hits = tag_entities(q.select(F.col("_id").alias("chunk_id"), F.col(text).alias("text")), named)
    hits = hits.select(F.col("chunk_id").alias("_id"), F.from_json("node_id", "slot string, seq int, value string").alias("a")).select("_id", "a.*")
    found = hits.groupBy("_id").pivot("slot", list(SLOTS)).agg(F.min_by("value", "seq"))
    out = q.join(found, "_id", "left").drop("_id")
    whole = F.when(F.length(F.trim(text)) > 3, F.trim(text))
    return out.withColumn("search", F.coalesce("search", whole))


def bucket_or_top(requests: DataFrame, buckets: DataFrame, k: int = 5) -> DataFrame:
    """request_id, rank, node_id and tonnes: the bucket that a request names, else the k largest that fit its other slots
    (factory, metal, mineral_form, size_class; null: any)."""
    named = requests.where("bucket_id is not null").join(buckets.select("node_id", "tonnes"), F.col("bucket_id") == F.col("node_id"))
    slots = ["factory", "metal", "mineral_form", "size_class"]
    rest = requests.where("bucket_id is null")
    scopes = rest.select(*slots).distinct()
    # The largest of each combination of set slots first, so that no request meets more than k buckets.
    tops = None
    for n in range(1 << len(slots)):
        own = [s for i, s in enumerate(slots) if n >> i & 1]
        scope = scopes
        for s in slots:
            scope = scope.where(F.col(s).isNotNull() if s in own else F.col(s).isNull())
        w = Window.partitionBy(*own).orderBy(F.desc("tonnes"), "node_id") if own else Window.orderBy(F.desc("tonnes"), "node_id")
        ranked = buckets if own else buckets.orderBy(F.desc("tonnes"), "node_id").limit(k)
        ranked = ranked.select(*own, "node_id", "tonnes", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
        part = scope.join(ranked, own) if own else scope.join(F.broadcast(ranked), F.lit(True))  # k rows
        part = part.select(*slots, "rank", "node_id", "tonnes")
        tops = part if tops is None else tops.union(part)
    tops = tops.toDF(*(f"_{s}" for s in slots), "rank", "node_id", "tonnes")
    same = F.lit(True)
    for s in slots:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return named.select("request_id", F.lit(1).alias("rank"), "node_id", "tonnes").union(rest.join(tops, same).select("request_id", "rank", "node_id", "tonnes"))


def constraint_rankings(scopes: DataFrame, chunks: DataFrame, k: int = K_CONSTRAINT) -> DataFrame:
    """The k constraint chunks of each query (query_id, factory, budget_tier): query_id, chunk_id, rank.

    Budget and example chunks of its tier, regulations of its factory or of none, which go first. Lists are cut to k for
    each tier and factory before they meet the queries.
    """
    top = lambda df, by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_id"))).where(F.col("_r") <= k).drop("_r")
    tiers = top(chunks.where("chunk_type in ('constraint_budget', 'constraint_example')").select("budget_tier", "chunk_id"), ["budget_tier"])
    rules = chunks.where("chunk_type = 'constraint_regulation'").select("factory", "chunk_id")
    own, every = top(rules.where("factory is not null"), ["factory"]), rules.where("factory is null").orderBy("chunk_id").limit(k).select("chunk_id")
    s = scopes.select("query_id", "factory", "budget_tier")
    hits = s.join(tiers, "budget_tier").select("query_id", "chunk_id", F.lit(1.0).alias("score"))
    hits = hits.union(s.join(own, "factory").select("query_id", "chunk_id", F.lit(2.0))).union(s.select("query_id").join(F.broadcast(every), F.lit(True)).select("query_id", "chunk_id", F.lit(2.0)))
    return R.top_k(hits, k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int, wanted: DataFrame | None = None, attributes: DataFrame | None = None, post: DataFrame | None = None) -> DataFrame:
    """BM25 and TF-IDF rankings of each query with equal weights: query_id, chunk_id, score, rank of the k best.

    wanted and attributes: filters of queries and chunks, applied in both channels before they are ranked. post: the chunks'
    packed postings, if they are there already.
    """
    filters = [stored(x) if x is not None else None for x in (wanted, attributes)]
    both = R.channels_topk(queries, chunks, k, post, *filters)
    return R.top_k(R.weighted_rrf(both.withColumn("weight", F.lit(1.0))), k)


def rewrite_hits(queries: DataFrame, chunks: DataFrame, k: int = K_CHANNEL, wanted: DataFrame | None = None, attributes: DataFrame | None = None, post: DataFrame | None = None) -> DataFrame:
    """Hybrid search for each rewrite (query_id, q_idx, text): query_id, q_idx, chunk_id, score, rank. Filters are those of query_id."""
    kind = queries.schema["query_id"].dataType.simpleString()
    each = queries.select(F.concat_ws("#", "query_id", "q_idx").alias("_each"), "query_id", "text")
    own = None if wanted is None else each.select("_each", "query_id").join(wanted, "query_id").drop("query_id").withColumnRenamed("_each", "query_id")
    return split_hits(hybrid_search(each.select(F.col("_each").alias("query_id"), "text"), chunks, k, own, attributes, post), kind)


def split_hits(hits: DataFrame, kind: str) -> DataFrame:
    """Hits of rewrites, whose id is query_id#q_idx, as query_id, q_idx, chunk_id, score, rank."""
    key = F.col("query_id")
    return hits.select(F.substring_index(key, "#", 1).cast(kind).alias("query_id"), F.substring_index(key, "#", -1).cast("int").alias("q_idx"), "chunk_id", "score", "rank")


def probe_top(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k first chunks of each rewrite of requests that have several."""
    hits = stored(hits)
    several = hits.groupBy("query_id").agg(F.countDistinct("q_idx").alias("_n")).where("_n > 1").select("query_id")
    return hits.where(F.col("rank") <= k).join(several, "query_id", "left_semi").select("query_id", "q_idx", "rank", "chunk_id")


def with_probes(hypotheses: DataFrame, probes: DataFrame) -> DataFrame:
    """Hypotheses (query_id, q_idx, ...) with the list of their probe's chunks; an empty one without a probe."""
    lists = probes.groupBy("query_id", "q_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("probe_top_chunks"))
    return hypotheses.join(lists, ["query_id", "q_idx"], "left").withColumn("probe_top_chunks", F.coalesce("probe_top_chunks", F.array().cast("array<string>")))


def rank_candidates(queries: DataFrame, chunks: DataFrame, query_nodes: DataFrame | None, tags: DataFrame | None, constraints: DataFrame | None = None, buckets: DataFrame | None = None, k_out: int = K_OUT, wanted: DataFrame | None = None, attributes: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """All channels fused and reranked, before diversity: query_id, chunk_id, score, channels, text, query_text.

    queries: query_id, q_idx, text (a row for each rewrite). query_nodes: query_id, node_id and tags: chunk_id, node_id (both
    None: no graph). constraints: query_id, chunk_id, rank. buckets: query_id of requests that are about one bucket, for which
    the graph's ranking counts once more. wanted (query_id, factory, external) and attributes (chunk_id, factory, external, chunk_type):
    filters of the channels. hits: those of the rewrites, if an index has found them already.
    """
    row = lambda df, name, weight: df.select("query_id", "chunk_id", "rank", F.lit(name).alias("channel"), F.lit(weight).alias("weight"))
    named = row(rewrite_hits(queries, chunks, wanted=wanted, attributes=attributes) if hits is None else hits, "hybrid", WEIGHTS["hybrid"])
    if constraints is not None:
        named = named.union(row(constraints, "constraint", WEIGHTS["constraint"]))
    if query_nodes is not None:
        graph = R.graph_topk(query_nodes, tags, K_GRAPH, None if wanted is None else wanted.select("query_id", "factory"), attributes)
        named = named.union(row(graph, "graph", WEIGHTS["graph"]))
        if buckets is not None:
            named = named.union(row(graph.join(buckets, "query_id", "left_semi"), "graph", GRAPH_REPEAT))
    fused = stored(R.top_k(R.weighted_rrf(named), 4 * k_out))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_idx", "text"))), lambda x: x["text"]), " | ")
    asked = queries.groupBy("query_id").agg(every.alias("query_text"))
    c = fused.select("query_id", "chunk_id", "score", "channels").join(chunks.select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
    if query_nodes is not None:
        none = F.array().cast("array<string>")
        nodes = query_nodes.groupBy("query_id").agg(F.collect_set("node_id").alias("nodes"))
        tagged = tags.groupBy("chunk_id").agg(F.collect_set("node_id").alias("graph_node_ids"))
        c = c.join(nodes, "query_id", "left").join(tagged, "chunk_id", "left").withColumns({"nodes": F.coalesce("nodes", none), "graph_node_ids": F.coalesce("graph_node_ids", none)})
        c = R.rerank_graph_overlap(c)
    return R.rerank_overlap(c).select("query_id", "chunk_id", F.round("score", 8).alias("score"), "channels", "text", "query_text")


def retrieve(candidates: DataFrame, k_out: int = K_OUT, pinned: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Diversity, the pinned chunk first (query_id, chunk_id; looked up in ``chunks``), highlights: query_id, position,
    chunk_id, score, channels, highlight."""
    candidates = stored(candidates)
    picked = R.mmr(candidates, k_out)
    if pinned is not None:
        picked = pin_first(picked, pinned)
    out = picked.join(candidates.select("query_id", "chunk_id", "text", "channels"), ["query_id", "chunk_id"], "left")
    out = out.join(candidates.groupBy("query_id").agg(F.first("query_text").alias("query_text")), "query_id", "left")
    if chunks is not None:
        out = out.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left").withColumn("text", F.coalesce("text", "_text"))
    return out.select("query_id", "position", "chunk_id", "score", F.coalesce("channels", F.lit("bucket")).alias("channels"), highlight(F.coalesce("query_text", F.lit("")), F.col("text")).alias("highlight"))


def merge_sources(rows: DataFrame) -> DataFrame:
    """Sources (request_id, seq, chunk_id, title, ...) without repeats: the first by chunk_id, or by title where that is missing."""
    key = F.coalesce(F.nullif("chunk_id", F.lit("")), "title")
    w = Window.partitionBy("request_id", key).orderBy("seq")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def enrich_sources(said: DataFrame, known: DataFrame) -> DataFrame:
    """Sources that a model named (request_id, seq, chunk_id, title, type, relevance) with what is known of their chunk
    (chunk_id, title, type, excerpt, relevance); one that isn't known keeps its own words."""
    k = known.select("chunk_id", F.col("title").alias("_title"), F.col("type").alias("_type"), F.col("excerpt").alias("_excerpt"), F.col("relevance").alias("_relevance"), F.lit(True).alias("_known"))
    s = said.join(k, "chunk_id", "left")
    own = lambda c, other: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit(other)))
    relevance = F.coalesce(F.nullif("relevance", F.lit("")), "_relevance", F.lit(""))
    return s.select("request_id", "seq", "chunk_id", own("title", "Источник").alias("title"), own("type", "reference").alias("type"), F.when(F.col("_known"), F.col("_excerpt")).otherwise(F.coalesce("relevance", F.lit(""))).alias("excerpt"), relevance.alias("relevance"))


def source_details(sources: DataFrame) -> DataFrame:
    """Sources (chunk_id, title, type, excerpt, relevance, source_url) as given out: title, type, excerpt, url."""
    url = F.when(F.coalesce("chunk_id", F.lit("")) != "", F.concat(F.lit("/api/v1/sources/chunks/"), "chunk_id")).otherwise(F.nullif("source_url", F.lit("")))
    words = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) if x in sources.columns else F.lit(x) for x in c))
    return sources.withColumns({"title": words("title", "chunk_id", "Источник"), "type": words("type", "db"), "excerpt": F.coalesce(words("excerpt", "relevance"), F.lit("")), "url": url})


def session_context(requests: DataFrame, buckets: DataFrame, equipment: DataFrame, tier_texts: dict[str, str], words: dict[str, tuple[str, ...]], regulations: DataFrame | None = None) -> DataFrame:
    """A row for each request: intent, bucket and how it was found, factory, budget tier, role, constraints, five largest buckets.

    requests: request_id, question, bucket_id, factory, metal, size_class, mineral_form, budget_tier, entity, search, user_constraints.
    regulations: seq, factory (null: all), text.
    """
    resolved = L.resolve_buckets(requests, buckets)
    budgets = L.infer_budget(buckets).select(F.col("node_id").alias("bucket"), F.col("factory").alias("_factory"), F.col("budget_tier").alias("_tier"), F.col("size_class").alias("_size"), F.col("mineral_form").alias("_form"))
    r = requests.join(resolved, "request_id").join(budgets, "bucket", "left")
    intent = classify_intent(F.lower("question"), words, F.col("entity"), F.col("factory"), F.col("search"))
    r = r.withColumns({"intent": intent, "_f": F.coalesce("factory", "_factory"), "tier": L.resolve_tier(F.col("budget_tier"), F.col("_tier"))})
    r = r.withColumn("role", L.agent_role(F.col("intent"), F.col("_form"), F.col("_size")))
    own = equipment.groupBy(F.col("factory").alias("_f")).agg(F.collect_set("equipment").alias("_equipment"))
    r = r.join(own, "_f", "left")
    rules = None
    if regulations is not None:
        held = factory_regulations(r.select(F.coalesce("_f", F.lit("")).alias("factory")), regulations)
        r, rules = r.join(held.select(F.col("factory").alias("_rf"), F.col("regulations").alias("_rules")), F.coalesce("_f", F.lit("")) == F.col("_rf"), "left"), F.col("_rules")
    texts = F.create_map(*[F.lit(x) for pair in tier_texts.items() for x in pair])
    r = r.withColumn("constraints", constraint_items(texts[F.col("tier")], F.coalesce("_equipment", F.array().cast("array<string>")), F.col("user_constraints"), rules))
    scopes = r.select("request_id", F.lit(None).cast("string").alias("bucket_id"), F.col("_f").alias("factory"), "metal", F.lit(None).cast("string").alias("mineral_form"), F.lit(None).cast("string").alias("size_class"))
    tops = bucket_or_top(scopes, buckets).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("top_buckets"))
    r = r.join(tops, "request_id", "left")
    return r.select("request_id", "intent", "bucket", "method", F.col("_f").alias("factory"), F.col("tier").alias("budget_tier"), "role", "constraints", "top_buckets")
