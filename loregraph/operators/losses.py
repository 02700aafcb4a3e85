"""Loss buckets: ranking, budget inference, rule edges, reports and review gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.text import normalize_size_class, slug

# Size classes, recoverable forms and intervention profiles of the loss model.
COARSE = ("+125", "+71", "-125+71", "-71+45", "-71 + 45")
FINE = ("-10",)
RECOVERABLE = (("open_pnt_cp", "Ni"), ("closed_pnt_cp", "Ni"), ("millerite", "Ni"), ("open_pnt_cp", "Cu"), ("closed_pnt_cp", "Cu"))
PROFILES = (
    ("closed_pnt_cp", "coarse", "medium", 62.0),
    ("closed_pnt_cp", "fine", "medium", 50.0),
    ("open_pnt_cp", "fine", "low", 28.0),
    ("open_pnt_cp", "coarse", "low", 35.0),
    ("millerite", None, "low", 32.0),
    ("pyrrhotite_impurity", None, "high", 75.0),
    ("silicate_valleriite", None, "low", 5.0),
    ("pyrite", None, "low", 10.0),
)
DEFAULT_PROFILE = ("medium", 45.0)
LADDER = ((800.0, 1.0), (300.0, 0.65), (80.0, 0.35))


def is_coarse(size_class: Column) -> Column:
    return normalize_size_class(size_class).isin(*COARSE)


def is_fine(size_class: Column) -> Column:
    return normalize_size_class(size_class).isin(*FINE)


def is_recoverable(form: Column, metal: Column) -> Column:
    out = F.lit(False)
    for f, m in RECOVERABLE:
        out = out | ((form == f) & (metal == m))
    return F.coalesce(out, F.lit(False))


def bucket_id(factory: Column, size_class: Column, form: Column, metal: Column) -> Column:
    """The slug of a bucket; null unless all four slots are set."""
    every = factory.isNotNull() & size_class.isNotNull() & form.isNotNull() & metal.isNotNull()
    return F.when(every, slug(F.lit("lossform"), factory, size_class, form, metal))


def parse_cells(cells: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Loss buckets from report cells (factory, sheet, row_idx, c1..c7).

    A row with the share header in c4 opens a size class named in c2; rows whose c2 is one of ``forms`` (label -> slug)
    give the tonnes of two metals in c5 and c7. Missing, unreadable and non-positive tonnes are dropped.
    """
    order = Window.partitionBy("factory", "sheet").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("size_class", F.last(F.when(F.col("c4") == "Доля потерь", F.col("c2")), ignorenulls=True).over(order))
    c = c.where(F.col("c2").isin(*forms) & F.col("size_class").isNotNull())
    label = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    c = c.withColumn("mineral_form", label[F.col("c2")])
    c = c.select("factory", "sheet", "row_idx", "size_class", "mineral_form", F.explode(F.array(F.struct(F.lit("Ni").alias("metal"), F.col("c5").alias("t")), F.struct(F.lit("Cu").alias("metal"), F.col("c7").alias("t")))).alias("x"))
    tonnes = F.round(F.expr("try_cast(x.t as double)"), 2)
    return c.select("factory", "sheet", "row_idx", "size_class", "mineral_form", "x.metal", tonnes.alias("tonnes")).where("tonnes > 0")


def top_losses(buckets: DataFrame, limit: int, factory: str | None = None, metal: str | None = None, form: str | None = None, size_class: str | None = None, recoverable: bool | None = None) -> DataFrame:
    for name, value in (("factory", factory), ("metal", metal), ("mineral_form", form), ("size_class", size_class), ("recoverable", recoverable)):
        if value is not None:
            buckets = buckets.where(F.col(name) == value)
    return buckets.orderBy(F.desc("tonnes"), "node_id").limit(limit)


def top_per_factory(buckets: DataFrame, k: int) -> DataFrame:
    """The k largest recoverable losses of each factory."""
    w = Window.partitionBy("factory").orderBy(F.desc("tonnes"), "node_id")
    return buckets.where("recoverable").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_of_scope(buckets: DataFrame, scope: list[str]) -> DataFrame:
    """The largest bucket of each scope (of all buckets without one); ties to the smaller id, a null tonnage is the least.

    Each task keeps one row of a scope, so no scope is sorted and a hot one is no burden.
    """
    none = F.col("tonnes").isNull()
    own = F.min_by(F.struct("*"), F.struct(none, -F.col("tonnes"), "node_id"))
    return buckets.groupBy(*scope).agg(own.alias("_row")).where("_row is not null").select("_row.*")


def factory_breakdown(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("factory").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tonnes"), 1).alias("total_tonnes"))


def value_percentile(buckets: DataFrame) -> DataFrame:
    """Rank by tonnes among the factory's recoverable buckets and 1 - (rank - 1) / max(n - 1, 1); without peers by a ladder of tonnes."""
    peers = buckets.where("recoverable and tonnes > 0")
    w = Window.partitionBy("factory")
    ranked = peers.select("node_id", F.row_number().over(w.orderBy(F.desc("tonnes"), "node_id")).alias("rank"), F.count(F.lit(1)).over(w).alias("peers"))
    out = buckets.join(ranked, "node_id", "left")
    ladder = F.lit(0.15)
    for least, share in reversed(LADDER):
        ladder = F.when(F.col("tonnes") >= least, share).otherwise(ladder)
    share = 1 - (F.col("rank") - 1) / F.greatest(F.col("peers") - 1, F.lit(1))
    return out.withColumn("percentile", F.when(F.col("rank").isNotNull(), F.when(F.col("peers") > 1, share).otherwise(ladder)).otherwise(0.5))


def with_profile(buckets: DataFrame) -> DataFrame:
    """Base tier and score: by form and coarse or fine size, else by form alone, else the default."""
    tier, base = F.lit(None).cast("string"), F.lit(None).cast("double")
    kind = F.when(is_coarse(F.col("size_class")), "coarse").when(is_fine(F.col("size_class")), "fine")
    for form, size, t, b in PROFILES:
        hit = (F.col("mineral_form") == form) & ((kind == size) if size else F.lit(True))
        tier, base = F.when(hit, t).otherwise(tier), F.when(hit, b).otherwise(base)
    return buckets.withColumns({"base_tier": F.coalesce(tier, F.lit(DEFAULT_PROFILE[0])), "base_score": F.coalesce(base, F.lit(DEFAULT_PROFILE[1]))})


def infer_budget(buckets: DataFrame) -> DataFrame:
    """budget_score, low, medium, high and budget_tier of each bucket; not recoverable ones are low."""
    b = with_profile(value_percentile(buckets))
    b = b.withColumn("budget_score", F.round(F.least(F.lit(100.0), 65 * F.col("percentile") + 0.35 * F.col("base_score")), 1))
    s, pct = F.col("budget_score"), F.col("percentile")
    low = F.greatest(F.lit(0.0), 1 - s / 45) + F.when(F.col("base_tier") == "low", 0.15).otherwise(0) + F.when(pct < 0.55, 0.10).otherwise(0)
    medium = F.greatest(F.lit(0.0), 1 - F.abs(s - 50) / 35) + F.when(F.col("base_tier") == "medium", 0.15).otherwise(0) + F.when((pct >= 0.55) & (pct < 0.85), 0.15).otherwise(0)
    high = F.greatest(F.lit(0.0), (s - 35) / 65) + F.when(F.col("base_tier") == "high", 0.15).otherwise(0) + F.when(pct >= 0.85, 0.25).otherwise(0)
    b = b.withColumns({"_l": low, "_m": medium, "_h": high}).withColumn("_t", F.col("_l") + F.col("_m") + F.col("_h"))
    b = b.withColumns({"low": F.round(F.col("_l") / F.col("_t"), 3), "medium": F.round(F.col("_m") / F.col("_t"), 3), "high": F.round(F.col("_h") / F.col("_t"), 3)})
    best = F.greatest("low", "medium", "high")
    b = b.withColumn("budget_tier", F.when(F.col("low") == best, "low").when(F.col("medium") == best, "medium").otherwise("high"))
    no = ~F.col("recoverable")
    fixed = {"budget_score": 8.0, "low": 1.0, "medium": 0.0, "high": 0.0, "budget_tier": "low"}
    return b.withColumns({k: F.when(no, v).otherwise(F.col(k)) for k, v in fixed.items()}).drop("_l", "_m", "_h", "_t")


def resolve_tier(explicit: Column, inferred: Column) -> Column:
    return F.when(explicit.isin("low", "medium", "high"), explicit).otherwise(inferred)


def agent_role(intent: Column, form: Column, size_class: Column) -> Column:
    return (
        F.when(intent.isin("top_losses", "recoverable_losses", "factory_breakdown", "stats"), "LossAttribution")
        .when((form == "closed_pnt_cp") & is_coarse(size_class), "Comminution")
        .when((form == "open_pnt_cp") & is_fine(size_class), "Flotation")
        .when(form == "millerite", "Reagent")
        .otherwise("General")
    )


def resolve_buckets(requests: DataFrame, buckets: DataFrame, auto_bucket: bool = True) -> DataFrame:
    """bucket and method of each request (request_id, bucket_id, factory, size_class, mineral_form, metal).

    Explicit id, else the slots' slug if it exists (with auto_bucket), else the largest by factory and metal, by
    factory, or of all.
    """
    first = lambda scope, name: top_of_scope(buckets, scope).select(*(F.col(c).alias(f"{name}_{c}") for c in scope), F.col("node_id").alias(name))
    r = requests.withColumn("_slug", F.when(F.lit(auto_bucket), bucket_id(F.col("factory"), F.col("size_class"), F.col("mineral_form"), F.col("metal"))))
    known = buckets.select(F.col("node_id").alias("_known"))
    r = r.join(known, r["_slug"] == known["_known"], "left")
    fm, f, g = first(["factory", "metal"], "_fm"), first(["factory"], "_f"), first([], "_g")
    r = r.join(fm, (r["factory"] == fm["_fm_factory"]) & (r["metal"] == fm["_fm_metal"]), "left")
    r = r.join(f, r["factory"] == f["_f_factory"], "left").join(F.broadcast(g), F.lit(True), "left")  # g has one row
    method = F.when(F.col("bucket_id").isNotNull(), "explicit").when(F.col("_known").isNotNull(), "slots").when(F.col("_fm").isNotNull(), "top_factory_metal").when(F.col("_f").isNotNull(), "top_factory").when(F.col("_g").isNotNull(), "top_global")
    return r.select("request_id", F.coalesce("bucket_id", "_known", "_fm", "_f", "_g").alias("bucket"), method.alias("method"))


def rule_edges(buckets: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (source, relation, target) of recoverable buckets by a table of rules.

    rules: rule, mineral_form, size (coarse, fine or null), metal (or null), source (null: the bucket), relation, target.
    """
    kind = F.when(is_coarse(F.col("size_class")), "coarse").when(is_fine(F.col("size_class")), "fine")
    b = buckets.where("recoverable").select("node_id", F.col("mineral_form").alias("_form"), kind.alias("_size"), F.col("metal").alias("_metal"))
    hit = (F.col("_form") == F.col("mineral_form")) & (F.col("size").isNull() | (F.col("size") == F.col("_size"))) & (rules["metal"].isNull() | (rules["metal"] == F.col("_metal")))
    return b.join(rules, hit).select(F.coalesce("source", "node_id").alias("source"), "relation", "target").distinct()


def taxonomy_edges(buckets: DataFrame) -> DataFrame:
    """The seven edges that place a bucket among factories, size classes, minerals and metals."""
    factory, size = slug(F.lit("factory"), F.col("factory")), slug(F.lit("size"), F.col("size_class"))
    mineral, metal = slug(F.lit("mineral"), F.col("mineral_form")), slug(F.lit("metal"), F.col("metal"))
    node = F.col("node_id")
    e = lambda s, r, t: F.struct(s.alias("source"), r.alias("relation"), t.alias("target"))
    every = F.array(
        e(factory, F.lit("HAS_LOSS"), node),
        e(node, F.lit("IN_SIZECLASS"), size),
        e(node, F.lit("OF_MINERAL"), mineral),
        e(node, F.lit("CARRIES_METAL"), metal),
        e(node, F.when(F.col("recoverable"), "RECOVERABLE").otherwise("NON_RECOVERABLE"), metal),
        e(factory, F.lit("RELATED_TO"), size),
    )
    return buckets.select(F.inline(every)).distinct()


def gate(metrics: Column) -> Column:
    """A review passes only if all its binary metrics are 1."""
    return F.forall(metrics, lambda m: m == 1)


def weighted_score(a: Column, b: Column, c: Column, *blocking: Column) -> Column:
    score = F.round(0.5 * a + 0.3 * b + 0.2 * c, 3)
    for x in blocking:
        score = F.when(x == 0, 0.0).otherwise(score)
    return score


def loop_outcome(reviews: DataFrame, most_rounds: int) -> DataFrame:
    """First terminal round of each hypothesis: all metrics 1 passes, a reject verdict rejects, else the rounds run out."""
    r = reviews.where(F.col("round") <= most_rounds)
    state = F.when(gate(F.col("metrics")), "passed").when(F.col("verdict") == "reject", "rejected")
    ends = r.groupBy("hypothesis_id").agg(F.min_by(state, F.when(state.isNotNull(), F.col("round"))).alias("outcome"), F.min(F.when(state.isNotNull(), F.col("round"))).alias("round"))
    return ends.select("hypothesis_id", F.coalesce("outcome", F.lit("Max iterations exceeded")).alias("outcome"), F.coalesce("round", F.lit(most_rounds)).alias("round"))


def report_rows(rows: DataFrame, minerals: Column, fine_share: Column) -> DataFrame:
    """Loss report: analysis, item, metal_1 and metal_2 from rows (mineral_form, size_class, metal_1, metal_2).

    ``minerals`` names the item of the mineral block (null: none), ``fine_share`` the part of a row that counts as fine.
    Blocks keep items in which either metal is positive; the automation row is 5% of all of them, at least 50 and 30.
    """
    two = lambda df: df.agg(F.round(F.sum("metal_1"), 2).alias("metal_1"), F.round(F.sum("metal_2"), 2).alias("metal_2"))
    by_mineral = two(rows.withColumn("item", minerals).where("item is not null").groupBy("item")).select(F.lit("mineral").alias("analysis"), "item", "metal_1", "metal_2")
    parts = rows.withColumn("_fine", fine_share).where("_fine is not null")
    parts = parts.select(F.explode(F.array(F.struct(F.lit("fine").alias("item"), F.col("_fine").alias("w")), F.struct(F.lit("coarse").alias("item"), (1 - F.col("_fine")).alias("w")))).alias("p"), "metal_1", "metal_2")
    parts = parts.where("p.w > 0").select("p.item", (F.col("metal_1") * F.col("p.w")).alias("metal_1"), (F.col("metal_2") * F.col("p.w")).alias("metal_2"))
    by_size = two(parts.groupBy("item")).select(F.lit("fraction").alias("analysis"), "item", "metal_1", "metal_2")
    blocks = by_mineral.union(by_size).where("metal_1 > 0 or metal_2 > 0")
    more = lambda c, least: F.greatest(F.round(F.coalesce(F.sum(c), F.lit(0.0)) * 0.05, 1), F.lit(least)).alias(c)
    auto = blocks.agg(more("metal_1", 50.0), more("metal_2", 30.0)).select(F.lit("automation").alias("analysis"), F.lit("automation").alias("item"), "metal_1", "metal_2")
    return blocks.union(auto)


def recommendations(report: DataFrame, rules: list[tuple[str, float, str]]) -> DataFrame:
    """share (%) of each mineral item in metal 1 and the code of a rule (item, least share, code) that it exceeds."""
    m = report.where("analysis = 'mineral'")
    m = m.withColumn("share", F.round(100 * F.col("metal_1") / F.sum("metal_1").over(Window.partitionBy("analysis")), 4))
    code = F.lit(None).cast("string")
    for item, least, name in rules:
        code = F.when((F.col("item") == item) & (F.col("share") > least), name).otherwise(code)
    return m.select("item", "metal_1", "share", code.alias("recommendation"))
