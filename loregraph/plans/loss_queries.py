"""Queries on loss buckets, budgets, reports and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions import text as X
from loregraph.operators import losses as L
from loregraph.plans import views as V
from loregraph.plans.views import sql

COLS = ["factory", "size_class", "mineral_form", "metal", "tonnes", "recoverable", "node_id"]
C = ",".join(COLS)
FORMS = {"Open": "open_pnt_cp", "Closed": "closed_pnt_cp", "Pyrrhotite": "pyrrhotite_impurity", "Silicate": "silicate_valleriite", "Pyrite": "pyrite", "Millerite": "millerite"}
MINERAL_SQL = "CASE mineral_form WHEN 'silicate_valleriite' THEN 'silicate' WHEN 'pyrrhotite_impurity' THEN 'pyrrhotite' WHEN 'pyrite' THEN 'pyrite' END"
FINE_SQL = "CASE WHEN size_class IN ('-10','-20 + 10') THEN 1.0 WHEN size_class IN ('+125','+71','-71 + 45') THEN 0.0 WHEN size_class='-45 + 20' THEN 0.5 END"

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def cells(spark, sf_dir):
    """Report cells made from the buckets: a header row per size class, a row per form, a total row."""
    b = V.loss_forms(spark, sf_dir)
    label = F.create_map(*[F.lit(x) for k, v in FORMS.items() for x in (v, k)])
    rows = b.groupBy("factory", "size_class", "mineral_form").agg(F.max(F.when(F.col("metal") == "Ni", F.col("tonnes"))).alias("ni"), F.max(F.when(F.col("metal") == "Cu", F.col("tonnes"))).alias("cu"))
    rows = rows.select("factory", "size_class", F.lit(1).alias("_k"), "mineral_form", label[F.col("mineral_form")].alias("c2"), F.lit(None).cast("string").alias("c4"), F.col("ni").cast("string").alias("c5"), F.coalesce(F.col("cu").cast("string"), F.lit("#REF!")).alias("c7"))
    head = b.select("factory", "size_class").distinct().select("factory", "size_class", F.lit(0).alias("_k"), F.lit("").alias("mineral_form"), F.col("size_class").alias("c2"), F.lit("Доля потерь").alias("c4"), F.lit("x").alias("c5"), F.lit("y").alias("c7"))
    total = head.select("factory", "size_class", F.lit(2).alias("_k"), "mineral_form", F.lit("Итого").alias("c2"), F.lit(None).cast("string").alias("c4"), F.lit("5").alias("c5"), F.lit("5").alias("c7"))
    every = rows.union(head).union(total)
    w = Window.partitionBy("factory").orderBy("size_class", "_k", "mineral_form")
    return every.select("factory", F.lit("s").alias("sheet"), F.row_number().over(w).alias("row_idx"), "c2", "c4", "c5", "c7")


@query("t1_top_losses", sql("loss", f"SELECT {C} FROM loss WHERE metal='Ni' ORDER BY tonnes DESC, node_id LIMIT 10"))
def t1(spark, d):
    return L.top_losses(V.loss_forms(spark, d), 10, metal="Ni").select(COLS)


@query("t1_top_per_factory", sql("loss", f"SELECT {C}, rank FROM (SELECT *, row_number() OVER (PARTITION BY factory ORDER BY tonnes DESC, node_id) AS rank FROM loss WHERE recoverable) WHERE rank<=5"))
def t1b(spark, d):
    return L.top_per_factory(V.loss_forms(spark, d), 5).select(*COLS, "rank")


@query("t2_recoverable_losses", sql("loss", f"SELECT {C} FROM loss WHERE recoverable ORDER BY tonnes DESC, node_id LIMIT 5"))
def t2(spark, d):
    return L.top_losses(V.loss_forms(spark, d), 5, recoverable=True).select(COLS)


@query("t3_top_bucket", sql("loss", f"SELECT {C} FROM loss QUALIFY row_number() OVER (PARTITION BY factory, metal ORDER BY tonnes DESC, node_id)=1"))
def t3(spark, d):
    return L.top_of_scope(V.loss_forms(spark, d), ["factory", "metal"]).select(COLS)


@query("a2_factory_breakdown", sql("loss", "SELECT factory, count(*) AS n, round(sum(tonnes),1) AS total_tonnes FROM loss GROUP BY 1"))
def a2(spark, d):
    return L.factory_breakdown(V.loss_forms(spark, d))


@query("f7_recoverable", sql("loss", "SELECT mineral_form, metal, recoverable, count(*) AS n FROM loss GROUP BY ALL"))
def f7(spark, d):
    return V.loss_forms(spark, d).groupBy("mineral_form", "metal", "recoverable").agg(F.count(F.lit(1)).alias("n"))


@query("f8_size_kinds", sql("loss", f"SELECT size_class, {V.COARSE_SQL} AS coarse, size_class='-10' AS fine, round(sum(tonnes),2) AS tonnes FROM loss GROUP BY 1,2,3"))
def f8(spark, d):
    b = V.loss_forms(spark, d).withColumn("size_raw", F.concat(F.lit("  "), "size_class", F.lit(" мкм")))
    b = b.withColumns({"coarse": L.is_coarse(F.col("size_raw")), "fine": L.is_fine(F.col("size_raw"))})
    return b.groupBy("size_class", "coarse", "fine").agg(F.round(F.sum("tonnes"), 2).alias("tonnes"))


@query("x4_size_normalize", sql("loss", "SELECT node_id, size_class FROM loss"))
def x4(spark, d):
    raw = F.concat(F.lit(" "), F.replace("size_class", F.lit(" "), F.lit("  ")), F.lit(" мкм "))
    return V.loss_forms(spark, d).select("node_id", X.normalize_size_class(raw).alias("size_class"))


@query("x3_slug", "SELECT p_partkey, " + V.slug_sql("'part'", "p_name", "p_type") + " AS slug FROM part")
def x3(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.slug(F.lit("part"), F.col("p_name"), F.col("p_type")).alias("slug"))


@query("x5_metal_header", "SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'Ni' WHEN p_size%3=1 THEN 'Cu' END AS metal FROM part")
def x5(spark, d):
    head = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Элемент 28 "), "p_name")).when(F.col("p_size") % 3 == 1, F.lit("Cu 29, т")).otherwise(F.lit("Доля"))
    return V.table(spark, d, "part").select("p_partkey", X.metal_from_header(head).alias("metal"))


@query("x21_bucket_id", sql("req", f"SELECT request_id, CASE WHEN size_class IS NOT NULL THEN {V.slug_sql(chr(39) + 'lossform' + chr(39), 'factory', 'size_class', 'mineral_form', 'metal')} END AS slot_bucket FROM req"))
def x21(spark, d):
    r = V.requests(spark, d)
    return r.select("request_id", L.bucket_id(*(F.col(c) for c in ("factory", "size_class", "mineral_form", "metal"))).alias("slot_bucket"))


@query("sc4_loss_cells", sql("loss", "SELECT factory, size_class, mineral_form, metal, tonnes FROM loss WHERE tonnes>0"))
def sc4(spark, d):
    return L.parse_cells(cells(spark, d), FORMS).select("factory", "size_class", "mineral_form", "metal", "tonnes")


PCT = "CASE WHEN rk IS NULL THEN 0.5 WHEN peers>1 THEN 1-(rk-1)/greatest(peers-1,1) WHEN tonnes>=800 THEN 1.0 WHEN tonnes>=300 THEN 0.65 WHEN tonnes>=80 THEN 0.35 ELSE 0.15 END"
RANKED = "SELECT node_id, row_number() OVER (PARTITION BY factory ORDER BY tonnes DESC, node_id) AS rk, count(*) OVER (PARTITION BY factory) AS peers FROM loss WHERE recoverable AND tonnes>0"
PCTS = f"SELECT loss.*, rk, {PCT} AS percentile FROM loss LEFT JOIN ranked USING (node_id)"


@query("w4_rank_percentile", sql("loss", "SELECT node_id, rk AS rank, round(percentile,6) AS percentile FROM pcts", ranked=RANKED, pcts=PCTS))
def w4(spark, d):
    return L.value_percentile(V.loss_forms(spark, d)).select("node_id", "rank", F.round("percentile", 6).alias("percentile"))


BASE = f"""SELECT *, CASE WHEN mineral_form='closed_pnt_cp' AND kind='coarse' THEN 'medium' WHEN mineral_form='closed_pnt_cp' AND kind='fine' THEN 'medium' WHEN mineral_form='open_pnt_cp' AND kind IS NOT NULL THEN 'low'
 WHEN mineral_form='millerite' THEN 'low' WHEN mineral_form='pyrrhotite_impurity' THEN 'high' WHEN mineral_form IN ('silicate_valleriite','pyrite') THEN 'low' ELSE 'medium' END AS base_tier,
 CASE WHEN mineral_form='closed_pnt_cp' AND kind='coarse' THEN 62.0 WHEN mineral_form='closed_pnt_cp' AND kind='fine' THEN 50.0 WHEN mineral_form='open_pnt_cp' AND kind='fine' THEN 28.0 WHEN mineral_form='open_pnt_cp' AND kind='coarse' THEN 35.0
 WHEN mineral_form='millerite' THEN 32.0 WHEN mineral_form='pyrrhotite_impurity' THEN 75.0 WHEN mineral_form='silicate_valleriite' THEN 5.0 WHEN mineral_form='pyrite' THEN 10.0 ELSE 45.0 END::DOUBLE AS base_score FROM (SELECT *, {V.SIZE_KIND_SQL} AS kind FROM pcts)"""


@query("la2_profile", sql("loss", "SELECT node_id, base_tier, base_score FROM base", ranked=RANKED, pcts=PCTS, base=BASE))
def la2(spark, d):
    return L.with_profile(V.loss_forms(spark, d)).select("node_id", "base_tier", "base_score")


SCORED = "SELECT *, round(least(100.0, 65*percentile::DOUBLE+0.35*base_score),1) AS s FROM base"
TIERS = """SELECT *, l/(l+m+h) AS pl, m/(l+m+h) AS pm, h/(l+m+h) AS ph FROM (SELECT *,
 greatest(0.0,1-s/45)+CASE WHEN base_tier='low' THEN 0.15 ELSE 0 END+CASE WHEN percentile<0.55 THEN 0.10 ELSE 0 END AS l,
 greatest(0.0,1-abs(s-50)/35)+CASE WHEN base_tier='medium' THEN 0.15 ELSE 0 END+CASE WHEN percentile>=0.55 AND percentile<0.85 THEN 0.15 ELSE 0 END AS m,
 greatest(0.0,(s-35)/65)+CASE WHEN base_tier='high' THEN 0.15 ELSE 0 END+CASE WHEN percentile>=0.85 THEN 0.25 ELSE 0 END AS h FROM scored)"""
FINAL = """SELECT node_id, recoverable, CASE WHEN recoverable THEN s ELSE 8.0 END AS budget_score, CASE WHEN recoverable THEN round(pl,3) ELSE 1.0 END AS low, CASE WHEN recoverable THEN round(pm,3) ELSE 0.0 END AS medium,
 CASE WHEN recoverable THEN round(ph,3) ELSE 0.0 END AS high FROM tiers"""
BUDGET = dict(ranked=RANKED, pcts=PCTS, base=BASE, scored=SCORED, tiers=TIERS, final=FINAL)
TIER = "CASE WHEN low>=medium AND low>=high THEN 'low' WHEN medium>=high THEN 'medium' ELSE 'high' END"


@query("la3_budget", sql("loss", f"SELECT node_id, budget_score, {TIER} AS budget_tier FROM final", **BUDGET))
def la3(spark, d):
    return L.infer_budget(V.loss_forms(spark, d)).select("node_id", "budget_score", "budget_tier")


@query("la4_tier_scores", sql("loss", "SELECT node_id, low, medium, high FROM final", **BUDGET))
def la4(spark, d):
    return L.infer_budget(V.loss_forms(spark, d)).select("node_id", "low", "medium", "high")


@query("la5_explicit_tier", sql("loss", f"SELECT node_id, CASE WHEN metal='Cu' THEN 'high' ELSE {TIER} END AS tier FROM final JOIN loss USING (node_id)", **BUDGET))
def la5(spark, d):
    b = L.infer_budget(V.loss_forms(spark, d)).withColumn("asked", F.when(F.col("metal") == "Cu", "high").otherwise("any"))
    return b.select("node_id", L.resolve_tier(F.col("asked"), F.col("budget_tier")).alias("tier"))


ROLE_SQL = f"CASE WHEN mineral_form='closed_pnt_cp' AND {V.COARSE_SQL} THEN 'Comminution' WHEN mineral_form='open_pnt_cp' AND size_class='-10' THEN 'Flotation' WHEN mineral_form='millerite' THEN 'Reagent' ELSE 'General' END"


@query("la6_agent_role", sql("loss", f"SELECT node_id, CASE WHEN tonnes>2000 THEN 'LossAttribution' ELSE {ROLE_SQL} END AS role FROM loss"))
def la6(spark, d):
    intent = F.when(F.col("tonnes") > 2000, "top_losses").otherwise("neighbors")
    return V.loss_forms(spark, d).select("node_id", L.agent_role(intent, F.col("mineral_form"), F.col("size_class")).alias("role"))


RESOLVE = f"""SELECT request_id, coalesce(bucket_id, k.node_id, fm.node_id, f.node_id, g.node_id) AS bucket,
 CASE WHEN bucket_id IS NOT NULL THEN 'explicit' WHEN k.node_id IS NOT NULL THEN 'slots' WHEN fm.node_id IS NOT NULL THEN 'top_factory_metal' WHEN f.node_id IS NOT NULL THEN 'top_factory' ELSE 'top_global' END AS method
 FROM req LEFT JOIN loss k ON k.node_id = CASE WHEN req.size_class IS NOT NULL THEN {V.slug_sql("'lossform'", 'req.factory', 'req.size_class', 'req.mineral_form', 'req.metal')} END
 LEFT JOIN (SELECT * FROM loss QUALIFY row_number() OVER (PARTITION BY factory, metal ORDER BY tonnes DESC, node_id)=1) fm ON fm.factory=req.factory AND fm.metal=req.metal
 LEFT JOIN (SELECT * FROM loss QUALIFY row_number() OVER (PARTITION BY factory ORDER BY tonnes DESC, node_id)=1) f ON f.factory=req.factory
 LEFT JOIN (SELECT * FROM loss ORDER BY tonnes DESC, node_id LIMIT 1) g ON true"""


@query("la1_resolve_bucket", sql("loss req", RESOLVE))
def la1(spark, d):
    return L.resolve_buckets(V.requests(spark, d), V.loss_forms(spark, d))


def report_input(spark, d):
    return V.loss_forms(spark, d).groupBy("mineral_form", "size_class").agg(F.sum(F.when(F.col("metal") == "Ni", F.col("tonnes")).otherwise(0.0)).alias("metal_1"), F.sum(F.when(F.col("metal") == "Cu", F.col("tonnes")).otherwise(0.0)).alias("metal_2"))


def report(spark, d):
    return L.report_rows(report_input(spark, d), F.expr(MINERAL_SQL), F.expr(FINE_SQL).cast("double"))


CELLS = "SELECT mineral_form, size_class, sum(CASE WHEN metal='Ni' THEN tonnes ELSE 0 END) AS m1, sum(CASE WHEN metal='Cu' THEN tonnes ELSE 0 END) AS m2 FROM loss GROUP BY 1,2"
BLOCKS = f"""SELECT 'mineral' AS analysis, {MINERAL_SQL} AS item, round(sum(m1),2) AS metal_1, round(sum(m2),2) AS metal_2 FROM rep WHERE {MINERAL_SQL} IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'fraction', item, round(sum(m1*w),2), round(sum(m2*w),2) FROM (SELECT 'fine' AS item, ({FINE_SQL})::DOUBLE AS w, m1, m2 FROM rep UNION ALL SELECT 'coarse', 1-({FINE_SQL})::DOUBLE, m1, m2 FROM rep) WHERE w>0 GROUP BY 2"""


@query("la9_loss_report", sql("loss", "SELECT * FROM blocks UNION ALL SELECT 'automation','automation', greatest(round(sum(metal_1)*0.05,1),50.0), greatest(round(sum(metal_2)*0.05,1),30.0) FROM blocks", rep=CELLS, blocks=BLOCKS))
def la9(spark, d):
    return report(spark, d)


@query("la10_recommendations", sql("loss", "SELECT item, metal_1, share, CASE WHEN item='silicate' AND share>20 THEN 'depress_silicates' WHEN item='pyrrhotite' AND share>10 THEN 'reject_pyrrhotite' END AS recommendation FROM (SELECT item, metal_1, round(100*metal_1/sum(metal_1) OVER (),4) AS share FROM blocks WHERE analysis='mineral')", rep=CELLS, blocks=BLOCKS))
def la10(spark, d):
    return L.recommendations(report(spark, d), [("silicate", 20, "depress_silicates"), ("pyrrhotite", 10, "reject_pyrrhotite")])


@query("a14_mineral_totals", sql("loss", "SELECT item, metal_1, metal_2 FROM blocks WHERE analysis='mineral'", rep=CELLS, blocks=BLOCKS))
def a14(spark, d):
    return report(spark, d).where("analysis = 'mineral'").select("item", "metal_1", "metal_2")


@query("a15_fraction_totals", sql("loss", "SELECT item, metal_1, metal_2 FROM blocks WHERE analysis='fraction'", rep=CELLS, blocks=BLOCKS))
def a15(spark, d):
    return report(spark, d).where("analysis = 'fraction'").select("item", "metal_1", "metal_2")


@query("a16_automation_row", sql("loss", "SELECT greatest(round(sum(metal_1)*0.05,1),50.0) AS metal_1, greatest(round(sum(metal_2)*0.05,1),30.0) AS metal_2 FROM blocks", rep=CELLS, blocks=BLOCKS))
def a16(spark, d):
    return report(spark, d).where("analysis = 'automation'").select("metal_1", "metal_2")


def reviews(spark, d):
    l = V.table(spark, d, "labels")  # noqa: E741
    q, t = F.col("quality"), 1 - F.col("toxic")
    rounds = F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("round")
    l = l.select(F.col("doc_id").alias("hypothesis_id"), q.alias("q"), t.alias("t"), rounds)
    last = F.when(F.col("round") == F.col("hypothesis_id") % 3 + 1, F.col("q")).otherwise(F.lit(0))
    return l.withColumns({"metrics": F.array(last, F.col("t"), F.col("q"), F.lit(1), F.col("t")), "verdict": F.when(F.col("t") == 0, "reject").otherwise("revise")})


REV = "SELECT doc_id AS hypothesis_id, r AS round, quality AS q, 1-toxic AS t, CASE WHEN r=doc_id%3+1 THEN quality ELSE 0 END AS lst FROM (SELECT *, unnest(range(1, doc_id%3+2)) AS r FROM labels)"


@query("la11_review_gate", sql("", "SELECT hypothesis_id, round, (lst=1 AND t=1 AND q=1) AS passed FROM rev", rev=REV))
def la11(spark, d):
    return reviews(spark, d).select("hypothesis_id", F.col("round").cast("long").alias("round"), L.gate(F.col("metrics")).alias("passed"))


@query("la12_weighted_score", sql("", "SELECT hypothesis_id, round, CASE WHEN t=0 OR q=0 THEN 0.0 ELSE round(0.5*lst+0.3*t+0.2*q,3) END::DOUBLE AS score FROM rev", rev=REV))
def la12(spark, d):
    m = lambda i: F.col("metrics")[i]
    return reviews(spark, d).select("hypothesis_id", F.col("round").cast("long").alias("round"), L.weighted_score(m(0), m(1), m(2), m(1), m(2)).cast("double").alias("score"))


OUTCOME = """SELECT hypothesis_id, coalesce(arg_min(state, round) FILTER (state IS NOT NULL), 'Max iterations exceeded') AS outcome, coalesce(min(round) FILTER (state IS NOT NULL), 2) AS round FROM (
 SELECT *, CASE WHEN lst=1 AND t=1 AND q=1 THEN 'passed' WHEN t=0 THEN 'rejected' END AS state FROM rev WHERE round<=2) GROUP BY 1"""


@query("la13_loop_outcome", sql("", OUTCOME, rev=REV))
def la13(spark, d):
    return L.loop_outcome(reviews(spark, d), 2).withColumn("round", F.col("round").cast("long"))


@query("a19_run_summary", sql("", "SELECT hypothesis_id%10 AS request, count(*) AS generated, count(*) FILTER (outcome='passed') AS passed, count(*) FILTER (outcome<>'passed') AS rejected FROM outs GROUP BY 1", rev=REV, outs=OUTCOME))
def a19(spark, d):
    o = L.loop_outcome(reviews(spark, d), 2)
    return o.groupBy((F.col("hypothesis_id") % 10).alias("request")).agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.col("outcome") != "passed").alias("rejected"))


@query("la14_feedback", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1")
def la14(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


@query("t9_history_page", "SELECT event_id, event_type, count(*) OVER () AS total FROM events WHERE event_type='purchase' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def t9(spark, d):
    e = V.table(spark, d, "events").where("event_type = 'purchase'")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    page = e.orderBy(F.desc("ts"), "event_id").offset(20).limit(20).select("event_id", "event_type")
    return page.join(F.broadcast(total), F.lit(True), "left")  # one row
