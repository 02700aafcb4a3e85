"""Mix sources to target weights.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of ``block_words`` words (the
last is shorter). A source takes as many slots as its target needs: whole passes over its blocks, then a part of one
more pass whose last slot takes only the first words of its block, so that the taken words equal the rounded target.
Within a pass, slot i reads block ``permute(i)``, a keyed permutation of the source's block numbers. Slots of all
sources are dealt to output shards of ``shard_slots`` slots by one more permutation, so a shard's counts by source
are a multinomial draw given the sources' totals; unconditioned draws would miss the targets and break the bound of
three takes.

Only DataFrame functions are used. The hot source is spread by (source, bucket) for offsets and by (source, block)
for the join; nothing groups on the source alone but sums with partial aggregation.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; repeated
rows count each; an empty table gives no rows; columns other than the three named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
CHUNK = 4096
TASK_SLOTS = 200_000
BUCKET_ROWS = 2000


@dataclass
class Mix:
    """rows: source, size and key (its place in the source's order) of each input row. sources: one row each with size,
    weight, target, passes, rest (words beyond the whole passes) and slots. slots: shard, slot, source, block and words.
    documents: one row per input row with what the mix takes of it
    and the first output shard that holds a part of it. heads: sid, key, words, and the block and the word of it (from 0) in which
    the rows of a key begin; rows without words have none."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    documents: DataFrame
    heads: DataFrame
    shard_slots: int
    seed: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permute(x: Column, n: Column, keys: list[Column], rounds: int = 8, inverse: bool = False) -> Column:
    """The image of x in 0..n-1 under a keyed swap-or-not shuffle: each round swaps x with its mirror about a keyed centre or not."""
    n = F.greatest(n, F.lit(1)).cast("long")

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(2 * r, *keys), n) - at, n)
        coin = F.xxhash64(2 * r + 1, *keys, F.greatest(at, other)).bitwiseAND(1)
        return F.when(coin == 1, other).otherwise(at)

    order = range(rounds)[:: -1 if inverse else 1]
    return F.aggregate(F.array(*map(F.lit, order)), x.cast("long"), step)


def water_fill(sources: DataFrame, cap: float) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above cap times its size, the excess reshared by weight."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    limit = F.lit(float(cap)) * F.col("source_size")
    s = sources.withColumn("_limit", limit)
    s = s.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_weights"))
    s = s.withColumn("_level", F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level")))
    level = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("target", F.coalesce(F.least(level * F.col("weight"), F.col("_limit")), F.col("_limit")))
    return s.drop("_limit", "_left", "_weights", "_level")


def plan_slots(sources: DataFrame, block_words: int, cap: float, seed: int) -> DataFrame:
    """Add blocks, passes and slots of each source; ``cut`` is the length of its last slot where that isn't a whole block."""
    L = F.lit(block_words).cast("long")
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / L).cast("long"))
    s = s.withColumn("_want", F.least(F.round("target").cast("long"), F.floor(F.lit(float(cap)) * F.col("source_size")).cast("long")))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    s = s.withColumn("rest", F.col("_want") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("_short", F.greatest(F.col("blocks") - 1, F.lit(0)).cast("long"))
    s = s.withColumn("_short", permute(F.col("_short"), F.col("blocks"), [F.col("sid"), F.col("passes"), F.lit(seed)], inverse=True))
    gap = F.col("blocks") * L - F.col("source_size")
    ahead, tail = F.col("_short") * L, L - gap
    past = F.col("rest") > ahead + tail
    inside = (F.col("rest") > ahead) & ~past
    s = s.withColumn("_last", F.when(past, F.ceil((F.col("rest") + gap) / L)).when(inside, F.col("_short") + 1).otherwise(F.ceil(F.col("rest") / L)).cast("long"))
    done = F.when(past, (F.col("_last") - 1) * L - gap).otherwise((F.col("_last") - 1) * L)
    s = s.withColumn("cut", F.when(F.col("rest") > 0, F.col("rest") - done).cast("long"))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("_last"))
    return number_slots(s.drop("_want", "_short", "_last"))


def number_slots(sources: DataFrame) -> DataFrame:
    """Add how many slots there are in all and before each source's."""
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("slots_before", F.coalesce(F.sum("slots").over(w), F.lit(0)).cast("long"))
    return s.withColumn("slots_total", F.sum("slots").over(Window.partitionBy()))


def slot_table(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: shard, slot in it, sid, block, and ``cut`` where only the block's first words are taken."""
    chunks = sources.where("slots > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK).cast("long"))))
    total = sources.agg(F.coalesce(F.max("slots_total"), F.lit(0))).first()[0]
    chunks = chunks.repartition(1 + total // TASK_SLOTS, F.col("sid"), F.col("_chunk"))  # few rows now, many after explode
    first = F.col("_chunk") * CHUNK
    s = chunks.withColumn("k", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("slots")) - 1)))
    s = s.withColumn("cut", F.when(F.col("k") == F.col("slots") - 1, F.col("cut")))
    s = s.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long")).withColumn("block", F.col("k") % F.col("blocks"))
    s = s.withColumn("block", permute(F.col("block"), F.col("blocks"), [F.col("sid"), F.col("pass"), F.lit(seed)]))
    s = s.withColumn("_at", F.col("slots_before") + F.col("k"))
    s = s.withColumn("_at", permute(F.col("_at"), F.col("slots_total"), [F.lit(seed)]))
    return s.select(F.floor(F.col("_at") / shard_slots).cast("long").alias("shard"), (F.col("_at") % shard_slots).alias("slot"), "sid", "source", "pass", "block", "cut")


def row_key(doc_id: Column, text: Column, seed: int) -> Column:
    """63 bits that put a source's rows in a pseudorandom order; rows of one id and text have one."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 1)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = 32, shard_slots: int = 8192, cap: float = 3.0, seed: int = 20) -> Mix:
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_key(F.col(doc_id), F.col(text), seed).alias("_key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("sid") - 1) % len(CYCLE) + 1))
    sources = materialize(plan_slots(water_fill(sources, cap), block_words, cap, seed))
    slots = slot_table(sources, shard_slots, seed)

    L = F.lit(block_words).cast("long")
    named = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "rows")
    d = sized.join(named, sized["source"].eqNullSafe(named["_source"])).drop("_source")
    d = d.withColumn("_bucket", F.pmod("_key", F.ceil(F.col("rows") / BUCKET_ROWS)))
    sums = d.groupBy("sid", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("sid", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(sums, ["sid", "_bucket"]).withColumn("start", F.col("_ahead") + F.col("_within"))
    d = d.withColumn("end", F.col("start") + F.col("size"))
    heads = d.where("size > 0").groupBy("sid", F.col("_key").alias("key")).agg(F.sum("size").alias("words"), F.min("start").alias("_start"))
    heads = heads.select("sid", "key", "words", F.floor(F.col("_start") / L).alias("block"), (F.col("_start") % L).alias("word"))
    cells = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / L), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / L))))
    takes = slots.groupBy("sid", "block").agg(F.count(F.when(F.col("cut").isNull(), 1)).alias("_times"), F.max("cut").alias("_cut"), F.min("shard").alias("_shard"))
    base = F.col("block") * L
    lo, hi = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("end") - base, L)
    part = F.greatest(F.least(hi, F.coalesce("_cut", F.lit(0))) - lo, F.lit(0))
    cells = cells.join(takes.hint("merge"), ["sid", "block"], "left").withColumn("_taken", F.coalesce(F.col("_times"), F.lit(0)) * (hi - lo) + part)
    documents = cells.groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.sum("_taken").alias("taken"), F.min(F.when(F.col("_taken") > 0, F.col("_shard"))).alias("first_shard"), F.count(F.lit(1)).alias("_cells"))
    # Empty rows share a start with others; each of them is a cell of its own there.
    documents = documents.withColumn("_copy", F.explode(F.when(F.col("size") == 0, F.sequence(F.lit(1).cast("long"), F.col("_cells"))).otherwise(F.array(F.lit(1).cast("long")))))
    return Mix(sized.select("source", "size", F.col("_key").alias("key")), sources, slots, documents.drop("_cells", "_copy"), heads, shard_slots, seed)


def whole_slots(mix: Mix, heads: DataFrame) -> DataFrame:
    """The slots of whole documents: each takes those that begin in its block, a source's last slot those that begin in the block's
    first ``cut`` words. After its whole passes a source goes on through its permuted blocks until they hold its ``rest`` as nearly
    as whole documents can.

    Sums by (source, bucket of slots) tell in which bucket the rest ends; only that bucket's documents are put in order.
    """
    named = mix.sources.select("sid", "blocks", "passes", "rest", F.ceil(F.col("rows") / BUCKET_ROWS).alias("_buckets"))
    place = permute(F.col("block"), F.col("blocks"), [F.col("sid"), F.col("passes"), F.lit(mix.seed)], inverse=True)
    h = heads.join(named, "sid").withColumn("_place", place)
    h = h.withColumn("_bucket", F.floor(F.col("_place") * F.col("_buckets") / F.col("blocks")).cast("long"))
    upto = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = h.groupBy("sid", "_bucket", "rest").agg(F.sum("words").alias("_sum")).withColumn("_end", F.sum("_sum").over(upto))
    ends = sums.where("_end >= rest and _end - _sum < rest").select("sid", "_bucket", (F.col("rest") - F.col("_end") + F.col("_sum")).alias("_left"))
    order = Window.partitionBy("sid").orderBy("_place", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = h.join(materialize(ends), ["sid", "_bucket"]).withColumn("_miss", F.abs(F.sum("words").over(order) - F.col("_left")))
    best = inside.groupBy("sid").agg(F.min(F.struct("_miss", "_place", "word")).alias("_best"), F.min("_place").alias("_first"), F.first("_left").alias("_left"))
    some = F.col("_left") > F.col("_best._miss")  # else the rest is met most nearly without any of the bucket
    best = best.select("sid", F.when(some, F.col("_best._place") + 1).otherwise(F.col("_first")).alias("_last"), F.when(some, F.col("_best.word") + 1).alias("cut"))
    s = mix.sources.drop("slots", "slots_before", "slots_total", "cut").join(best, "sid", "left")
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.coalesce("_last", F.lit(0))).drop("_last")
    return slot_table(materialize(number_slots(s)), mix.shard_slots, mix.seed)


def mixed_documents(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", source: str = "source", place: tuple[str, str] | None = None) -> DataFrame:
    """The documents as often as the mix takes them, in whole copies: the method's blocks, permutations and shards, but a slot takes
    the documents that begin in its block. A source misses its target by at most half its largest document (or rows of one id and
    text, which share a place). A shard's rows are in one partition, in the order of their slots. ``place``: names of two more
    columns, the shard and the slot that a copy is taken by.

    Defined results: rows without words come 0 times, as nothing can be taken from them; a null id or source is a value as
    any other; rows of one id and text come equally often; an empty table gives no rows; columns keep their names,
    whatever those are.
    """
    heads = materialize(mix.heads)
    taken = heads.join(whole_slots(mix, heads).hint("merge"), ["sid", "block"]).where("cut is null or word < cut")
    taken = taken.select(F.col("source").alias("_source"), "key", "shard", "slot", "word")
    d = docs.select(F.struct("*").alias("row"), docs[source].alias("_s"), row_key(docs[doc_id], docs[text], mix.seed).alias("_k"), docs[text].rlike(WORD).alias("_words"))
    d = d.where("_words").join(taken, d["_s"].eqNullSafe(taken["_source"]) & (d["_k"] == taken["key"]))
    d = d.repartition("shard").sortWithinPartitions("shard", "slot", "word")
    return d.select("row.*", *(F.col(c).alias(name) for c, name in zip(("shard", "slot"), place or (), strict=False)))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken", "first_shard")
