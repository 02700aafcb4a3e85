"""A postings index kept current by batches of chunks, for streams of queries: segments that are never changed, and their merging.

A batch becomes one segment: its postings by bucket of the term, its chunks with their terms by bucket of the id, how much it changes the
document frequency of each term, and the chunks that it replaces. A chunk's older postings count no more as soon as a later segment replaces
it; as its old terms are on record, frequencies and averages stay exact without going over the corpus. Small segments next to each
other are merged when there are more than SEGMENTS.

A query batch reads statistics and the buckets of its own terms. Texts are split once, when they come in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions.text import tokenize
from loregraph.operators import retrieval as R
from loregraph.store import stored
from loregraph.streaming.ledger import BUCKETS, Change, Ledger

SEGMENTS = 8
TABLES = ("postings", "forward", "terms", "replaced")
_bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _part(segment: int, bucket=None) -> Column:
    return F.lit(f"{segment:012d}") if bucket is None else F.concat(F.lit(f"{segment:012d}-"), bucket)


def _parts(change: Change, table: str, segments: set[int] | None = None, buckets: set[int] | None = None) -> list[str]:
    return [p for p in change.parts(table) if (segments is None or int(p[:12]) in segments) and (buckets is None or "-" not in p or int(p[13:]) in buckets)]


def _write(change: Change, segment: int, forward: DataFrame, replaced: DataFrame, terms: DataFrame, replaces: dict[str, list[str]]) -> None:
    """Stage a segment; forward: chunk_id, dl, tf (map of terms)."""
    at = F.lit(segment).cast("long").alias("segment")
    post = forward.select("chunk_id", F.explode("tf").alias("term", "tf"), "dl", at)
    change.put("postings", post.withColumn("part", _part(segment, _bucket("term"))).repartition("part").sortWithinPartitions("part", "term"), replaces.get("postings", ()))
    change.put("forward", forward.select("chunk_id", "dl", "tf", at).withColumn("part", _part(segment, _bucket("chunk_id"))).repartition("part"), replaces.get("forward", ()))
    change.put("terms", terms.where("df <> 0").select("term", "df").withColumn("part", _part(segment)), replaces.get("terms", ()))
    change.put("replaced", replaced.select("chunk_id", at).withColumn("part", _part(segment)), replaces.get("replaced", ()))


def _alive(rows: DataFrame, change: Change) -> DataFrame:
    """Rows (chunk_id, segment, ...) that no later segment replaces."""
    gone = change.read("replaced")
    if gone is None:
        return rows
    last = gone.groupBy("chunk_id").agg(F.max("segment").alias("_last"))
    return rows.join(last, "chunk_id", "left").where("_last is null or segment >= _last").drop("_last")


def add_chunks(change: Change, chunks: DataFrame) -> None:
    """Stage a batch of chunks (chunk_id, text), each id once, as the next segment; a null text takes its chunk out."""
    batch = stored(chunks.select("chunk_id", "text"))
    touched = {r[0] for r in batch.select(_bucket("chunk_id")).distinct().collect()}  # at most BUCKETS
    if not touched:
        return
    segment = 1 + max((int(s) for s in change.facts.get("segments", {})), default=0)
    words = batch.where("text is not null").select("chunk_id", tokenize(F.col("text")).alias("_t")).select("chunk_id", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
    count = words.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = F.map_from_entries(F.filter(F.collect_list(F.struct("term", "tf")), lambda x: x["term"].isNotNull()))
    forward = stored(count.groupBy("chunk_id", "dl").agg(tf.alias("tf")))
    old = change.read("forward", _parts(change, "forward", buckets=touched))
    if old is None:
        old = forward.limit(0).withColumn("segment", F.lit(0).cast("long"))
    else:
        old = _alive(old.join(batch.select("chunk_id"), "chunk_id", "left_semi"), change)
    old = stored(old)
    delta = forward.select(F.explode(F.map_keys("tf")).alias("term"), F.lit(1).alias("d")).union(old.select(F.explode(F.map_keys("tf")), F.lit(-1)))
    _write(change, segment, forward, old.select("chunk_id"), delta.groupBy("term").agg(F.sum("d").alias("df")), {})
    new, gone = (x.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first() for x in (forward, old))
    own = {"n": new[0] - gone[0], "tokens": int(new[1] - gone[1]), "rows": new[0]}
    change.facts["segments"] = change.facts.get("segments", {}) | {str(segment): own}


def merge(ledger: Ledger, most: int = SEGMENTS) -> bool:
    """Merge the newest segments into one if there are more than ``most``: those that are no larger than twice the sum of the newer ones."""
    if len(ledger.state()["facts"].get("segments", {})) <= most:
        return False

    def make(change: Change) -> None:
        facts = change.facts["segments"]
        order = sorted(map(int, facts), reverse=True)
        group, total = order[:2], sum(facts[str(s)]["rows"] for s in order[:2])
        for s in order[2:]:
            if facts[str(s)]["rows"] > 2 * total and len(order) - len(group) < most:
                break
            group.append(s)
            total += facts[str(s)]["rows"]
        own, into = set(group), max(group)
        read = lambda t: change.read(t, _parts(change, t, own))
        forward = stored(_alive(read("forward"), change).drop("segment"))
        terms = read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        replaced = read("replaced").select("chunk_id").distinct()
        if len(own) == len(order):
            replaced = replaced.limit(0)  # nothing older is left to be replaced
        _write(change, into, forward, replaced, terms, {t: _parts(change, t, own) for t in TABLES})
        sums = {k: sum(facts[str(s)][k] for s in group) for k in ("n", "tokens")} | {"rows": forward.count()}
        change.facts["segments"] = {k: v for k, v in facts.items() if int(k) not in own} | {str(into): sums}

    ledger.transact(make)
    return True


@dataclass
class Corpus:
    """What ranking needs to know of an indexed corpus: term frequencies (term, df) and one row (n, avgdl)."""

    df: DataFrame
    stats: DataFrame


def corpus(change: Change) -> Corpus | None:
    """The index as the change sees it; None if it is empty."""
    facts = change.facts.get("segments", {}).values()
    n, tokens = (sum(f[k] for f in facts) for k in ("n", "tokens"))
    if not n:
        return None
    df = change.read("terms").groupBy("term").agg(F.sum("df").cast("long").alias("df")).where("df > 0")
    stats = change.ledger.spark.createDataFrame([(n, tokens / n)], "n long, avgdl double")
    return Corpus(df, stats)


def indexed_search(queries: DataFrame, change: Change, k: int) -> DataFrame | None:
    """Hybrid search of queries (query_id, text) in the index as ``change`` sees it: query_id, chunk_id, score, rank; None while it is empty."""
    own = corpus(change)
    if own is None:
        return None
    asked = stored(R.tokens(queries, "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    buckets = {r[0] for r in asked.select(_bucket("term")).distinct().collect()}  # at most BUCKETS
    near = _alive(change.read("postings", _parts(change, "postings", buckets=buckets)), change).select("chunk_id", "term", "tf", "dl")
    bm25 = R.bm25_topk(queries, None, k, near, stats=own.stats, df=own.df)
    voc = stored(R.tfidf_vocabulary(None, own.stats, df=own.df))
    used = {r[0] for r in voc.select(_bucket("term")).distinct().collect()}  # at most BUCKETS
    common = _alive(change.read("postings", _parts(change, "postings", buckets=used)), change)
    dense = R.sparse_topk(R.tfidf_vectors(queries, voc, "query_id"), R.tfidf_vectors(common.select("chunk_id", "term", "tf"), voc, "chunk_id"), k)
    both = bm25.select("query_id", "chunk_id", "rank", F.lit("bm25").alias("channel"), F.lit(1.0).alias("weight"))
    return R.top_k(R.weighted_rrf(both.union(dense.select("query_id", "chunk_id", "rank", F.lit("dense"), F.lit(1.0)))), k)
