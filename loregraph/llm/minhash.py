"""Near duplicates by MinHash with tensored banding; candidates are verified on full shingle sets.

Rows of equal shingle sets are one set. Two collections of m bands each, of ROWS_PER_BAND minhashes a band, are worked out for each set:
2 * m * ROWS_PER_BAND minhashes. A table's key is a pair of a band of the first and a band of the second collection, so there are m * m tables of
twice as many minhashes a key; m follows from the similarity asked for and the chance MISS that a pair of just that similarity
meets in no table.

Tables are never built whole. Two sets meet in some table if they share a band of each collection; so bands that one set alone has
are left out, and of bands (and then of pairs of bands) that have the very same sets one is kept, as those
pair the same sets. Of a group of near copies that is one pair of bands, not hundreds.

A bucket is dealt into blocks of BLOCK sets, and each pair of its blocks is a task's group: however large a bucket, no group
is larger; texts stay where they are. There, parities of shingles (whose difference bounds that of the sets from below) rule out what can't link, and what
is left joins sets to clusters. Only the texts of sets in clusters are moved, once. A cluster is verified in blocks of full sets: each block by itself and with the cluster's
first, which settles clusters of near copies; then, only where a cluster isn't one component yet, the blocks of sets
outside its largest component with all of its blocks. So a link between different texts is missed only if its sets meet in no table.

Defined results: a row without words or text has no shingles, links with nothing and is its own component; texts are taken whole,
those longer than a segment by themselves; repeated rows and ids are rows of one set; a null id is left out of the smallest ids, so that a
component without any has null and a row of null id is kept only there; an empty table gives no rows; columns of
other names than the id's and the text's play no part. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.components import components
from loregraph.llm.corpus import keyed, texts_of
from loregraph.llm.ngram_join import _open, close_pairs, parity_bits
from loregraph.llm.store import materialize
from loregraph.llm.words import U64, mix, odd_constants, segments, shingle_sets

ROWS_PER_BAND = 3
MISS = 1e-6
#: Sets of one side of a pair of blocks: of a bucket, and of a cluster (with their texts).
BLOCK, GROUP = 2048, 128


def bands(percent: int, miss: float = MISS, rows: int = ROWS_PER_BAND) -> int:
    """Bands of each collection, so that a pair at the threshold has a common one in both with a chance of 1 - miss."""
    return max(1, ceil(log(miss / 2) / log(1 - (percent / 100) ** rows)))


def band_hashes(values: np.ndarray, bounds: np.ndarray, m: int, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """(sets, 2 * m) hashes of the bands of sets of shingles values[bounds[i] : bounds[i + 1]], none of them empty."""
    out = np.zeros((len(bounds) - 1, 2 * m), U64)
    for i, c in enumerate(odd_constants(2 * m * rows, 47)):
        band = i // rows
        low = np.minimum.reduceat((values ^ c) * c, bounds[:-1])
        out[:, band] = mix(out[:, band] ^ low) + U64(band + 1)
    return mix(out)


def _sketches(k: int, percent: int, m: int):
    """Each row's number of shingles n, hash f1 of its set, smallest shingle low, parities bits, and bands; the lowest bit of a band is its collection."""
    side = np.repeat([U64(0), U64(1)], m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in segments(batch["text"]):
                values, bounds = shingle_sets(s.hashes(lower=True), s.bounds, k, 21)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sums = np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(1)), dtype=U64)])
                f1 = mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
                low = values[np.where(n > 0, bounds[:-1], 0)].view(np.int64) if len(values) else np.zeros(len(n), np.int64)
                own = band_hashes(values, np.append(bounds[some], bounds[-1]), m) if len(some) else np.empty((0, 2 * m), U64)
                own = ((own & ~U64(1)) | side).view(np.int64)
                edges = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * m, 0))]).astype(np.int32)
                bits = [parity_bits(values[bounds[r] : bounds[r + 1]], percent) if n[r] else b"" for r in range(len(n))]
                ids = [batch[c].slice(s.lo, s.hi - s.lo) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (n, f1, low)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(own.ravel()))], ["doc_id", "k1", "k2", "n", "f1", "low", "bits", "bands"])

    return run


def _distinct(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that several sets have, one of those with the very same sets; rows (key, f1), no row twice."""
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("f1")).alias("own"))
    return materialize(held.where("n > 1").groupBy("n", "own", F.col(key).bitwiseAND(F.lit(1))).agg(F.min(key).alias(key)).select(key, "n"))


def buckets(sets: DataFrame) -> DataFrame:
    """(key, n, f1): the buckets of several sets, of f1 each, that the tables hold, and their sizes.

    Joins are by sorting at any size: a bucket's rows can then be split, and the plan of a large table is that of a small one.
    """
    halves = sets.select("f1", F.explode("bands").alias("band"))
    chosen = halves.join(_distinct(halves, "band").select("band").hint("merge"), "band")
    own = lambda side: F.collect_list(F.when(F.col("band").bitwiseAND(F.lit(1)) == side, F.col("band")))
    pairs = chosen.groupBy("f1").agg(own(0).alias("first"), own(1).alias("second"))  # at most m bands each
    keys = pairs.select("f1", F.explode("first").alias("_a"), "second").select("f1", F.explode("second").alias("_b"), "_a").select("f1", F.shiftleft(F.xxhash64("_a", "_b"), 1).alias("key"))
    keys = materialize(keys)
    return keys.join(_distinct(keys, "key").hint("merge"), "key").select("key", "n", "f1")


def _near(percent: int):
    """Rows (look, f1, n, bits) in order of look -> edges (u, v) of sets that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held = None, ([], [], [])

        def close() -> pa.RecordBatch:
            found = close_pairs(*held, percent) if len(held[0]) > 1 else []
            for part in held:
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for t, *row in zip(*(batch[c].to_pylist() for c in ("look", "f1", "n", "bits")), strict=True):
                if t != look:
                    yield close()
                    look = t
                for part, x in zip(held, row, strict=True):
                    part.append(x)
        yield close()

    return run


def _looks(blocks: str, at: str) -> Column:
    """The pairs of blocks (lo, hi) that a row of block ``at`` of ``blocks`` takes part in; one alone is a pair with itself."""
    every = F.sequence(F.lit(0), F.col(blocks) - 1)
    other = F.transform(every, lambda x: F.struct(F.least(x, F.col(at)).alias("lo"), F.greatest(x, F.col(at)).alias("hi")))
    return F.when(F.col(blocks) == 1, other).otherwise(F.filter(other, lambda p: p["lo"] != p["hi"]))


def clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(f1, root) of sets that meet in a bucket and that parities don't rule out, directly or through others."""
    dealt = buckets(sets).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("f1", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.select("f1", "key", F.explode(_looks("blocks", "at")).alias("p")).select("f1", F.xxhash64("key", "p.lo", "p.hi").alias("look"))
    held = materialize(dealt).join(sets.select("f1", "n", "bits").hint("merge"), "f1").select("look", "f1", "n", "bits")
    near = held.repartition("look").sortWithinPartitions("look").mapInArrow(_near(percent), "u long, v long")
    return components(near).withColumnRenamed("node", "f1")


def _verify(sets_in: DataFrame, looks: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Edges (u, v) that join what links within blocks a, or between blocks a and b, of ``looks``; sets_in: sets with their block."""
    looks = looks.withColumn("look", F.xxhash64("a", "b"))
    cols = ["look", "f1", "copies", "gid", "packed"]
    left = looks.join(sets_in, looks["a"] == sets_in["block"]).select(cols)
    right = looks.where("b is not null").join(sets_in, F.col("b") == sets_in["block"]).select(cols).toDF(*(f"{c}_b" for c in cols))
    found = left.groupBy("look").cogroup(right.groupBy("look_b")).applyInArrow(_open(n_words, percent), "u long, v long, links long")
    return materialize(found.where("u <> v").select("u", "v"))


def linked_sets(sets: DataFrame, near: DataFrame, texts, n_words: int, percent: int) -> DataFrame:
    """(f1, root) of the components of the links within the clusters ``near`` (f1, root).

    texts: gives the rows of a table of sets with their packed text; asked once, for the sets in clusters.
    """
    near = materialize(near)
    count = near.count()
    block = lambda at, kind=0: F.xxhash64("cluster", at, F.lit(kind))
    sizes = materialize(near.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks")), count)
    where = near.join(sizes, near["root"] == sizes["cluster"]).select("f1", "cluster", "blocks", block(F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")).alias("block"))
    sets_in = materialize(texts(materialize(sets.select("f1", "copies", "gid", "k1", "k2", "rep").join(materialize(where, count), "f1"))))
    each = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    nothing = F.lit(None).cast("long")
    first = each.select(block(F.col("x")).alias("a"), nothing.alias("b")).union(each.where("x > 0").select(block(F.lit(0)), block(F.col("x"))))
    edges = _verify(sets_in, materialize(first, count), n_words, percent)

    # Clusters of several blocks that the first links don't make one component.
    roots = materialize(components(edges), count)
    own = sets_in.where("blocks > 1").select("f1", "cluster", "blocks").join(roots, F.col("f1") == F.col("node"), "left").select("f1", "cluster", "blocks", F.coalesce("root", "f1").alias("root"))
    own = materialize(own, count)
    parts = own.groupBy("cluster", "blocks", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("cluster", "blocks").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("out")).where("out > 0")
    main = materialize(main.withColumn("outs", F.ceil(F.col("out") / GROUP).cast("int")), count)
    if main.isEmpty():
        return roots.withColumnRenamed("node", "f1")
    stray = own.join(main.select("cluster", "main", "outs"), "cluster").where("root <> main").select("f1", block(F.pmod(F.xxhash64("f1", F.lit(5)), F.col("outs")).cast("int"), 1).alias("block"))
    strays = sets_in.select("f1", "copies", "gid", "packed").join(materialize(stray, count), "f1")
    pairs = main.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cross = pairs.select(block(F.col("x"), 1).alias("a"), block(F.col("y")).alias("b"))
    every = sets_in.select("f1", "copies", "gid", "packed", "block").unionByName(strays)
    more = _verify(every, materialize(cross, count), n_words, percent)
    return components(edges.union(more)).withColumnRenamed("node", "f1")


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, miss: float = MISS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (the row of that id) of each row."""
    k = keyed(docs, doc_id, text)
    kind = k.schema["doc_id"].dataType.simpleString()
    rows = materialize(k.select("doc_id", "text", "k1", "k2").mapInArrow(_sketches(n_words, percent, bands(percent, miss)), f"doc_id {kind}, k1 long, k2 long, n long, f1 long, low long, bits binary, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "bits", "bands"))  # null ids last
    sets = rows.where("n > 0").groupBy("f1", "n", "low").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), first.alias("_rep"))
    sets = materialize(sets.select("f1", "n", "copies", "least", F.col("_rep.doc_id").alias("rep"), "_rep.k1", "_rep.k2", F.xxhash64("low", F.floor(F.log("n"))).alias("gid"), "_rep.bits", "_rep.bands"))
    twice = not rows.groupBy("doc_id", "k1", "k2").count().where("count > 1").isEmpty()

    def texts(wanted: DataFrame) -> DataFrame:
        out = texts_of(k, wanted.hint("merge"))
        return out.dropDuplicates(["f1"]) if twice else out  # a row that is there twice is read twice

    roots = linked_sets(sets, clusters(sets, percent), texts, n_words, percent)
    known = sets.select("f1", "least").join(materialize(roots), "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    known = materialize(known)
    known = known.join(materialize(known.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("f1", "component_id")
    some = rows.where("n > 0").join(materialize(known), "f1").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    every = some.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def components_sql(n_words: int, percent: int) -> str:
    """doc_id, n_shingles, component_id and n_links by a join on shingles and recursion over links."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n_words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(len(w) - {n_words - 1}), lambda i: array_to_string(w[i + 1 : i + {n_words}], ' '))) END AS s FROM w),
sized AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM shingles),
flat AS MATERIALIZED (SELECT r, unnest(s) AS t FROM shingles),
both_have AS (SELECT a.r AS u, b.r AS v, count(*) AS k FROM flat a JOIN flat b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT u, v FROM both_have JOIN sized x ON x.r = u JOIN sized y ON y.r = v WHERE 100 * k >= {percent} * (x.n + y.n - k)),
either AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT r, r AS o FROM sized UNION SELECT r, v FROM reach JOIN either ON u = o),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN sized d ON d.r = o GROUP BY reach.r)
SELECT doc_id, n AS n_shingles, component_id, coalesce(c, 0) AS n_links FROM sized JOIN least USING (r) LEFT JOIN (SELECT u AS r, count(*) AS c FROM either GROUP BY u) USING (r)"""


OP1_SQL = components_sql(3, 90)
OP11_SQL = f"SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({components_sql(5, 85)})"
