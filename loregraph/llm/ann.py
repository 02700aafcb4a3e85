"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan over column blocks.

Vectors get one more dimension, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the largest inner
product is the smallest distance. k-means on a bounded sample gives the lists; every vector is put in the nearest one.
How many of the lists nearest to a query are probed is measured, not set: at most CALIBRATION queries are answered by
brute force over all vectors, and as many lists as hold RECALL of their true neighbours on average are probed, few where the
vectors have structure, most where they have none. The FIRST of them give each query a limit, the distance of its k-th
best there; of the others, those that no ball around their centre brings within the limit are passed over.

All vectors are turned by one random orthogonal matrix. Within a probed list, distances are summed over blocks of columns, and
after each block a candidate is given up if its partial sum, scaled to all columns and relaxed by the test's error
bound (1 + EPSILON / sqrt(d))^2, exceeds the distance of the query's k-th best so far. Candidates that live through all
blocks are scored by their inner product in double precision on the original vectors.

Equal vectors are one class that carries its smallest k + 1 ids, which is all a top-k can use. Lists and the queries
that probe them are cut into blocks, so a group holds at most about BLOCK candidates and BLOCK queries.

Defined results: a vector that is null, zero, of another length than most, or holds a null or non-finite component
takes no part, as query or candidate; an id that occurs on several rows counts each row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.store import bounded_batches, materialize

SAMPLE = 20_000
MAX_LISTS = 1024
RECALL = 0.96
CALIBRATION = 128
FIRST = 2
MIN_PROBES = 12
BLOCK = 4096
COLUMNS = 16
EPSILON = 2.1
DENSE = 0.05


@dataclass
class Index:
    """What all tasks share: the largest squared norm, the rotation, the lists' rotated centres and the farthest member of each."""

    largest: float
    rotation: np.ndarray
    centres: np.ndarray
    radius: np.ndarray | None = None

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - (x**2).sum(axis=1), 0))
        return np.column_stack([x, more]) @ self.rotation


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T), 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def train(vectors: DataFrame, n: int, lists: int | None = None, seed: int = 3) -> Index:
    """k-means on about SAMPLE vectors at most, those with the smallest hash of the id."""
    largest = vectors.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    some = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < (SAMPLE << 30) // n)
    sample = _matrix(some.orderBy(F.xxhash64("cid"), "cid").select("vec").toArrow()["vec"]).astype(np.float64)
    rng = np.random.default_rng(seed)
    rotation, r = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))
    index = Index(float(largest), rotation * np.sign(np.diag(r)), np.empty((0, 0)))
    x = index.turned(sample)
    k = int(min(lists or min(MAX_LISTS, max(1, round(np.sqrt(n) / 2))), len(x)))
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(12):
        near = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    index.centres = centres
    return index


def scan(index: Index, queries: np.ndarray, cands: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that live through the adaptive scan and are among the query's k nearest here.

    limit: the squared distance of each query's k-th best elsewhere, or infinity.
    """
    q, x = index.turned(queries, query=True), index.turned(cands)
    nq, n, d = len(q), len(x), x.shape[1]
    if n > k:
        first = _distances(q, x[: max(4 * k, 64)])
        limit = np.minimum(limit, np.partition(first, k - 1, axis=1)[:, k - 1] * (1 + 1e-9))
    bound = lambda done: 1 + 1e-9 if done >= d else (1 + EPSILON / np.sqrt(done)) ** 2 * done / d
    partial, done, alive = np.zeros((nq, n)), 0, 1.0
    while done < d and alive > DENSE:  # while many pairs live, a block is one matrix product
        upto = min(done + COLUMNS, d)
        partial += _distances(q[:, done:upto], x[:, done:upto])
        done = upto
        live = partial <= (limit * bound(done))[:, None]
        alive = live.mean()
    i, j = np.nonzero(live)
    sums = partial[i, j]
    while done < d:  # then only the pairs that live are summed on
        upto = min(done + COLUMNS, d)
        sums = sums + ((x[j, done:upto] - q[i, done:upto]) ** 2).sum(axis=1)
        done = upto
        keep = sums <= limit[i] * bound(done)
        i, j, sums = i[keep], j[keep], sums[keep]
    order = np.lexsort((j, sums, i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def _place(shared):
    """Add the nearest list of each vector and the distance of its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                dist = _distances(index.turned(_matrix(batch["vec"])), index.centres)
                near = dist.argmin(axis=1)
                far = np.sqrt(dist[np.arange(len(near)), near])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    return run


def _probe(shared, probes: int):
    """One row for each list that a query probes: its place by nearness, and the least squared distance that a member can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                dist = _distances(index.turned(_matrix(batch["vec"]), query=True), index.centres)
                near = np.argsort(dist, axis=1, kind="stable")[:, :probes]
                gap = np.maximum(np.sqrt(np.take_along_axis(dist, near, axis=1)) - index.radius[near], 0) ** 2
                table = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), probes)))
                place = np.tile(np.arange(probes, dtype=np.int32), batch.num_rows)
                cols = [pa.array(near.ravel().astype(np.int32)), pa.array(place), pa.array(gap.ravel())]
                yield pa.RecordBatch.from_arrays([*table.columns, *cols], [*batch.schema.names, "list", "place", "gap"])

    return run


def measured_probes(index: Index, placed: DataFrame, groups: DataFrame, k: int, recall: float) -> int:
    """The number of nearest lists that hold ``recall`` of the true neighbours of CALIBRATION queries, found by brute force."""
    lists = len(index.centres)
    if lists <= MIN_PROBES:
        return lists
    n = groups.count()
    some = groups if n <= CALIBRATION else groups.where(F.pmod(F.xxhash64("qc"), F.lit(1 << 30)) < (CALIBRATION << 30) // n)
    asked = _matrix(some.select("vec").toArrow()["vec"]).astype(np.float64)
    if not len(asked):
        return lists
    shared = placed.sparkSession.sparkContext.broadcast(asked)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["vec"]).astype(np.float64)
                score = shared.value @ x.T
                score[_distances(shared.value, x) <= 1e-9 * (shared.value**2).sum(axis=1)[:, None]] = -np.inf  # itself
                top = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(top)), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), batch["list"].take(pa.array(j)), pa.array(score[i, j])], ["query", "list", "score"])

    found = placed.select("vec", "list").mapInArrow(best, "query int, list int, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    true = found.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("query", "list").count().toPandas()
    order = np.argsort(_distances(index.turned(asked, query=True), index.centres), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    hits = np.bincount(place[true["query"], true["list"]], true["count"], minlength=lists)
    enough = int(np.searchsorted(np.cumsum(hits), recall * hits.sum())) + 1
    return min(lists, max(MIN_PROBES, enough))


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    usual = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where((F.size("vec") == (usual["n"] if usual else 0)) & finite & F.exists("vec", lambda x: x != 0))


@dataclass
class Lists:
    """The built index: what tasks share, vectors with their list, and the number of lists to probe."""

    index: Index
    placed: DataFrame
    probes: int


def build_lists(cands: DataFrame, groups: DataFrame, k: int, recall: float = RECALL, lists: int | None = None) -> Lists:
    """cands: vec, ids, cid. groups: vec, qc of the queries, of which some set the number of probes."""
    index = train(cands, cands.count(), lists)
    shared = cands.sparkSession.sparkContext.broadcast(index)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cands.schema)
    placed = materialize(cands.mapInArrow(_place(shared), f"{kinds}, list int, far double"))
    index.radius = np.zeros(len(index.centres))
    for row in placed.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row for each list
        index.radius[row["list"]] = row["far"] * (1 + 1e-9)
    return Lists(index, placed, measured_probes(index, placed, groups, k, recall))


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row for which ``is_query(id column)`` holds."""
    bounded_batches(vectors.sparkSession)
    v = materialize(valid_vectors(vectors, vec_id, embedding))
    kind = v.schema["id"].dataType.simpleString()
    least = Window.partitionBy("vec").orderBy("id")
    ids = v.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k + 1)
    cands = materialize(ids.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0]))
    asked = materialize(v.where(is_query(F.col("id"))))
    groups = materialize(asked.groupBy("vec").agg(F.min("id").alias("qc")))
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if groups.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    built = build_lists(cands, groups, k, recall, lists)
    shared = vectors.sparkSession.sparkContext.broadcast(built.index)
    probing = materialize(groups.mapInArrow(_probe(shared, built.probes), f"vec array<float>, qc {kind}, list int, place int, gap double"))
    best = Window.partitionBy("qc").orderBy(F.desc("score"), F.col("ids")[0])

    def hits_of(part: DataFrame) -> DataFrame:
        hits = _search(part, built.placed, shared, k + 1)
        return materialize(hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1))

    first = hits_of(probing.where(F.col("place") < FIRST).withColumn("limit", F.lit(float("inf"))))
    # The k + 1 best by score: a query may be one of them itself.
    limits = first.where(F.col("_r") == k + 1).select("qc", F.col("score").alias("_kth"))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rest = probing.where(F.col("place") >= FIRST).join(limits, "qc", "left")
    rest = rest.withColumn("limit", F.coalesce((squares + built.index.largest - 2 * F.col("_kth")) * (1 + 1e-6) + 1e-9, F.lit(float("inf")))).drop("_kth")
    hits = first.union(hits_of(rest.where("gap <= limit")))
    hits = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    hits = materialize(hits.groupBy("qc").agg(F.collect_list(F.struct("score", "ids")).alias("hits")))
    named = asked.join(groups.hint("merge"), "vec").select(F.col("id").alias("query_id"), "qc")
    found = materialize(named).join(hits, "qc").select("query_id", F.explode("hits").alias("h"))
    found = found.select("query_id", F.col("h.score").alias("score"), F.explode("h.ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(probing: DataFrame, placed: DataFrame, shared, k: int) -> DataFrame:
    """qc, ids and score of the k best of each query in each list that it probes (vec, qc, list, limit)."""
    kind = probing.schema["qc"].dataType.simpleString()
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = materialize(blocks(placed, "c_blocks").join(blocks(probing, "q_blocks"), "list"))  # a row for each list at most
    every = lambda col: F.explode(F.sequence(F.lit(0), F.col(col) - 1))
    left = probing.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("qc"), "q_blocks").cast("int").alias("q_block"), every("c_blocks").alias("c_block"), "qc", "vec", "limit")
    right = placed.join(F.broadcast(sizes), "list").select("list", every("q_blocks").alias("q_block"), F.pmod(F.xxhash64("cid"), "c_blocks").cast("int").alias("c_block"), "ids", "vec")

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["qc", "ids", "score"]
        queries, rows = _matrix(asked["vec"]), _matrix(there["vec"])
        if not len(queries) or not len(rows):
            return pa.table([pa.array([], asked.schema.field("qc").type), pa.array([], there.schema.field("ids").type), pa.array([], pa.float64())], names)
        i, j = scan(shared.value, queries, rows, k, asked["limit"].to_numpy().copy())
        score = (queries[i].astype(np.float64) * rows[j].astype(np.float64)).sum(axis=1)
        return pa.table([asked["qc"].take(pa.array(i)), there["ids"].take(pa.array(j)), pa.array(score)], names)

    key = ["list", "q_block", "c_block"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(search, f"qc {kind}, ids array<{kind}>, score double")


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
