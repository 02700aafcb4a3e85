"""Vector compression to codes: each of PARTS parts of a vector becomes the number of its nearest codebook entry, by exact integers.

Components are fixed-point integers. Nearest entries come from one matrix product of a batch's parts with the codebook: integers are broken into
limbs so small that every sum of limb products stays below 2^53 and float64 BLAS gives it exactly; the products are put
together in 64-bit integers, which are exact modulo 2^64, and so are squared distances, which fit. The first smallest wins.

A round is one job: a task adds up the parts of each entry over all its batches and passes on one row for each entry it used; the driver gets
the sums, as many as the codebooks have entries, and sends the new codebooks out. Results don't depend on how rows lie in tasks.

Defined results: a vector that is null, empty, of another length than most, or holds a null or non-finite component takes no
part; null ids come last and rows of equal ids by vector where the first entries are chosen, and each row is coded; null
labels are one group; fewer vectors than entries give as many entries; a length that PARTS doesn't divide is cut as evenly as it can be;
an empty table gives no rows. Components so large that a squared distance may not fit a long raise an error.
Texts play no part, nor do other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import bounded_batches, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 4096


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of integers, least first: all but the last from 0 to 2^bits, the last signed and as small."""
    out = []
    while x.size and (x.max() >= 1 << bits or x.min() < -(1 << bits)):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact modulo 2^64."""
    bits = (53 - max(0, a.shape[1] - 1).bit_length()) // 2
    right = limbs(b, bits)
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the first, and its squared distance."""
    far = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


@dataclass
class Codebooks:
    """The entries of each part, (entries, components) each."""

    books: list[np.ndarray]
    scale: int

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def integers(self, column: pa.Array) -> np.ndarray:
        return fixed_point(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), self.scale)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def fixed_point(x: np.ndarray, scale: int) -> np.ndarray:
    y = np.floor(x.astype(np.float64) * scale)
    width = max(1, y.shape[1])
    if y.size and 4 * width * float(np.abs(y).max()) ** 2 >= 2.0**63:
        raise ValueError("components too large: a squared distance may not fit a long")
    return y.astype(np.int64)


def _sums(shared):
    """part, entry, how many parts it is nearest to, and their sum by component: a row for each entry that a task has used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codebooks = shared.value
        edges = codes.edges
        counts = [np.zeros(len(b), np.int64) for b in codes.books]
        sums = [np.zeros_like(b) for b in codes.books]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = codes.integers(batch["vec"].slice(lo, ROWS))
                for p, book in enumerate(codes.books):
                    own = x[:, edges[p] : edges[p + 1]]
                    at, _ = nearest(own, book)
                    counts[p] += np.bincount(at, minlength=len(book))
                    np.add.at(sums[p], at, own)
        used = [(p, e) for p, n in enumerate(counts) for e in np.flatnonzero(n).tolist()]
        wide = max(b.shape[1] for b in codes.books)
        totals = [sums[p][e].tolist() + [0] * (wide - sums[p].shape[1]) for p, e in used]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(counts[p][e]) for p, e in used], pa.int64()), pa.array(totals, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codebooks = shared.value
        edges = codes.edges
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x = codes.integers(batch["vec"])
                out, error = np.zeros((len(x), len(codes.books)), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(codes.books):
                    out[:, p], own = nearest(x[:, edges[p] : edges[p + 1]], book)
                    error += own
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([r.tobytes().hex() for r in out], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from the vectors of the smallest ids, moved ``rounds`` times to the floors of the means of what is nearest to them."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    sc = vectors.sparkSession.sparkContext
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    x = fixed_point(np.array([r["vec"] for r in first], np.float64), scale)
    cut = [x.shape[1] * p // parts for p in range(parts + 1)]
    codes = Codebooks([x[:, lo:hi].copy() for lo, hi in zip(cut[:-1], cut[1:], strict=True)], scale)
    wide = max(b.shape[1] for b in codes.books)
    for _ in range(rounds):
        part = vectors.select("vec").mapInArrow(_sums(sc.broadcast(codes)), "part int, entry int, n long, sums array<long>")
        total = part.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(wide))).alias("sums"))
        books = [b.copy() for b in codes.books]
        for r in total.collect():  # at most parts x entries rows
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"][: books[r["part"]].shape[1]]]
        codes = Codebooks(books, scale)
    return codes


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and vec of the vectors that take part."""
    v = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    v = v.where((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return v


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code and error (the squared distance to the coded vector) of each vector; the codebooks, None without vectors)."""
    bounded_batches(rows.sparkSession)
    v = materialize(usable(rows, vec_id, vector, label))
    most = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if most is None:
        return rows.sparkSession.createDataFrame([], schema), None
    v = v.where(F.size("vec") == most["d"])
    codes = train(v, parts, entries, rounds, scale)
    return v.mapInArrow(_codes(rows.sparkSession.sparkContext.broadcast(codes)), schema), codes


def op13_codes(spark, sf_dir: str) -> DataFrame:
    out, codes = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = materialize(out)
    labels = materialize(out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = out.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest() if codes else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    nearest = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    kept = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM kept),
parts AS MATERIALIZED (SELECT r, p, v[len(v) // {PARTS} * p + 1 : len(v) // {PARTS} * (p + 1)] AS v FROM numbered, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, v FROM parts WHERE r < {ENTRIES})"""
    for i in range(ROUNDS + 1):
        kept += f""",
a{i} AS MATERIALIZED (SELECT r, p.p, min(({nearest}, e)) AS m FROM parts p JOIN b{i} b ON p.p = b.p GROUP BY r, p.p)"""
        if i < ROUNDS:
            kept += f""",
s{i} AS (SELECT p, e, list(x ORDER BY c) AS v FROM (
    SELECT p, e, c, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM (SELECT a.p, a.m[2] AS e, unnest(range(len(q.v))) AS c, unnest(q.v) AS x FROM a{i} a JOIN parts q USING (r, p)) GROUP BY p, e, c) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{i} b LEFT JOIN s{i} s USING (p, e))"""
    return kept + f""",
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN numbered USING (r) JOIN book ON true"""


OP13_SQL = _sql()
