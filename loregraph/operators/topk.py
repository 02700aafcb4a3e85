"""The k best chunks of each query of a table, by sparse or stored vectors: a running top-k in each task, with bounds and filters.

A pair of a query and a chunk is never a row. Queries go to all tasks in blocks of bounded size; a task keeps the k best chunks of each
query over all that it reads and gives them out once, at its end: at most queries x k rows leave it, however many chunks it has.

Sparse chunks are gone through in blocks. The largest weight of each term in a block bounds the score that any of its chunks can
reach for a query; queries whose bound doesn't reach their k-th best so far are left out of the block. In each Arrow batch chunks of large weights
come first, so that the k-th best is soon high and the blocks after it are passed over; whole partitions aren't sorted.

Filters: columns that queries and chunks share, of FILTERS; null on the query's side asks for nothing. A chunk that a filter rules out
doesn't take a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loregraph.store import stored

#: Filter columns; True: a chunk without a value passes too.
FILTERS = {"factory": True, "external": False, "chunk_type": False}
QUERY_TERMS, QUERY_BLOCK = 200_000, 65_536
#: Chunks of a block, and cells of a score matrix.
BLOCK, SCORES = 1024, 4_000_000
STEP = 512
#: Cells of a product of matrices that take as long as a pair of a query and a chunk with a common term.
PAIR = 300
ROUNDED = 1e-6


def top_k(scores: DataFrame, k: int, query: str | list[str] = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best of each query, ties to the smaller id; scores are rounded first so that ties are ties."""
    s = scores.withColumn("score", F.round("score", 6)).where("score > 0")
    w = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by chunk over the shuffle partitions; Spark may join small ones."""
    return rows.repartition("chunk_id")


class Best:
    """The k best hits of each of n queries so far (higher score, then smaller id) in memory of a few times n x k."""

    def __init__(self, n: int, k: int, kind: pa.DataType) -> None:
        self.n, self.k = n, k
        self.limit = np.zeros(n)  # the score that a hit must reach; 0 while there are fewer than k
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), pa.array([], kind)
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Hits of queries (numbers); those below their query's limit are left out."""
        good = score >= self.limit[query]
        if good.any():
            self.waiting.append((query[good], score[good], ids.filter(pa.array(good))))
            self.size += len(self.waiting[-1][0])
        if self.size > max(len(self.query), 1 << 16):
            self.merge()

    def offer(self, who: np.ndarray, s: np.ndarray, rows: pa.RecordBatch, checks: Checks) -> None:
        """Take the scores (queries ``who``, rows) that pass the filters and can be among the k best."""
        if (ok := checks.passing(who, rows)) is not None:
            s = np.where(ok, s, 0)
        good = s >= np.maximum(self.limit[who], ROUNDED)[:, None]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > self.k)
        if len(many):  # what is below the k-th best of these rows alone can't count; equals stay, as ids decide
            good[many] &= s[many] >= np.partition(s[many], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
        i, j = np.nonzero(good)
        if len(i):
            self.add(who[i], s[i, j], rows["chunk_id"].take(pa.array(j)))

    def merge(self) -> None:
        if not self.waiting:
            return
        query, score = (np.concatenate([x, *(w[i] for w in self.waiting)]) for i, x in ((0, self.query), (1, self.score)))
        ids = pa.chunked_array([self.ids, *(w[2] for w in self.waiting)]).combine_chunks()
        coded = ids.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place[coded.indices.to_numpy()], -score, query))
        query = query[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        order, self.query = order[keep], query[keep]
        self.score, self.ids = score[order], ids.take(pa.array(order))
        full = np.flatnonzero(np.bincount(self.query, minlength=self.n) == self.k)
        self.limit[full] = self.score[np.searchsorted(self.query, full, side="right") - 1]
        self.waiting, self.size = [], 0

    def rows(self, names: pa.Array) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), self.ids, pa.array(self.score)], ["query_id", "chunk_id", "score"])


class Checks:
    """Which pairs of a query and a chunk pass the filters."""

    def __init__(self, wanted: pa.Table) -> None:
        self.values, self.codes = {}, {}
        for c in (c for c in FILTERS if c in wanted.column_names):
            coded = wanted[c].combine_chunks().dictionary_encode()
            self.values[c] = coded.dictionary
            self.codes[c] = coded.indices.fill_null(-1).to_numpy()

    def passing(self, queries: np.ndarray, batch: pa.RecordBatch) -> np.ndarray | None:
        """(queries, rows of the batch): True if all filters pass; None if there are none."""
        out = None
        for c, codes in self.codes.items():
            has = pc.index_in(batch[c], value_set=self.values[c]).fill_null(-2).to_numpy()
            own = codes[queries][:, None]
            ok = (own == has) | (own == -1)
            if FILTERS[c]:
                ok |= batch[c].is_null().to_numpy(zero_copy_only=False)
            out = ok if out is None else out & ok
        return out


def with_filters(chunks: DataFrame, queries: DataFrame, wanted: DataFrame | None, attributes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Chunks with their attributes and queries with what they ask for: of FILTERS, the columns that both have."""
    if wanted is None or attributes is None:
        return chunks, queries
    both = [c for c in FILTERS if c in wanted.columns and c in attributes.columns]
    none = lambda c: F.nullif(F.col(c), F.lit("")).alias(c) if c != "external" else F.col(c)
    return chunks.join(attributes.select("chunk_id", *map(none, both)), "chunk_id", "left"), queries.join(wanted.select("query_id", *map(none, both)), "query_id", "left")


def _in_blocks(asked: list[DataFrame], rows: DataFrame, size: int, most: int, run, k: int) -> DataFrame:
    """``run(shared, k)`` over all rows for each block of queries of about ``most`` of ``size`` rows, and the k best of what comes out.

    asked: the queries of each ranking; shared has one table for each, and what comes out names the ranking by its number.
    """
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((asked[0], "query_id"), (rows, "chunk_id"))]
    sc, blocks, out = rows.sparkSession.sparkContext, 1 + size // most, None
    rows = stored(rows) if blocks > 1 else rows
    for b in range(blocks):
        own = [a.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow() for a in asked]
        if any(x.num_rows for x in own) or out is None:
            part = rows.mapInArrow(run(sc.broadcast(own), k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, ranking int")
            out = part if out is None else out.union(part)
    return top_k(out, k, ["query_id", "ranking"])


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int, wanted: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of the k largest sums of products of two sparse tables (query_id, term, weight) and
    (chunk_id, term, weight), among the chunks that the query's filters leave: wanted (query_id, ...), attributes (chunk_id, ...)."""
    asked = stored(queries.select("query_id", F.col("term").cast("string").alias("term"), "weight"))
    held = chunks.withColumn("term", F.col("term").cast("string")).join(asked.select("term").distinct(), "term", "left_semi")
    rows = dealt(held).groupBy("chunk_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    return topk_of_rows(asked, rows, k, wanted, attributes)


def topk_of_rows(asked: DataFrame, rows: DataFrame, k: int, wanted: DataFrame | None = None, attributes: DataFrame | None = None, weigh=None) -> DataFrame:
    """``sparse_topk`` over rows (chunk_id, terms, weights); asked: a written table.

    Terms may be an array or one string with blanks between them. weigh: instead of the column weights, a function of a batch, its
    distinct terms and their number in each place of the lists.
    """
    return topk_of_rankings([(asked, weigh)], rows, k, wanted, attributes).drop("ranking")


def topk_of_rankings(rankings: list, rows: DataFrame, k: int, wanted: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """``topk_of_rows`` for several (asked, weigh) in one pass over the rows, with the number of the ranking."""
    rows = rows.select(*(c for c in rows.columns if not c.startswith("piece_")))
    both = [with_filters(rows, asked, wanted, attributes) for asked, _ in rankings]
    weighs = [weigh for _, weigh in rankings]
    return _in_blocks([asked for _, asked in both], both[0][0], max(asked.count() for asked, _ in rankings), QUERY_TERMS, lambda shared, k: _sparse(shared, k, weighs), k)


def _given(batch: pa.RecordBatch, words: pa.Array, code: np.ndarray) -> np.ndarray:
    return batch["weights"].flatten().to_numpy(zero_copy_only=False)


def _sparse(shared, k: int, weighs=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value if isinstance(shared.value, list) else [shared.value]
        asked = [Asked(own, k) for own in tables]
        for batch in batches:
            lists = batch["terms"] if pa.types.is_list(batch["terms"].type) else pc.split_pattern(batch["terms"], " ")
            n, coded = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            flat = batch.select([c for c in batch.schema.names if c == "chunk_id" or c in FILTERS])
            for own, weigh in zip(asked, weighs or [None] * len(asked), strict=True):
                own.add(flat, words, code, row, (weigh or _given)(batch, words, code))
        for i, own in enumerate(asked):
            if own.best is not None:
                out = own.best.rows(own.names)
                yield out.append_column("ranking", pa.repeat(pa.scalar(i, pa.int32()), out.num_rows))

    return run


class Asked:
    """A block of sparse queries (query_id, term, weight, filters), and the k best chunks of each so far."""

    def __init__(self, own: pa.Table, k: int) -> None:
        coded = own["query_id"].combine_chunks().dictionary_encode()
        self.names, query = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        _, once = np.unique(query, return_index=True)
        self.checks = Checks(own.take(pa.array(once)))
        coded = own["term"].combine_chunks().dictionary_encode()
        self.vocabulary, term = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.query, self.term, self.weight = query[order], term[order], own["weight"].to_numpy()[order]
        self.k, self.best = k, None

    def add(self, rows: pa.RecordBatch, words: pa.Array, code: np.ndarray, row: np.ndarray, part: np.ndarray) -> None:
        """Rows with the terms words[code] in ``row`` and their weights ``part``."""
        self.best = best = self.best or Best(len(self.names), self.k, rows["chunk_id"].type)
        query, term, weight, terms = self.query, self.term, self.weight, len(self.vocabulary)
        known = pc.index_in(words, value_set=self.vocabulary).fill_null(-1).to_numpy()
        rows, at, row, part = _largest_first(rows, known[code], row, part)
        block = np.searchsorted(row, np.arange(0, rows.num_rows + BLOCK, BLOCK))
        for b, lo in enumerate(range(0, rows.num_rows, BLOCK)):
            mine = slice(block[b], block[b + 1])
            high, low = np.zeros(terms), np.zeros(terms)
            np.maximum.at(high, at[mine], part[mine])
            np.minimum.at(low, at[mine], part[mine])
            bound = np.bincount(query, np.maximum(weight * high[term], weight * low[term]), minlength=len(self.names)) + ROUNDED
            live = (bound >= best.limit) & (bound > ROUNDED)
            if not live.any():
                continue
            used = live[query]
            number, who = np.cumsum(live) - 1, np.flatnonzero(live)
            q, w, edges = number[query[used]], weight[used], np.searchsorted(term[used], np.arange(terms + 1))
            step, end = max(1, SCORES // len(who)), min(lo + BLOCK, rows.num_rows)
            first = np.searchsorted(row, np.minimum(np.arange(lo, end + step, step), end))
            for i, a in enumerate(range(lo, end, step)):
                here = slice(first[i], first[i + 1])
                _score(best, rows.slice(a, min(step, end - a)), at[here], row[here] - a, part[here], q, w, edges, who, self.checks)


def _largest_first(rows: pa.RecordBatch, at: np.ndarray, row: np.ndarray, part: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of large weights first, and of their terms (at, row, part) those that have a number and a weight, by row."""
    has = np.flatnonzero((at >= 0) & (part != 0))
    at, row, part = at[has], row[has], part[has]
    most = np.full(rows.num_rows, -np.inf)
    np.maximum.at(most, row, part)
    order = np.argsort(-most, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    row = place[row]
    sort = np.argsort(row, kind="stable")
    return rows.take(pa.array(order)), at[sort], row[sort], part[sort]


def _score(best: Best, rows: pa.RecordBatch, at, row, part, q, w, edges, who, checks: Checks) -> None:
    """Add up the products of the rows' terms (at, row, part) with those of the live queries ``who``, and offer what passes.

    Terms that many queries share with many rows are multiplied as matrices, the others pair by pair.
    """
    m, each = rows.num_rows, np.diff(edges)
    shared = np.flatnonzero(np.bincount(at, minlength=len(each)) * each * PAIR > m * len(who))
    column = np.full(len(each), -1)
    column[shared] = np.arange(len(shared))
    s, rest = np.zeros((len(who), m)), slice(None)
    if len(shared):
        asks, own = np.repeat(column, each), column[at]
        x = np.bincount(q[asks >= 0] * len(shared) + asks[asks >= 0], w[asks >= 0], minlength=len(who) * len(shared)).reshape(len(who), -1)
        y = np.bincount(own[own >= 0] * m + row[own >= 0], part[own >= 0], minlength=len(shared) * m).reshape(-1, m)
        s, rest = x @ y, own < 0
    at, row, part = at[rest], row[rest], part[rest]
    each = each[at]
    if total := int(each.sum()):
        place = np.repeat(edges[at] - np.cumsum(each) + each, each) + np.arange(total)
        cell = q[place] * m + np.repeat(row, each)
        s += np.bincount(cell, np.repeat(part, each) * w[place], minlength=len(who) * m).reshape(len(who), m)
    best.offer(who, np.round(s, 6), rows, checks)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, wanted: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k over stored arrays: queries (query_id, vec), vectors (chunk_id, vec), a query's own id left out.

    Vectors that are null, zero, or hold null or non-finite components take no part.
    """
    usable = F.size("vec") > 0  # false or null of a null vector
    usable &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows, asked = with_filters(vectors.where(usable), queries.where(usable), wanted, attributes)
    rows, asked = (x.withColumn("vec", F.col("vec").cast(T.ArrayType(T.DoubleType()))) for x in (rows, asked))
    asked = stored(asked)
    return _in_blocks([asked], rows, asked.count(), QUERY_BLOCK, _dense, k).drop("ranking")


def _unit(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dense(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own,) = shared.value
        names, checks, best = own["query_id"].combine_chunks(), Checks(own), None
        q = _unit(own["vec"]) if own.num_rows else np.empty((0, 0))
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            best = best or Best(len(names), k, batch["chunk_id"].type)
            x = _unit(batch["vec"])
            asker = pc.index_in(batch["chunk_id"], value_set=names.cast(batch["chunk_id"].type)).fill_null(-1).to_numpy()
            for lo in range(0, len(q), STEP):
                who = np.arange(lo, min(lo + STEP, len(q)))
                s = np.round(q[who] @ x.T, 6)
                mine = np.flatnonzero((asker >= lo) & (asker < lo + STEP))
                s[asker[mine] - lo, mine] = 0
                best.offer(who, s, batch, checks)
        if best is not None:
            out = best.rows(names)
            yield out.append_column("ranking", pa.repeat(pa.scalar(0, pa.int32()), out.num_rows))

    return run
