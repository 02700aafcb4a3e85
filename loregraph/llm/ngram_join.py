"""Jaccard join on word n-grams with a token-group matrix.

Rows of equal shingle sets are one set. Sets are partitioned into groups of similar ones: same smallest shingle (a
min-hash) and about the same size.

Which sets can link is told by coarse tokens: the shingles of a set fall into m segments by hash, and the content of a
segment with enough shingles is one token. There are more segments than two sets of the class (or of it and the next
larger) may differ by and still link, and than a set may have thin segments, so two sets that link agree in a token.
Of sets that share a token, parities of their shingles rule out most that share no more than a passage: their
difference bounds that of the sets from below. What is left joins sets to clusters. A cluster is one block or, if it has
more than GROUP sets, several, and then all pairs of its blocks are compared too.

In a block the token-group matrix says which shingles the union of each group holds. A query set's overlap with each
union is counted in it; only groups that can reach what a link with their sizes needs are opened, and only their sets'
overlaps are counted. Sets that link get one edge each towards the smallest of their local part, and components follow
from the edges. Pairs of sets are neither listed nor shuffled.

Defined results: a row without words or text has no shingles, links with nothing and is its own component; repeated rows
and ids are rows of one set; a null id is left out of the smallest ids; an empty table gives no rows. Shingles
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.llm.components import components
from loregraph.llm.corpus import keyed, texts_of, unpack
from loregraph.llm.mixing import WORD
from loregraph.llm.store import materialize
from loregraph.llm.words import U64, mix, segments, shingle_sets

GROUP = 128
TOKEN_BITS = 56
LONG_RUN = 4096
MOST_BITS = 1 << 14


def size_classes(percent: int, upto: int) -> np.ndarray:
    """Lower bounds of size classes: a set links only with sets of its own class and the two beside it."""
    lows = [1, 2]
    while lows[-1] <= upto:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * 100 // percent + 1))
    return np.array(lows)


@cache
def plan_of_class(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(segments, shingles that a segment needs to be thick, thin segments that a set may have) for sets of low to high.

    Two sets that link differ in at most high * (100 - percent) / percent shingles, so with one segment more than that
    plus the thin ones of either, they agree in a thick one.
    """
    differ = high * (100 - percent) // percent
    for least in (3, 2, 1):
        spare = 0
        while spare <= 0.3 * (differ + 1) or least == 1:
            m = differ + 1 + spare
            mean = low / m
            thin = m * exp(-mean) * sum(mean**x / factorial(x) for x in range(least))
            need = ceil(thin + 2.5 * sqrt(thin)) if m > 1 else 0
            if need <= spare or spare > differ:
                return m, least, spare
            spare += max(1, (need - spare) // 2)
    raise AssertionError


def coarse_tokens(values: np.ndarray, c: int, plan: tuple[int, int, int]) -> np.ndarray:
    """One token for each thick segment of a set, as a member of class c; with more thin ones than planned, for every segment."""
    m, least, spare = plan
    at = ((values >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
    sums = np.zeros(m, U64)
    np.add.at(sums, at, mix(values + U64(1)))
    thick = np.bincount(at, minlength=m) >= least
    place = mix(np.arange(m, dtype=U64) + (np.array([c], U64) << U64(32)))
    tokens = mix(sums ^ place) >> U64(64 - TOKEN_BITS)
    return tokens[thick] if m - int(thick.sum()) <= spare else tokens


def _order(doc_id: str, *keys: str) -> Column:
    """What the first of several rows is told by: the smallest id, none last, then the text key."""
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), *keys)


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in segments(batch["text"]):
                values, bounds = shingle_sets(s.hashes(lower=True), s.bounds, k, 21)
                n = np.diff(bounds)
                first = np.where(n > 0, bounds[:-1], 0)
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(x)), dtype=U64)]) for x in (1, 2)]
                f1, f2 = (mix(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
                low = values[first].view(np.int64) if len(values) else np.zeros(len(n), np.int64)
                own = [batch[c].slice(s.lo, s.hi - s.lo) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (n, f1, f2, low))], ["doc_id", "k1", "k2", "n", "f1", "f2", "low"])

    return run


def _tokens(k: int, percent: int, lows: np.ndarray):
    """(token, f1) of each set, as a member of its class and as the larger partner of the class below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["f1"].to_numpy()
            for s in segments(unpack(batch["packed"])):
                values, bounds = shingle_sets(s.hashes(lower=True), s.bounds, k, 21)
                n = np.diff(bounds)
                cls = np.searchsorted(lows, n, side="right") - 1
                out, owner = [], []
                for r in range(len(n)):
                    if n[r]:
                        own = values[bounds[r] : bounds[r + 1]]
                        for c in (cls[r], cls[r] - 1):
                            if c >= 0:
                                out.append(coarse_tokens(own, c, plan_of_class(int(lows[c]), int(lows[c + 1]) - 1, percent)))
                                owner.append(np.full(len(out[-1]), ids[s.lo + r]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], ["token", "f1"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, f1) in order of token -> those whose token occurs on more than one row."""
    t, f, like_last = np.empty(0, np.int64), np.empty(0, np.int64), False

    def rows(t: np.ndarray, f: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(f[keep])], ["token", "f1"])

    for batch in batches:
        t, f = np.concatenate([t, batch["token"].to_numpy()]), np.concatenate([f, batch["f1"].to_numpy()])
        if not len(t):
            continue
        same = t[1:] == t[:-1]
        before = np.append(like_last, same)
        yield rows(t[:-1], f[:-1], before[:-1] | same)
        t, f, like_last = t[-1:], f[-1:], bool(before[-1])
    yield rows(t, f, np.full(len(t), like_last))


def parity_bits(values: np.ndarray, percent: int) -> bytes:
    """Parities of a set's shingles by hash: two sets' parities differ in at most as many bits as the sets in shingles.

    As many bits as four times the largest difference of a link, rounded up to a power of two.
    """
    bits = 64
    while bits < MOST_BITS and bits < 4 * len(values) * (100 - percent) // percent:
        bits *= 2
    return np.packbits(np.bincount((values & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _signatures(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in segments(unpack(batch["packed"])):
                values, bounds = shingle_sets(s.hashes(lower=True), s.bounds, k, 21)
                bits = [parity_bits(values[bounds[r] : bounds[r + 1]], percent) for r in range(s.hi - s.lo)]
                yield pa.RecordBatch.from_arrays([batch["f1"].slice(s.lo, s.hi - s.lo), pa.array(np.diff(bounds)), pa.array(bits, pa.binary())], ["f1", "n", "bits"])

    return run


def close_pairs(ids: list[int], sizes: list[int], bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that join the sets of a run whose parities do not rule a link out; a long run is joined as it is."""
    if len(ids) > LONG_RUN:
        return [(ids[0], x) for x in ids[1:]]
    width = min(map(len, bits)) * 8
    folded = []
    for b in bits:
        x, have = int.from_bytes(b, "little"), len(b) * 8
        while have > width:
            have //= 2
            x = (x >> have) ^ (x & ((1 << have) - 1))
        folded.append(x)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for j in range(1, len(ids)):
        seen = set()
        for i in range(j):
            r = find(i)
            if r in seen:
                continue
            n = sizes[i] + sizes[j]
            if (100 + percent) * (folded[i] ^ folded[j]).bit_count() <= (100 - percent) * n:
                seen.add(r)
                root[find(j)] = r
                out.append((ids[i], ids[j]))
                seen.add(find(j))
    return out


def _close(percent: int):
    """Rows (token, f1, n, bits) in order of token -> edges (u, v) of sets that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held = None, ([], [], [])
        found: set[tuple[int, int]] = set()

        def close() -> None:
            if len(held[0]) > 1:
                found.update(close_pairs(*held, percent))
            for part in held:
                part.clear()

        for batch in batches:
            for t, *row in zip(*(batch[c].to_pylist() for c in ("token", "f1", "n", "bits")), strict=True):
                if t != token:
                    close()
                    token = t
                if len(held[0]) > LONG_RUN:
                    found.add((held[0][0], row[0]))  # joined as it is, without keeping the rows
                    continue
                for part, x in zip(held, row, strict=True):
                    part.append(x)
            if len(found) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found])], ["u", "v"])
                found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    return run


class Block:
    """Sets with their groups, and the token-group matrix: for each token the groups whose union has it, and the sets that do."""

    def __init__(self, table: pa.Table, k: int) -> None:
        self.ids, self.copies = table["f1"].to_numpy(), table["copies"].to_numpy()
        values, sizes = [np.empty(0, U64)], [np.empty(0, np.int64)]
        packed = table["packed"]
        for s in segments(unpack(packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed)):
            v, bounds = shingle_sets(s.hashes(lower=True), s.bounds, k, 21)
            values.append(v)
            sizes.append(np.diff(bounds))
        self.values, self.sizes = np.concatenate(values), np.concatenate(sizes)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.group = np.unique(table["gid"].to_numpy(), return_inverse=True)
        self.groups = int(self.group.max()) + 1
        self.least, self.most = np.full(self.groups, np.iinfo(np.int64).max), np.zeros(self.groups, np.int64)
        np.minimum.at(self.least, self.group, self.sizes)
        np.maximum.at(self.most, self.group, self.sizes)
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(self.values, kind="stable")
        flat, self.owners = self.values[order], owner[order]
        self.tokens, first = np.unique(flat, return_index=True)
        self.edges = np.append(first, len(flat))
        place = np.repeat(np.arange(len(self.tokens)), np.diff(self.edges))
        cells = np.unique(place * self.groups + self.group[self.owners])
        self.cell_groups = cells % self.groups
        self.cell_edges = np.searchsorted(cells, np.arange(len(self.tokens) + 1) * self.groups)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at[self.tokens[at] == tokens]


def _gather(values: np.ndarray, edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    lo, n = edges[at], edges[at + 1] - edges[at]
    return values[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def qualifying(block: Block, at: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Groups whose union a query of ``size`` tokens at ``at`` overlaps by as much as a link needs with some size there."""
    overlap = np.bincount(_gather(block.cell_groups, block.cell_edges, at), minlength=block.groups)
    low = np.maximum(block.least, -(-size * percent // 100))
    return (low <= np.minimum(block.most, size * 100 // percent)) & ((100 + percent) * overlap >= percent * (size + low))


def links(a: Block, b: Block | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of set numbers that link: of a and b, or within a."""
    other = a if b is None else b
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(len(a.ids)):
        at = other.places(a.values[a.bounds[r] : a.bounds[r + 1]])
        opened = qualifying(other, at, int(a.sizes[r]), percent)
        if not opened.any():
            continue
        own = _gather(other.owners, other.edges, at)
        overlap = np.bincount(own[opened[other.group[own]]], minlength=len(other.ids))
        linked = np.flatnonzero((overlap > 0) & ((100 + percent) * overlap >= percent * (a.sizes[r] + other.sizes)))
        linked = linked[linked > r] if b is None else linked
        i.append(np.full(len(linked), r))
        j.append(linked)
    return np.concatenate(i), np.concatenate(j)


def _open(k: int, percent: int):
    """The sets of a block or of a pair of blocks -> (u, v, 0): edges that join what links, and (u, u, links)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 3, ["u", "v", "links"])
        if not left.num_rows:
            return empty
        a = Block(left, k)
        b = Block(right.rename_columns(left.column_names), k) if right.num_rows else None
        i, j = links(a, b, percent)
        if not len(i):
            return empty
        other = a if b is None else b
        ids = np.concatenate([a.ids, b.ids]) if b is not None else a.ids
        j_at = j + (len(a.ids) if b is not None else 0)
        parent = list(range(len(ids)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j_at.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                lo, hi = (x, y) if ids[x] < ids[y] else (y, x)
                parent[hi] = lo
        roots = np.array([find(x) for x in range(len(ids))])
        member = np.flatnonzero(roots != np.arange(len(ids)))
        counts = np.bincount(i, other.copies[j], minlength=len(ids)) + np.bincount(j_at, a.copies[i], minlength=len(ids))
        linked = np.flatnonzero(counts)
        u = np.concatenate([ids[member], ids[linked]])
        v = np.concatenate([ids[roots[member]], ids[linked]])
        return pa.table([u, v, np.concatenate([np.zeros(len(member), np.int64), counts[linked].astype(np.int64)])], ["u", "v", "links"])

    return run


def _clusters(grouped: DataFrame, n_words: int, percent: int, lows: np.ndarray) -> DataFrame:
    """(f1, root) of sets that share tokens and are not ruled out by their parities, directly or through others."""
    order = lambda df: df.repartition("token").sortWithinPartitions("token")
    tokens = grouped.select("f1", "packed").mapInArrow(_tokens(n_words, percent, lows), "token long, f1 long")
    shared = materialize(order(tokens).mapInArrow(_shared, "token long, f1 long"))
    some = shared.select("f1").distinct()
    marks = grouped.select("f1", "packed").join(some, "f1", "left_semi").mapInArrow(_signatures(n_words, percent), "f1 long, n long, bits binary")
    near = order(shared.join(materialize(marks), "f1")).select("token", "f1", "n", "bits").mapInArrow(_close(percent), "u long, v long")
    return components(near).withColumnRenamed("node", "f1")


def _blocks(grouped: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets of clusters of two or more with their block, blocks and pairs of blocks (a, b) of one cluster)."""
    clusters = materialize(clusters)
    n = clusters.count()
    sizes = materialize(clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks")), n)
    where = clusters.join(sizes, "root").select("f1", F.xxhash64("root", F.pmod(F.xxhash64("f1"), "blocks").cast("int")).alias("block"))
    block = lambda x: F.xxhash64("root", x)
    first = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = first.select(block(F.col("x")).alias("a"), F.lit(None).cast("long").alias("b"))
    pairs = first.where("x < blocks - 1").withColumn("y", F.explode(F.sequence(F.col("x") + 1, F.col("blocks") - 1)))
    return materialize(grouped.select("f1", "copies", "gid", "packed").join(materialize(where, n), "f1")), materialize(alone.union(pairs.select(block(F.col("x")), block(F.col("y")))), n)


def _components(docs: DataFrame, n_words: int, percent: int, doc_id: str, text: str, whole_rows: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with class key, number of shingles n and set f1, f2; root, component_id and n_links of each set; one row of each set, its text packed)."""
    k = keyed(docs, doc_id, text, whole_rows)
    kind = k.schema["doc_id"].dataType.simpleString()
    rows = materialize(k.select("doc_id", "text", "k1", "k2").mapInArrow(_fingerprints(n_words), f"doc_id {kind}, k1 long, k2 long, n long, f1 long, f2 long, low long"))
    lows = size_classes(percent, int(rows.agg(F.max("n")).first()[0] or 0) + 1)
    sets = rows.where("n > 0").groupBy("f1", "f2", "n", "low").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.min(_order("doc_id", "k1", "k2")).alias("_rep"))
    group = F.xxhash64("low", F.floor(F.log("n")))
    sets = materialize(sets.select("f1", "f2", "copies", F.col("rep").alias("least"), F.col("_rep.doc_id").alias("rep"), "_rep.k1", "_rep.k2", group.alias("gid")), rows.count())
    n = sets.count()
    grouped = texts_of(k, sets.select("k1", "k2", "rep", "f1", "gid", "copies"))
    if not rows.groupBy("doc_id", "k1", "k2").count().where("count > 1").isEmpty():
        grouped = grouped.dropDuplicates(["f1"])  # a row that is there twice is read twice
    grouped = materialize(grouped)

    sets_in, looks = _blocks(grouped, _clusters(grouped, n_words, percent, lows))
    looks = looks.withColumn("look", F.xxhash64("a", "b"))
    cols = ["look", "f1", "copies", "gid", "packed"]
    left = looks.join(sets_in, looks["a"] == sets_in["block"]).select(cols)
    right = looks.where("b is not null").join(sets_in, F.col("b") == sets_in["block"]).select(cols).toDF(*(f"{c}_b" for c in cols))
    found = materialize(left.groupBy("look").cogroup(right.groupBy("look_b")).applyInArrow(_open(n_words, percent), "u long, v long, links long"))

    roots = components(found.where("u <> v").select("u", "v"))
    counts = found.where("u = v").groupBy(F.col("u").alias("f1")).agg(F.sum("links").alias("links"))
    known = sets.select("f1", "f2", "least", "copies", "rep", "k1", "k2").join(counts, "f1", "left").join(roots.withColumnRenamed("node", "f1"), "f1", "left")
    known = materialize(known.withColumn("root", F.coalesce("root", "f1")), n)
    smallest = materialize(known.groupBy("root").agg(F.min("least").alias("component_id")), n)
    known = known.join(smallest, "root").select("f1", "f2", "root", "rep", "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows, materialize(known, n), grouped


def jaccard_components(docs: DataFrame, n_words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and n_links (rows linked with) of each row."""
    rows, known, _ = _components(docs, n_words, percent, doc_id, text)
    linked = rows.where("n > 0").join(known, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id", F.lit(0)))


def _unpacked(schema: T.StructType, text: str):
    """Rows (rest, packed) -> the columns of ``schema`` by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch["rest"].flatten()
            at = iter(rest)
            cols = [unpack(batch["packed"]).cast(pa.string()) if f.name == text else next(at) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])

    return run


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (null: last), then of the smallest text key.

    The row travels as the one its set was read from, with its text compressed; the other texts of a component aren't
    moved for this. Defined results: rows without words or text stay, each of them; of rows of one id and one text one
    stays, whatever their other columns hold; a component without any id keeps a row too; an empty table gives no rows;
    columns keep their names and places, whatever those are.
    """
    _, known, grouped = _components(docs, n_words, percent, doc_id, text, whole_rows=True)
    first = known.groupBy("root").agg(F.min_by("f1", _order("rep", "k1", "k2")).alias("f1")).select("f1")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    kept = grouped.select("f1", "rest", "packed").join(materialize(first), "f1", "left_semi").select("rest", "packed")
    bare = docs.where(~F.coalesce(docs[text], F.lit("")).rlike(WORD))
    return kept.mapInArrow(_unpacked(docs.schema, text), schema).toDF(*docs.columns).union(bare)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=3, percent=90)
