"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups, a proof for each row.

Leaves get their place in their group by a range sort over all groups at once: rows count within their partition, and a
row for each group and partition says how many come before. Places are cut into aligned blocks of WIDTH leaves, a power of the
arity, so that a block is a whole subtree. A block keeps each of its levels as one hex string: fixed-width substrings of a level,
hashed, are the next one, and the flanks of a node within its run are its siblings. Block roots are the nodes of the
next round, down to one for each group; the groups' roots are a last tree of the same kind. Paths to the root then go down again,
from round to round by (tree, block), so no key has more than WIDTH rows, however many a group holds.

Everything is SQL functions on Spark's side; the driver only learns how large the largest group is.

Defined results: null fields are `-`; rows of a null group are a tree of their own, before the others; within a group rows
ascend by the order column, nulls first, rows of equal ids by leaf; repeated rows are leaves each; texts of any length are
hashed whole; a lone leaf is its group's root, and a lone group's root is the root; an empty table gives no rows; columns that are no
field, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.store import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: Leaves of a block: a level string of 16 KB.
WIDTH = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else its UTF-8 byte count, `:` and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """(``rows`` (with a column tree) with pos, their place from 0 within their tree by ``order``, and n, how many that tree has; the largest n).

    Equal rows are told apart by where they were read, so that many of them are no single range.
    """
    by = ["tree", *order, "_tie"]
    put = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    put = materialize(put.withColumn("_at", F.monotonically_increasing_id()))
    put = put.withColumn("_part", F.shiftright("_at", 33))
    parts = put.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_here"))
    tree = Window.partitionBy("tree")
    before = F.sum("_here").over(tree.orderBy("_part")) - F.col("_here")
    parts = materialize(parts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(tree).alias("n")))
    most = parts.agg(F.max("n")).first()[0] or 0
    return put.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), most


def _parents(level: Column, arity: int) -> Column:
    run = HEX * arity
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "")


class Tree:
    """How trees are cut: runs of ``arity`` nodes, blocks of ``arity ** height`` leaves."""

    def __init__(self, arity: int = 2, width: int = WIDTH) -> None:
        self.arity, self.height = arity, 0
        while arity ** (self.height + 1) <= max(width, arity):
            self.height += 1
        self.width = arity**self.height

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        """nodes (tree, n, pos, digest, item) -> blocks (tree, n, block, items, height, levels); levels[0] has the block's nodes."""
        by = ["tree", "n", F.floor(F.col("pos") / self.width).alias("block")]
        blocks = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("own"))
        height = sum((F.col("n") > self.arity**i).cast("int") for i in range(self.height))
        first = F.array(F.array_join(F.transform("own", lambda x: x["digest"]), ""))
        steps = F.when(F.col("height") > 0, F.sequence(F.lit(1), F.col("height"))).otherwise(F.array().cast("array<int>"))
        up = lambda levels, _: F.concat(levels, F.array(_let(F.element_at(levels, F.lit(-1)), lambda s: _parents(s, self.arity))))
        blocks = blocks.withColumn("height", height).withColumn("levels", F.aggregate(steps, first, up))
        return materialize(blocks.select("tree", "n", "block", F.transform("own", lambda x: x["item"]).alias("items"), "height", "levels"))

    def grow(self, nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
        """(the blocks of each round, the root of each tree (tree, digest)); ``most``: the nodes of the largest tree."""
        rounds = [self._blocks(nodes)]
        while most > self.width:
            most = -(-most // self.width)
            up = rounds[-1].select("tree", F.ceil(F.col("n") / self.width).alias("n"), F.col("block").alias("pos"), F.element_at("levels", -1).alias("digest"), F.lit(None).cast("int").alias("item"))
            rounds.append(self._blocks(up))
        return rounds, rounds[-1].select("tree", F.element_at("levels", -1).alias("digest"))

    def _path(self, i: Column, above: Column) -> Column:
        """The siblings of the block's i-th node, level by level, as flanks of its run; then the path above the block."""
        out = []
        for at in range(self.height):
            level, j = F.get("levels", F.lit(at)), F.floor(i / self.arity**at).cast("int")
            k = j % self.arity
            left = F.substring(level, (j - k) * HEX + 1, k * HEX)
            right = F.substring(level, (j + 1) * HEX + 1, (self.arity - 1 - k) * HEX)
            out.append(F.struct(left.alias("left"), right.alias("right")))
        return F.concat(F.slice(F.array(*out), F.lit(1), F.col("height")), above)

    def paths(self, rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
        """item, digest and path of each node of the first round; with the columns of ``roots`` (tree, above, ...) of its tree.

        above: the path from the tree's root on.
        """
        more = [c for c in roots.columns if c not in ("tree", "above")]
        at = roots.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(rounds[1:]):
            own = blocks.join(at, ["tree", "block"])
            nodes = F.transform("items", lambda _, i: F.struct((F.col("block") * self.width + i).alias("block"), self._path(i, F.col("above")).alias("above")))
            at = materialize(own.select("tree", *more, F.inline(nodes)))
        own = rounds[0].join(at, ["tree", "block"])
        nodes = lambda x, i: F.struct(x.alias("item"), F.substring(F.get("levels", F.lit(0)), i * HEX + 1, F.lit(HEX)).alias("digest"), self._path(i, F.col("above")).alias("path"))
        return own.select(*more, F.inline(F.transform("items", nodes)))


def merkle_manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", claimed: Column | None = None, arity: int = 2, width: int = WIDTH) -> DataFrame:
    """``order``, leaf, claimed, subroot, root and path (an array of the siblings left and right of each step) of each row.

    claimed: the leaf of what someone says that a row holds, to be folded along the row's path; null: the leaf itself.
    """
    digest = leaf([F.col(f"`{f}`") for f in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    own = F.lit(None).cast("string") if claimed is None else claimed
    leaves = materialize(rows.select(tree.alias("tree"), F.col(f"`{order}`").alias("id"), digest.alias("digest"), own.alias("claimed")))
    shape = Tree(arity, width)
    nodes, most = ranked(leaves, ["id", "digest"])
    rounds, subroots = shape.grow(nodes.select("tree", "n", "pos", "digest", F.struct("id", "claimed").alias("item")), most)

    tops = materialize(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("item"), "digest"))
    top_rounds, top = shape.grow(*ranked(tops, ["item"]))
    none = F.array().cast("array<struct<left: string, right: string>>")
    above = materialize(shape.paths(top_rounds, top.select("tree", F.col("digest").alias("root"), none.alias("above"))))
    above = above.select(F.col("item").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("above"))
    out = shape.paths(rounds, above)
    return out.select(F.col("item.id").alias(order), F.col("digest").alias("leaf"), F.coalesce("item.claimed", "digest").alias("claimed"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    altered = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(altered))
    m = merkle_manifest(docs, claimed=claimed).withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 bit by bit; trees and paths by recursion over levels.
OP12_SQL = r"""
WITH RECURSIVE d AS (
    SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) AS crc
    FROM documents),
f AS (
    SELECT doc_id, lang, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS bad, n_chars,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM d),
h AS (
    SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(length((n_chars + CASE WHEN bad THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN bad THEN 1 ELSE 0 END), '-') || tail) AS claimed FROM f),
l AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
up AS (
    SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM l
    UNION ALL
    SELECT tree, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subs AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
    SELECT 0 AS lvl, pos, digest, n FROM subs
    UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS (SELECT digest AS root FROM top WHERE n = 1),
walk AS (
    SELECT doc_id, leaf, tree, 0 AS lvl, pos, n, claimed AS folded, '' AS proof FROM l
    UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
        sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(u.digest, '') || w.folded ELSE w.folded || coalesce(u.digest, '') END), w.proof || coalesce(u.digest, '')
    FROM walk w LEFT JOIN up u ON u.tree = w.tree AND u.lvl = w.lvl AND u.pos = xor(w.pos, 1) WHERE w.n > 1),
climb AS (
    SELECT w.doc_id, w.leaf, s.digest AS subroot, 0 AS lvl, s.pos, s.n, w.folded, w.proof FROM walk w JOIN subs s USING (tree) WHERE w.n = 1
    UNION ALL
    SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(t.digest, '') || c.folded ELSE c.folded || coalesce(t.digest, '') END), c.proof || coalesce(t.digest, '')
    FROM climb c LEFT JOIN top t ON t.lvl = c.lvl AND t.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM climb JOIN root ON true WHERE n = 1
"""
