"""Shards of near-equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Documents of equal text form a group that stays in one shard. Groups are dealt to buckets by hash; in each bucket the
partial partitions (one per group at first) with the largest spread are combined again and again, the largest part of
one with the smallest of the other. The buckets' partitions are then combined in the same way, in sets of ``FAN_IN``,
then those, until one is left. A bucket holds a few thousand groups at any size of the table, and no task but the
buckets' own sees more than ``FAN_IN`` partitions of ``shards`` sums.

Defined results: a null text has no bytes and joins the group of empty texts; repeated rows take a slot each; a group
larger than an even share fills its shard alone as far as it can; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.store import materialize

BUCKET_GROUPS = 4000
FAN_IN = 64
SLOT_BUCKET_ROWS = 20000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of sums) into one: (its sums, the shard that each part of each row goes to)."""
    n, k = parts.shape
    sums: list = [None] * (2 * n - 1)
    children: list = [None] * (2 * n - 1)
    heap = []
    for i in range(n):
        order = np.argsort(-parts[i], kind="stable")
        sums[i] = parts[i][order]
        children[i] = order
        heap.append((-(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    top = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[top] = both[order]
        children[top] = (a, b, order)
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-(sums[top][0] - sums[top][-1]), top))
        top += 1
    root = top - 1
    at: list = [None] * top
    at[root] = np.arange(k)
    for node in range(root, n - 1, -1):
        a, b, order = children[node]
        final = np.empty(k, np.int64)
        final[order] = at[node]
        at[a], at[b] = final, final[::-1]
        at[node] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, children[i]] = at[i]
    return sums[root], out


def _combine(shards: int):
    """Groups of rows (node, part, bytes) -> where each part goes, and the sums of the result as rows of node null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = pdf["parent"].iloc[0]
        nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        parts = np.zeros((len(nodes), shards), np.int64)
        parts[at, pdf["part"].to_numpy()] = pdf["bytes"].to_numpy()
        sums, to = difference(parts)
        down = pd.DataFrame({"parent": parent, "node": np.repeat(nodes, shards), "part": np.tile(np.arange(shards), len(nodes)), "to": to.ravel(), "bytes": -1})
        up = pd.DataFrame({"parent": parent, "node": -1, "part": np.arange(shards), "to": -1, "bytes": sums})
        return pd.concat([down, up])

    return run


def _deal(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "hi", "lo"], ascending=[False, True, True])
        n = len(pdf)
        parts = np.zeros((n, shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        sums, to = difference(parts)
        down = pd.DataFrame({"node": pdf["bucket"].to_numpy(), "hi": pdf["hi"].to_numpy(), "lo": pdf["lo"].to_numpy(), "part": to[:, 0], "bytes": -1})
        up = pd.DataFrame({"node": pdf["bucket"].iloc[0], "hi": 0, "lo": 0, "part": np.arange(shards), "bytes": sums})
        return pd.concat([down, up])

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots run from 0 in each shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(body)
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.conv(F.substring(digest, 2, 15), 16, 10).cast("long").alias("hi"),
            F.conv(F.substring(digest, 18, 15), 16, 10).cast("long").alias("lo"),
        )
    )
    groups = materialize(rows.groupBy("hi", "lo").agg(F.sum("size").alias("bytes")))
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("lo", "hi"), F.lit(buckets)))
    dealt = materialize(dealt.groupBy("bucket").applyInPandas(_deal(shards), "node long, hi long, lo long, part long, bytes long"))

    level, nodes, moves = dealt.where("bytes >= 0").select("node", "part", "bytes"), buckets, None
    schema = "parent long, node long, part long, to long, bytes long"
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        up = level.withColumn("parent", F.floor(F.col("node") / FAN_IN))
        merged = materialize(up.groupBy("parent").applyInPandas(_combine(shards), schema))
        step = merged.where("bytes < 0").select("node", "part", F.col("parent"), "to")
        # Of each bucket's parts, where they are now: tables of shards rows for each bucket.
        moves = step if moves is None else moves.join(step.toDF("parent", "to", "_parent", "_to"), ["parent", "to"]).select("node", "part", F.col("_parent").alias("parent"), F.col("_to").alias("to"))
        level = merged.where("bytes >= 0").select(F.col("parent").alias("node"), "part", "bytes")
    to = dealt.where("bytes < 0").select("hi", "lo", "node", "part")
    if moves is not None:
        to = to.join(materialize(moves), ["node", "part"]).select("hi", "lo", F.col("to").alias("part"))
    to = materialize(to.select("hi", "lo", F.col("part").cast("int").alias("shard")))
    return _slots(rows.join(to, ["hi", "lo"]))


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0: by small buckets of rows, then by the buckets' counts."""
    placed = materialize(placed)
    buckets = max(1, placed.count() // SLOT_BUCKET_ROWS)
    p = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    counts = p.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    p = p.withColumn("_rank", F.row_number().over(own)).join(counts, ["shard", "_bucket"])
    return p.select("doc_id", "size", "text_crc32", "shard", (F.col("_ahead") + F.col("_rank") - 1).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
