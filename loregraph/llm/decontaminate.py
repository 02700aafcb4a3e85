"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of letters, digits and non-ASCII characters. A mask picks fixed positions of a stretch of
tokens and ignores the rest, so a seed still matches where an ignored token was replaced. Seeds of the benchmark items
form a hash table that is joined with the seeds at every position of every text. Around a hit, item and text are
compared token by token along its diagonal, and the stretch with the best score (+1 for a match, MISMATCH for a
substitution) counts as overlap if it holds MIN_TOKENS matches, or half of an item that is shorter than twice that,
and at least IDENTITY of its tokens match.

The benchmark is worked on in blocks of at most about BLOCK_TOKENS tokens; each block is a query set that is sent to
all tasks, and passes over the texts one after another. Texts are never shuffled.

Defined results: null or empty texts and items match nothing; an item of fewer tokens than a mask spans matches where
its whole sequence occurs, one of fewer than MIN_ITEM tokens never, as chance would match it; repeated rows and items
match each; an empty table gives no rows. Of several overlaps of a row and an item the one with most matches is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import bounded_batches
from loregraph.llm.words import ALNUM, U64, Segment, mix, odd_constants, segments

MASKS = ("110110101111", "111010011011", "101101110111", "111101101101")
MIN_ITEM, MIN_TOKENS, IDENTITY, MISMATCH = 8, 12, 0.75, -2
BLOCK_TOKENS = 1_000_000
TABLE_BITS = 22


def _seed_hashes(h: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """The hash of the picked tokens from each position on; past the end it is of fewer tokens."""
    out = np.full(len(h), seed, U64)
    for o, c in zip(offsets, odd_constants(len(offsets), 100 + seed), strict=True):
        if o < len(h):
            out[: len(h) - o] += h[o:] * c
    return mix(out)


@dataclass
class SeedTable:
    """Seeds of a block of items: sorted hashes with (item, position), and a bitmap over the hashes' high bits."""

    items: list
    tokens: list[np.ndarray]
    shapes: list[tuple[list[int], int]]
    hashes: list[np.ndarray]
    owners: list[np.ndarray]
    starts: list[np.ndarray]
    maps: list[np.ndarray]

    def overlaps(self, s: Segment) -> list[tuple]:
        """(row, item, start in the text, start in the item, tokens, matches) of a segment's texts."""
        h = s.hashes(lower=True)
        left = np.repeat(s.bounds[1:], s.counts()) - np.arange(len(h))
        row_of = s.row_of_word()
        found = set()
        for k, (offsets, span) in enumerate(self.shapes):
            own = _seed_hashes(h, offsets, k)
            at = np.flatnonzero(self.maps[k][own >> U64(64 - TABLE_BITS)])
            at = at[left[at] >= span]
            lo = np.searchsorted(self.hashes[k], own[at], side="left")
            hi = np.searchsorted(self.hashes[k], own[at], side="right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for x in range(a, b):
                    found.add((int(self.owners[k][x]), int(p) - int(self.starts[k][x]), int(row_of[p])))
        best: dict = {}
        for item, diagonal, row in found:
            own = self.tokens[item]
            first, last = s.bounds[row], s.bounds[row + 1]
            a, b = max(diagonal, first), min(diagonal + len(own), last)
            same = h[a:b] == own[a - diagonal : b - diagonal]
            start, n, matches = best_stretch(same)
            enough = min(MIN_TOKENS, (len(own) + 1) // 2) if len(own) >= 16 else min(MIN_TOKENS, len(own))
            if matches >= enough and matches >= IDENTITY * n:
                new = (matches, -n, a - first + start, a - diagonal + start)
                if (row, item) not in best or new > best[row, item]:
                    best[row, item] = new
        return [(row, self.items[item], int(p), int(q), -n, m) for (row, item), (m, n, p, q) in sorted(best.items())]


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, length, matches) of the stretch with the largest score; the longest of equals, then the first."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return start, end - start, int(same[start:end].sum())


def seed_table(items: pd.DataFrame) -> SeedTable:
    """items: item_id, text."""
    ids, tokens = [], []
    for s in segments(pa.array(items["text"], pa.string()), inside_word=ALNUM):
        h = s.hashes(lower=True)
        for r in range(s.hi - s.lo):
            if s.bounds[r + 1] - s.bounds[r] >= MIN_ITEM:
                ids.append(items["item_id"].iloc[s.lo + r])
                tokens.append(h[s.bounds[r] : s.bounds[r + 1]])
    shapes = [([i for i, c in enumerate(m) if c == "1"], len(m)) for m in MASKS]
    widest = max(n for _, n in shapes)
    shapes += [(list(range(n)), n) for n in sorted({len(t) for t in tokens if len(t) < widest})]
    table = SeedTable(ids, tokens, shapes, [], [], [], [])
    for k, (offsets, span) in enumerate(shapes):
        h, own, start = [np.empty(0, U64)], [np.empty(0, int)], [np.empty(0, int)]
        for i, t in enumerate(tokens):
            whole = k >= len(MASKS)
            if len(t) >= span and (not whole or len(t) == span):
                h.append(_seed_hashes(t, offsets, k)[: len(t) - span + 1])
                own.append(np.full(len(h[-1]), i))
                start.append(np.arange(len(h[-1])))
        h, own, start = (np.concatenate(x) for x in (h, own, start))
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << TABLE_BITS, bool)
        bits[h >> U64(64 - TABLE_BITS)] = True
        table.hashes.append(h[order])
        table.owners.append(own[order])
        table.starts.append(start[order])
        table.maps.append(bits)
    return table


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[pd.DataFrame]:
    """The items in blocks of a bounded number of characters."""
    i = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    chars = i.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + chars // (BLOCK_TOKENS * 6)
    for b in range(blocks):
        yield i.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens and n_matches of each overlap, positions in tokens."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, item_kind = d.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matches"]
    out = None
    for block in item_blocks(items, item_id, item_text):
        table = docs.sparkSession.sparkContext.broadcast(seed_table(block))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in segments(batch["text"], inside_word=ALNUM):
                    if rows := table.value.overlaps(s):
                        row, *cols = zip(*rows, strict=True)
                        ids = batch["doc_id"].take(pa.array(np.array(row) + s.lo))
                        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], names)

        part = d.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, doc_start long, item_start long, n_tokens long, n_matches long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, with all their columns."""
    bounded_batches(docs.sparkSession)
    for block in item_blocks(items, item_id, item_text):
        table = docs.sparkSession.sparkContext.broadcast(seed_table(block))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for s in segments(batch[text], inside_word=ALNUM):
                    keep[[s.lo + row for row, *_ in table.value.overlaps(s)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
