"""Repeated passages by a sparse suffix array.

Suffixes are kept only at minimisers: the positions that hold the smallest hash of GRAM words in some stretch of WIDTH
positions. A passage of WIDTH + GRAM - 1 words has one, so each repeat of ``min_words`` has. Only suffixes whose first
GRAM words occur elsewhere are carried on, with the next ``min_words`` words and those before, as 32-bit hashes. They
are sorted as a suffix array is, over range partitions that split frequent passages too, and each is compared with
the NEIGHBOURS suffixes before it in that order. A match is extended right and left; it counts if both ways together
reach ``min_words``. Where an anchor has more suffixes than those, or they may lie in two partitions, the best partner
can stand elsewhere: each window of ``min_words`` around such suffixes is hashed and counts if it has two places. So no
repeat is lost. Longer repeats come out as overlapping matches and are merged.

Defined results: a null or empty text has no words; a shorter text has no repeats but as part of an equal row: texts of
at least ``min_words`` words that occur on several rows are repeats as a whole; repeated rows repeat each other; an empty table
gives no rows. Words are told apart by hashes and matched unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from loregraph.llm.corpus import classes, keyed, unpack, with_classes
from loregraph.llm.mixing import word_count
from loregraph.llm.store import materialize
from loregraph.llm.substring import OCCURRENCE, repeated_anchors, sliding_min
from loregraph.llm.words import U64, Segment, _power_tables, mix, segments, windows

MIN_WORDS, GRAM, WIDTH = 50, 24, 24
NEIGHBOURS = 8
REACH = NEIGHBOURS + 1
PARTITION_ROWS = 50_000
SUFFIX = ["anchor", "right", "left", "k1", "k2", "pos", "before", "after"]
SUFFIX_SCHEMA = "anchor long, right binary, left binary, k1 long, k2 long, pos int, before int, after int"


def minimisers(s: Segment, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the segment, gram hashes there) of the segment's minimisers; a text of few grams has the smallest of all."""
    h = s.hashes()
    grams, ok = windows(h, s.bounds, gram, 31)
    low = sliding_min(grams, width)
    full = np.zeros(len(h), bool)
    left = np.repeat(s.bounds[1:], s.counts()) - np.arange(len(h))
    full[left >= gram + width - 1] = True
    keep = np.zeros(len(h), bool)
    at = np.flatnonzero(full)
    for j in range(width):
        keep[at + j] |= grams[at + j] == low[at]
    n = s.counts()
    for r in np.flatnonzero((n >= gram) & (n < gram + width - 1)):
        a, b = s.bounds[r], s.bounds[r + 1] - gram + 1
        keep[a:b] |= grams[a:b] == grams[a:b].min()
    places = np.flatnonzero(keep & ok)
    return places, grams[places]


def _anchors(gram: int, width: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["k1"].to_numpy()
            for s in segments(batch["text"]):
                at, anchor = minimisers(s, gram, width)
                row = np.searchsorted(s.bounds, at, side="right") - 1
                k1 = keys[s.lo : s.hi][row]
                if every:
                    place = mix(k1.view(U64) + (at - s.bounds[row]).astype(U64)) & OCCURRENCE
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(place.view(np.int64))], ["anchor", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(k1)], ["anchor", "k1"])

    return run


def _suffixes(gram: int, width: int, span: int):
    """One row per listed minimiser: the words from it on, and those before it from near to far."""
    back = span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, k1, k2 = batch["anchors"], batch["k1"].to_numpy(), batch["k2"].to_numpy()
            edges = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(U64)
            for s in segments(unpack(batch["packed"])):
                at, anchor = minimisers(s, gram, width)
                row = np.searchsorted(s.bounds, at, side="right") - 1
                keep = np.zeros(len(at), bool)
                for r in range(s.hi - s.lo):
                    own = row == r if s.hi - s.lo == 1 else slice(*np.searchsorted(row, [r, r + 1]))
                    keep[own] = np.isin(anchor[own], values[edges[s.lo + r] : edges[s.lo + r + 1]])
                at, anchor, row = at[keep], anchor[keep], row[keep]
                if not len(at):
                    continue
                words = (s.hashes() >> U64(32)).astype(">u4")
                before, after = np.minimum(at - s.bounds[row], back), np.minimum(s.bounds[row + 1] - at, span)
                right = words[np.minimum(at[:, None] + np.arange(span), len(words) - 1)]
                right[np.arange(span) >= after[:, None]] = 0
                left = words[np.maximum(at[:, None] - 1 - np.arange(back), 0)]
                left[np.arange(back) >= before[:, None]] = 0
                blob = lambda x, n: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
                cols = [pa.array(anchor.view(np.int64)), blob(right, span), blob(left, back), pa.array(k1[s.lo : s.hi][row]), pa.array(k2[s.lo : s.hi][row])]
                cols += [pa.array(x.astype(np.int32)) for x in (at - s.bounds[row], before, after)]
                yield pa.RecordBatch.from_arrays(cols, SUFFIX)

    return run


def compare(rows: pa.Table, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each suffix: how far its matches with the NEIGHBOURS before and after reach left (-1: none) and right, whether
    its anchor goes on beyond those, and whether it differs from the suffix before; and the words (left from near to far)."""
    n, back = rows.num_rows, span - gram
    anchor, k1, k2, pos, before, after = (rows[c].to_numpy() for c in ("anchor", "k1", "k2", "pos", "before", "after"))
    block = lambda c, w: np.frombuffer(b"".join(rows[c].to_pylist()), ">u4").reshape(n, w)
    right, left = block("right", span), block("left", back)
    far_left, far_right = np.full(n, -1), np.zeros(n, np.int64)
    new = np.ones(n, bool)
    for d in range(1, min(NEIGHBOURS, n - 1) + 1):
        a = np.flatnonzero(anchor[d:] == anchor[:-d])
        b = a + d
        differ = lambda x: np.where((x[a] != x[b]).any(axis=1), (x[a] != x[b]).argmax(axis=1), x.shape[1])  # noqa: B023, E731
        to_right, to_left = differ(right), differ(left)
        r = np.minimum(to_right, np.minimum(after[a], after[b]))
        l = np.minimum(to_left, np.minimum(before[a], before[b]))  # noqa: E741
        if d == 1:
            new[b] = (to_right < span) | (to_left < back) | (before[a] != before[b]) | (after[a] != after[b])
        same = (k1[a] == k1[b]) & (k2[a] == k2[b]) & (pos[a] == pos[b])
        good = (r >= gram) & (l + r >= span) & ~same
        for x in (a[good], b[good]):
            # All matches of a suffix hold its position, so together they cover one stretch.
            far_left[x] = np.maximum(far_left[x], l[good])
            far_right[x] = np.maximum(far_right[x], r[good])
    beyond = np.zeros(n, bool)
    a = np.flatnonzero(anchor[REACH:] == anchor[:-REACH])
    beyond[a] = beyond[a + REACH] = True
    return far_left, far_right, beyond, new, right, left


MATCH = ["k1", "k2", "start", "size"]
FOUND_SCHEMA = "k1 long, k2 long, start int, size int, window long"


def _found(rows: pa.Table, lo: int, hi: int, border: np.ndarray, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The stretches of rows lo..hi (window null), and the windows around those with partners out of reach (size 0: in the stretch)."""
    back = span - gram
    far_left, far_right, beyond, new, right, left = compare(rows, span, gram)
    k1, k2, pos, before, after = (rows[c].to_numpy() for c in ("k1", "k2", "pos", "before", "after"))
    inside = np.zeros(rows.num_rows, bool)
    inside[lo:hi] = True
    x = np.flatnonzero(inside & (far_left >= 0))
    start, size = pos[x] - far_left[x], far_left[x] + far_right[x]
    names = [*MATCH, "window"]
    yield pa.RecordBatch.from_arrays([pa.array(k1[x]), pa.array(k2[x]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.nulls(len(x), pa.int64())], names)
    # Equal suffixes stand side by side and have matched as a whole: one of them stands for all.
    x = np.flatnonzero(inside & (beyond | border) & new)
    if not len(x):
        return
    words = mix(np.concatenate([left[x][:, ::-1], right[x]], axis=1).astype(U64) + U64(1))
    up, down = _power_tables(words.shape[1])
    sums = np.zeros((len(x), words.shape[1] + 1), U64)
    np.cumsum(words * up[: words.shape[1]], axis=1, out=sums[:, 1:])
    offset = np.arange(back + 1)
    window = mix((sums[:, span:] - sums[:, : back + 1]) * down[: back + 1])
    ahead = back - offset  # words of the window before the suffix
    whole = (ahead <= before[x, None]) & (span - ahead <= after[x, None])
    covered = (ahead <= far_left[x, None]) & (span - ahead <= far_right[x, None])
    row, at = np.nonzero(whole)
    start, size = pos[x[row]] - ahead[at], np.where(covered[row, at], 0, span)
    cols = [k1[x[row]], k2[x[row]], start.astype(np.int32), size.astype(np.int32), window[row, at].view(np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _neighbours(span: int, gram: int):
    """Sorted rows of a partition -> stretches and windows. Rows at its ends may have partners in others, so those give windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, number = None, 0, 0  # rows held, how many of them are through, number of the first in the partition
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            parts = [t for t in (held, batch and pa.Table.from_batches([batch])) if t is not None]
            if not parts:
                return
            table = pa.concat_tables(parts)
            n = table.num_rows
            stop = n if batch is None else max(done, n - REACH)
            if stop > done:
                at = np.arange(n)
                border = number + at < REACH
                if batch is None:
                    border |= at >= n - REACH
                yield from _found(table, done, stop, border, span, gram)
            first = max(0, stop - REACH)
            held, done, number = table.slice(first), stop - first, number + first

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a class -> disjoint spans and the number of words in them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        spans, total = [], []
        for found in batch["found"].to_pylist():
            own: list[dict] = []
            for f in sorted(found, key=lambda f: (f["start"], f["size"])):
                if own and f["start"] <= own[-1]["start"] + own[-1]["size"]:
                    own[-1]["size"] = max(own[-1]["size"], f["start"] + f["size"] - own[-1]["start"])
                else:
                    own.append(dict(f))
            spans.append(own)
            total.append(sum(f["size"] for f in own))
        yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(spans, kind), pa.array(total, pa.int64())], ["k1", "k2", "spans", "repeated"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated and spans (start, size in words) of each row."""
    if min_words < GRAM + WIDTH - 1:
        raise ValueError(f"min_words must be at least {GRAM + WIDTH - 1}")
    k = keyed(docs, doc_id, text)
    rows = materialize(k.select("doc_id", "k1", "k2", word_count(F.col("text")).alias("n_words")))
    reps = materialize(classes(rows))
    touched = repeated_anchors(k, reps, _anchors(GRAM, WIDTH, True), _anchors(GRAM, WIDTH, False))
    touched = touched.dropDuplicates(["k1", "k2"]) if not reps.where("rep is null").isEmpty() else touched
    suffixes = touched.mapInArrow(_suffixes(GRAM, WIDTH, min_words), SUFFIX_SCHEMA)
    order = ["anchor", "right", "left", "k1", "k2", "pos"]
    n = touched.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    ordered = suffixes.repartitionByRange(int(2 + n // PARTITION_ROWS), *order).sortWithinPartitions(*order)
    compared = materialize(ordered.mapInArrow(_neighbours(min_words, GRAM), FOUND_SCHEMA))
    listed, place = compared.where("window is not null"), F.xxhash64("k1", "start")
    again = listed.groupBy("window").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("window")
    matches = compared.where("window is null").select(MATCH).union(listed.where("size > 0").join(again, "window", "left_semi").select(MATCH))
    spans = matches.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size")).alias("found"))
    spans = spans.mapInArrow(_merge, "k1 long, k2 long, spans array<struct<start: int, size: int>>, repeated long")
    out = with_classes(rows, reps.select("k1", "k2", "copies").join(spans, ["k1", "k2"], "left"))
    every = (F.col("copies") > 1) & (F.col("n_words") >= min_words)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("size")))
    none = F.array().cast("array<struct<start: int, size: int>>")
    return out.select("doc_id", "n_words", F.when(every, F.col("n_words")).otherwise(F.coalesce("repeated", F.lit(0))).cast("long").alias("n_repeated"), F.when(every, whole).otherwise(F.coalesce("spans", none)).alias("spans"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
