"""Substring dedup by seed and extend: remove words covered by a window of ``span`` words that starts elsewhere too.

Seeds are winnowed anchors: every window has its smallest ``gram``-word hash as anchor, so equal windows share it.
A run is a maximal stretch of consecutive window starts with one anchor value. Documents are joined on anchors: only
runs whose anchor occurs elsewhere go on. They are extended in two steps. Runs that are equal as a whole (all their
words, both ways from the anchor) are repeats of every window in them. Where an anchor has several different runs,
the windows of one run of each kind are compared one by one, which finds where each match ends, to the word.

Exact copies of a text are one class and are worked on once; a class of several rows is wholly repeated. No step
lists pairs of occurrences: each compares the smallest and largest occurrence under one hash. Hashes have 64 bits.

Defined results: a null or empty text has no words; a text shorter than a window keeps all; repeated rows repeat each
other; equal doc_ids are not assumed to be the same row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.corpus import classes, keyed, texts_of, unpack, with_classes
from loregraph.llm.store import materialize
from loregraph.llm.words import U64, Segment, mix, segments, windows

SPAN, GRAM = 35, 12
OCCURRENCE = U64((1 << 40) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of values[i : i + width] for each i at which that many are left."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(s: Segment, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per run: row, first window start (word in the segment), number of windows, anchor value, whether a window of it
    starts twice in its row; and all window hashes."""
    h = s.hashes()
    grams, _ = windows(h, s.bounds, gram, 11)
    whole, ok = windows(h, s.bounds, span, 12)
    low = sliding_min(grams, span - gram + 1)
    at = np.flatnonzero(ok)
    anchor = low[at] if len(at) else np.empty(0, U64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    row = np.searchsorted(s.bounds, at[first], side="right") - 1
    own = whole[at] ^ mix(np.repeat(row, size).astype(U64))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    again = np.zeros(len(first), bool)
    if len(twice):
        again = np.add.reduceat(np.isin(own, twice), first) > 0
    return row, at[first], size, anchor[first], again, whole


def _anchors(span: int, gram: int, places: bool):
    """places: one row per run with its occurrence; else one per distinct anchor of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["k1"].to_numpy()
            for s in segments(batch["text"]):
                row, start, _, anchor, again, _ = runs(s, span, gram)
                if places:
                    row, start, anchor = (np.concatenate([x, x[again] + y]) for x, y in ((row, 0), (start, 1), (anchor, U64(0))))
                k1 = keys[s.lo : s.hi][row]
                if places:
                    other = mix(k1.view(U64) + (start - s.bounds[row]).astype(U64)) & OCCURRENCE
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(other.view(np.int64))], ["anchor", "place"])
                else:
                    order = np.lexsort((anchor, row))
                    a, r = anchor[order], row[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(k1[order][new])], ["anchor", "k1"])

    return run


def _members(span: int, gram: int):
    """Runs of each text whose anchor is in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, k1, k2 = batch["anchors"], batch["k1"].to_numpy(), batch["k2"].to_numpy()
            edges = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(U64)
            for s in segments(unpack(batch["packed"])):
                row, start, size, anchor, again, whole = runs(s, span, gram)
                cut = np.searchsorted(row, np.arange(s.hi - s.lo + 1))
                keep = np.zeros(len(row), bool)
                for r in range(s.hi - s.lo):
                    own = values[edges[s.lo + r] : edges[s.lo + r + 1]]
                    keep[cut[r] : cut[r + 1]] = np.isin(anchor[cut[r] : cut[r + 1]], own)
                row, start, size, anchor, again = row[keep], start[keep], size[keep], anchor[keep], again[keep]
                sums = np.concatenate([[U64(0)], np.cumsum(whole, dtype=U64)])
                content = mix(sums[start + size] - sums[start] + whole[start] * U64(3) + whole[start + size - 1] * U64(5) + size.astype(U64)) if len(start) else anchor
                cols = [content.view(np.int64), anchor.view(np.int64), k1[s.lo : s.hi][row], k2[s.lo : s.hi][row], (start - s.bounds[row]).astype(np.int32), size.astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["run", "anchor", "k1", "k2", "start", "size", "again"])

    return run


def _windows(span: int):
    """The windows of the listed runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, listed = batch["k1"].to_numpy(), batch["k2"].to_numpy(), batch["runs"]
            edges, flat = listed.offsets.to_numpy(), listed.values
            first, size, single = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size", "single"))
            for s in segments(unpack(batch["packed"])):
                whole, _ = windows(s.hashes(), s.bounds, span, 12)
                own = np.arange(edges[s.lo], edges[s.hi])
                row = np.repeat(np.arange(s.hi - s.lo), np.diff(edges[s.lo : s.hi + 1]))
                n = size[own]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first[own], n) + within
                row = np.repeat(row, n)
                cols = [whole[s.bounds[row] + start].view(np.int64), k1[s.lo : s.hi][row], k2[s.lo : s.hi][row], start.astype(np.int32), np.repeat(single[own], n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["window", "k1", "k2", "start", "single"])

    return run


def _cut(span: int):
    """Words left of each text after its covered stretches go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cover in zip(unpack(batch["packed"]).to_pylist(), batch["cover"].to_pylist(), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for c in cover:
                    gone[c["start"]] += 1
                    gone[c["start"] + c["size"] - 1 + span] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            removed, digest = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "cut", "cut_sha256"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            words = text.encode().split()
            out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        n, digest = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "k1", "k2", "n_words", "all_sha256"])


def repeated_anchors(k: DataFrame, reps: DataFrame, places, own) -> DataFrame:
    """The texts (packed) of classes that hold an anchor which occurs elsewhere, with the list of those anchors.

    ``places`` and ``own`` are mapInArrow functions over (k1, text): every occurrence (anchor, place) of an anchor, and
    the anchors of a text (anchor, k1).
    """
    seen = k.select("k1", "text").mapInArrow(places, "anchor long, place long")
    twice = seen.groupBy("anchor").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("anchor")
    held = k.select("k1", "text").mapInArrow(own, "anchor long, k1 long")
    held = held.join(materialize(twice), "anchor").groupBy("k1").agg(F.collect_set("anchor").alias("anchors"))
    wanted = materialize(held.join(reps, "k1").select("k1", "k2", "rep", "anchors"))
    return materialize(texts_of(k, wanted))


def repeated_substrings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with class key, word count and digest; packed texts with repeats; covered runs k1, k2, start, size)."""
    k = keyed(docs, doc_id, text)
    kind = k.schema["doc_id"].dataType.simpleString()
    rows = materialize(k.mapInArrow(_whole, f"doc_id {kind}, k1 long, k2 long, n_words long, all_sha256 string"))
    reps = materialize(classes(rows))
    touched = repeated_anchors(k, reps, _anchors(span, gram, True), _anchors(span, gram, False))

    members = materialize(touched.mapInArrow(_members(span, gram), "run long, anchor long, k1 long, k2 long, start int, size int, again boolean"))
    place = F.xxhash64("k1", "start")
    kinds = members.groupBy("run", "anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("again").alias("again"))
    kinds = materialize(kinds.withColumn("single", F.col("lo") == F.col("hi")))
    alike = members.join(kinds.where("not single").select("run"), "run", "left_semi").select("k1", "k2", "start", "size")

    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor"))
    apart = kinds.join(several, "anchor", "left_semi").select("run", "lo", "single")
    chosen = members.withColumn("lo", place).join(apart, ["run", "lo"])
    chosen = chosen.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size", "single")).alias("runs"))
    spread = touched.select("k1", "k2", "packed").join(chosen, ["k1", "k2"])
    listed = materialize(spread.mapInArrow(_windows(span), "window long, k1 long, k2 long, start int, single boolean"))
    # A written table: Spark splits a frequent window's rows in the join only where both sides are plain shuffles.
    again = materialize(listed.groupBy("window").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("window"))
    ends = listed.where("single").join(again, "window", "left_semi").select("k1", "k2", "start", F.lit(1).alias("size"))
    return rows, touched, alike.union(ends)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of each row."""
    rows, touched, cover = repeated_substrings(docs, span, gram, doc_id, text)
    cover = cover.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size")).alias("cover"))
    cut = touched.select("k1", "k2", "packed").join(cover, ["k1", "k2"]).mapInArrow(_cut(span), "k1 long, k2 long, cut long, cut_sha256 string").dropDuplicates(["k1", "k2"])
    per_class = classes(rows).join(cut, ["k1", "k2"], "left").select("k1", "k2", "copies", "cut", "cut_sha256")
    out = with_classes(rows, per_class)
    every = (F.col("copies") > 1) & (F.col("n_words") >= span)
    removed = F.when(every, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0)))
    digest = F.when(every, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha256", "all_sha256"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))


def op10_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
