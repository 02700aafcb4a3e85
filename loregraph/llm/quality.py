"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of the text.

Each text gives a vector of statistics (lengths, repetition, character classes, entropies), brought to roughly normal
shape by logarithms. Per class, mean and covariance come from sums over the training rows (labelled ones; of
more than FIT_ROWS, about so many, those of the smallest hashes of their ids), added up by Spark; the covariance is shrunk towards the pooled one and a scaled identity. A text's score is the difference of the
classes' log densities (Mahalanobis distances by triangular solves with Cholesky factors that are computed once),
its inverse hyperbolic sine put through a logistic curve fitted to a histogram of the training rows.

Labels, language, source and id are never inputs of a score; equal texts score alike.

Defined results: a null or empty text has the statistics of no words and scores as any other vector; null labels are
left out; repeated rows are scored each; with a class missing in training, every score is the share of label 1 (0.5
without any label); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import bounded_batches, materialize
from loregraph.llm.words import Segment, segments, windows

FEATURES = ("words", "word_bytes", "word_spread", "distinct", "top_share", "repeats", "alphabetic", "digits", "symbols", "points", "capitals", "sentence_ends", "lines", "word_entropy", "long_words", "grams")
HELD_OUT = 2
THRESHOLD = 0.7
BINS = 4000
FIT_ROWS = 50_000

_KINDS = np.zeros(256, np.int8)  # 0 other, 1 letter, 2 digit, 3 symbol, 4 point, 5 capital
_KINDS[[*range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2
_KINDS[[ord(c) for c in "#$%&*|<>{}[]\\^~_=+@/`"]] = 3
_KINDS[[ord(c) for c in ".,;:!?"]] = 4
_KINDS[65:91] = 5


def _runs(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, largest count and sum of c * log(c) over the counts of each row."""
    n = len(bounds) - 1
    if not len(values):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    values = values.copy()
    for r in range(n):
        values[bounds[r] : bounds[r + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    new[edges] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    row = np.searchsorted(bounds, at, side="right") - 1
    most = np.zeros(n)
    np.maximum.at(most, row, counts)
    return np.bincount(row, minlength=n).astype(float), most, np.bincount(row, counts * np.log(counts), minlength=n)


def statistics(s: Segment) -> np.ndarray:
    """One row of transformed statistics for each text of a segment."""
    n, rows = s.counts().astype(float), s.hi - s.lo
    some = np.maximum(n, 1)
    owner = s.row_of_word()
    size = (s.ends - s.starts).astype(float)
    total = np.bincount(owner, size, minlength=rows)
    spread = np.sqrt(np.maximum(np.bincount(owner, size**2, minlength=rows) / some - (total / some) ** 2, 0))
    h = s.hashes()
    distinct, most, clogc = _runs(h, s.bounds)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    kinds = np.zeros((rows, 6))
    for k, line in ((1, None), (2, None), (3, None), (4, None), (5, None)):
        sums = np.concatenate([[0], np.cumsum(_KINDS[s.data] == k)])
        kinds[:, k] = sums[s.offsets[1:]] - sums[s.offsets[:-1]]
    line_ends = np.concatenate([[0], np.cumsum(s.data == 10)])
    lines = line_ends[s.offsets[1:]] - line_ends[s.offsets[:-1]]
    stops = np.bincount(owner, np.isin(s.data[s.ends - 1], [33, 46, 63]) if len(s.ends) else None, minlength=rows)
    grams, ok = windows(h, s.bounds, 3, 5)
    kept = np.flatnonzero(ok)
    edges = np.searchsorted(kept, s.bounds)
    tri = _runs(grams[kept], edges)[0]
    share = lambda a, b: np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))
    bytes_ = np.maximum(total, 1)
    x = [
        np.log1p(n),
        np.log1p(total / some),
        np.log1p(spread),
        share(distinct, n),
        share(most, n),
        share(np.bincount(owner, again, minlength=rows), n),
        share(kinds[:, 1], bytes_),
        share(kinds[:, 2], bytes_),
        share(kinds[:, 3], bytes_),
        share(kinds[:, 4], bytes_),
        share(kinds[:, 5], bytes_),
        share(stops, n),
        np.log1p(lines) - np.log1p(n),
        np.log(some) - clogc / some,
        share(np.bincount(owner, size > 25, minlength=rows), n),
        share(tri, np.diff(edges)),
    ]
    return np.stack(x, axis=1)


def _statistics(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(s) for s in segments(batch["text"])]
            flat = np.concatenate(x).ravel() if x else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch[key], lists], [key, "x"])

    return run


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the vector ``x`` of FEATURES of each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_statistics("doc_id"), f"doc_id {kind}, x array<double>")


def forward(lower: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x of lower @ x = row for each row, by forward substitution."""
    out = np.empty_like(rows)
    for i in range(len(lower)):
        out[:, i] = (rows[:, i] - out[:, :i] @ lower[i, :i]) / lower[i, i]
    return out


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factors of the covariances
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0
    share: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            out.append(constant - 0.5 * (forward(factor, z - mean) ** 2).sum(axis=1))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.offset, -500, 500)))


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for pdf in frames:
        for label in (0, 1):
            own = pdf["x"][pdf["label"] == label]
            if len(own):
                x = np.stack(own.to_numpy())
                sums[label] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    width = sums.shape[1]
    yield pd.DataFrame({"label": np.repeat([0, 1], width), "at": np.tile(np.arange(width), 2), "value": sums.ravel()})


def fit(labelled: DataFrame, shrink: float = 0.05, ridge: float = 0.02) -> Discriminant:
    """Fit on rows (x, label 0 or 1). Only sums over the rows and a histogram of BINS bins come to the driver."""
    d = len(FEATURES)
    table = labelled.select("x", "label").mapInPandas(_sums, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + d + d * d))
    for row in table.collect():
        sums[row["label"], row["at"]] = row["value"]
    n = sums[:, 0]
    if n.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], share=float(n[1] / n.sum()) if n.sum() else 0.5)
    centre = sums[:, 1 : 1 + d].sum(axis=0) / n.sum()
    moment = sums[:, 1 + d :].sum(axis=0).reshape(d, d) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(moment) - centre**2, 1e-12))
    means, covs = [], []
    for c in (0, 1):
        mean = sums[c, 1 : 1 + d] / n[c]
        cov = sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        covs.append(cov / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        cov = (1 - shrink) * covs[c] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(lower)
        constants.append(-float(np.log(np.diag(lower)).sum()))
    model = Discriminant(centre, scale, means, factors, constants)
    return _calibrate(model, labelled, n)


def _calibrate(model: Discriminant, labelled: DataFrame, n: np.ndarray) -> Discriminant:
    """Fit slope and offset of the logistic curve to the histogram of asinh(difference) by class."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BINS), np.int64)
        for pdf in frames:
            if len(pdf):
                at = np.clip(((np.arcsinh(shared.value.difference(np.stack(pdf["x"].to_numpy()))) + 20) * (BINS / 40)).astype(int), 0, BINS - 1)
                np.add.at(counts, (pdf["label"].to_numpy(), at), 1)
        label, at = np.nonzero(counts)
        yield pd.DataFrame({"label": label, "at": at, "rows": counts[label, at]})

    table = labelled.select("x", "label").mapInPandas(bins, "label int, at int, rows long").groupBy("label", "at").agg(F.sum("rows").alias("rows")).toPandas()
    t = (table["at"].to_numpy() + 0.5) * (40 / BINS) - 20
    y, w = table["label"].to_numpy(float), table["rows"].to_numpy(float)
    beta = np.array([0.3, float(np.log(n[1] / n[0]))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta[0] * t + beta[1], -500, 500)))
        grad = np.array([(w * (y - p) * t).sum() - 1e-3 * beta[0], (w * (y - p)).sum()])
        v = w * p * (1 - p)
        hess = np.array([[(v * t * t).sum() + 1e-3, (v * t).sum()], [(v * t).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = max(float(beta[0]), 1e-6), float(beta[1])
    return model


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int = FIT_ROWS) -> Discriminant:
    """Fit on the documents of labelled ids that are not held out; of more than ``most``, those with the smallest hashes,
    about ``most``. Only their texts are gone through: so few ids are sent to all tasks."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    known = materialize(known.where(~_held_out(F.col("_id"))).distinct())
    if (n := known.count()) > most:
        known = materialize(known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < (most << 30) // n))
    own = docs.select(docs[doc_id].alias("_doc"), docs[text].alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    bounded_batches(docs.sparkSession)
    x = own.select("label", "text").mapInArrow(_statistics("label"), "label int, x array<double>")
    return fit(materialize(x))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for each row; held-out rows take no part in training."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, doc_id, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(statistics(s)) for s in segments(batch["text"])]
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], column], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD or more, with all columns.

    Defined results: a null or empty text is scored as one of no words; repeated rows stay or go together; a null id has
    no label; without labels of either class all rows get one score, the share of label 1 (0.5 without any), so all stay or
    all go; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels, doc_id, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(statistics(s)) for s in segments(batch[text])]
            yield batch.filter(pa.array(np.concatenate(scores) >= THRESHOLD)) if scores else batch

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
