"""Texts by content: a class is all rows of one text; work is done once per class and read back by its key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loregraph.llm.store import bounded_batches, materialize


def text_key(text: Column) -> tuple[Column, Column]:
    """120 bits of the text's MD5 as two longs."""
    digest = F.md5(text)
    return (F.conv(F.substring(digest, i, 15), 16, 10).cast("long") for i in (1, 17))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """doc_id, text (null: empty) and the class key k1, k2; with whole_rows, the other columns by place as c0, c1, ... of ``rest``."""
    bounded_batches(docs.sparkSession)
    rest = [F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text)).alias("rest")] if whole_rows else []
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *rest)
    k1, k2 = text_key(F.col("text"))
    return d.withColumns({"k1": k1, "k2": k2})


def classes(rows: DataFrame) -> DataFrame:
    """k1, k2, the smallest doc_id (the representative) and the number of rows of each class."""
    return rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        column = pa.array([press(t.encode()) for t in batch["text"].to_pylist()], pa.binary())
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), column], [*others, "packed"])


def unpack(column: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(p).decode() for p in column.to_pylist()], pa.large_string())


def texts_of(keyed_docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The compressed text ``packed`` of each class in ``wanted`` (k1, k2, rep, ...), read from the representative's row.

    The join is on key and id together, so the copies of a frequent text spread over all partitions.
    """
    others = [c for c in keyed_docs.columns if c != "text"]
    schema = T.StructType([*(keyed_docs.schema[c] for c in others), T.StructField("packed", T.BinaryType())])
    packed = keyed_docs.select(*others, "text").mapInArrow(_pack, schema)
    w = wanted.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep", *(c for c in wanted.columns if c not in ("k1", "k2", "rep")))
    same = (packed["k1"] == w["_k1"]) & (packed["k2"] == w["_k2"]) & packed["doc_id"].eqNullSafe(w["rep"])
    return packed.join(w, same).drop("doc_id", "_k1", "_k2", "rep")


def with_classes(rows: DataFrame, per_class: DataFrame) -> DataFrame:
    """Each row with what its class has."""
    return rows.join(materialize(per_class), ["k1", "k2"])
