"""The granularities of chunks, a document at a time in its order: as a table function for SQL, and all of them in one pass over a table of atoms."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from loregraph.operators.chunking import GRANULARITIES, granular_id

SPACE = " \t\n\x0b\f\r"
SIZE, STEP, LEAST = 1200, 1000, 40
# SENTENCE_END's breaks, with the character that they look back for: found by it, a text is gone through several times as fast.
BREAK = re.compile(r"[.!?…]\s+(?=[«\"А-ЯA-Z0-9])", re.ASCII)
#: Characters of chunks that are given out at once.
PIECE = 4_000_000
OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("paragraph_index", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("text", T.StringType())])


def sentences(text: str) -> list[str]:
    """As ``split_sentences``: a short piece joins the one before it; pieces ahead of the first long one wait for it."""
    done, ahead = [], ""
    text = text.strip(SPACE)
    ends = [m.start() + 1 for m in BREAK.finditer(text)]
    for piece in filter(None, (text[a:b].strip(SPACE) for a, b in zip([0, *ends], [*ends, None], strict=True))):
        cand = f"{ahead} {piece}" if ahead else piece
        if len(cand) >= LEAST:
            done.append(f"{ahead} {cand}" if ahead else cand)
            ahead = ""
        elif done:
            done[-1], ahead = f"{done[-1]} {cand}", ""
        else:
            ahead = cand
    return done or ([ahead] if ahead else [])


class Rechunk:
    """The chunks of each document's atoms (doc_id, pos, page, is_heading, text) at one of GRANULARITIES. Holds one document."""

    def __init__(self) -> None:
        self.body: list[tuple[int, str | None, int, str]] = []
        self.doc, self.granularity, self.section, self.number = None, "paragraph", None, 0

    @staticmethod
    def analyze(atoms: AnalyzeArgument, granularity: AnalyzeArgument) -> AnalyzeResult:
        if not atoms.isTable:
            raise ValueError("the first argument must be a table: TABLE(atoms)")
        if granularity.value not in GRANULARITIES:
            raise ValueError(f"the granularity must be one of {', '.join(GRANULARITIES)}")
        return AnalyzeResult(OUT, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("pos")])

    def eval(self, row, granularity: str) -> None:
        self.doc, self.granularity = row["doc_id"], granularity
        self.add(row["page"], row["is_heading"], row["text"])

    def add(self, page: int | None, is_heading: bool, text: str) -> None:
        if is_heading:
            self.section, self.number = text, self.number + 1
        else:
            self.body.append((page, self.section, self.number, text))

    def chunks(self, granularity: str) -> list[tuple]:
        return {"paragraph": self.paragraph, "sentence": self.sentence, "page": self.page, "section": self.by_section, "window": self.window}[granularity]()

    def terminate(self) -> Iterator[tuple]:
        for i, (page, section, text) in enumerate(self.chunks(self.granularity)):
            yield self.doc, i, page, section, text

    def paragraph(self) -> list[tuple]:
        return [(page, section, text) for page, section, _, text in self.body]

    def sentence(self) -> list[tuple]:
        return [(page, section, s) for page, section, _, text in self.body for s in sentences(text)]

    def _grouped(self, key: int) -> list[list[tuple]]:
        groups: dict[int, list[tuple]] = {}
        for atom in self.body:
            groups.setdefault(atom[key], []).append(atom)
        return [groups[k] for k in sorted(groups)]

    def page(self) -> list[tuple]:
        return [(g[0][0], g[-1][1], "\n\n".join(a[3] for a in g)) for g in self._grouped(0)]

    def by_section(self) -> list[tuple]:
        return [(g[0][0], g[-1][1], "\n\n".join(a[3] for a in g)) for g in self._grouped(2)]

    def window(self) -> list[tuple]:
        starts, at = [], 0
        for *_, text in self.body:
            starts.append(at)
            at += len(text) + 2
        whole = "\n\n".join(a[3] for a in self.body).strip(SPACE)
        pieces = [p for p in (whole[i : i + SIZE].strip(SPACE) for i in range(0, len(whole), STEP)) if p]
        places = [self.body[bisect_right(starts, i * STEP) - 1] for i in range(len(pieces))]
        return [(page, section, text) for (page, section, *_), text in zip(places, pieces, strict=True)]


def register_rechunker(spark: SparkSession, name: str = "rechunk_atoms") -> None:
    """SELECT * FROM rechunk_atoms(TABLE(atoms), 'page'): Spark deals the atoms out by document and sorts them by pos."""
    spark.udtf.register(name, udtf(Rechunk))


def every_granularity(atoms: DataFrame) -> DataFrame:
    """granularity, chunk_id and text of the chunks that ``rechunk`` gives at all of GRANULARITIES.

    The atoms are dealt out by document and sorted once for all. A task holds one document and about PIECE characters of chunks.
    """
    body = atoms.where("is_heading is not null and text is not null").select("doc_id", "pos", "page", "is_heading", "text")
    rows = body.repartition("doc_id").sortWithinPartitions("doc_id", "pos").drop("pos")
    kind = atoms.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(_every, f"doc_id {kind}, granularity string, paragraph_index int, text string")
    return cut.select("granularity", granular_id(F.col("granularity")).alias("chunk_id"), "text")


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "granularity", "paragraph_index", "text"], [None, pa.string(), pa.int32(), pa.string()]
    own, out, size = None, [[], [], [], []], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
    for batch in batches:
        kinds[0] = batch["doc_id"].type
        for doc, page, is_heading, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "page", "is_heading", "text")), strict=True):
            if own is None or own.doc != doc:
                _cut(own, out)
                if size > PIECE:
                    yield give()
                    out, size = [[], [], [], []], 0
                own = Rechunk()
                own.doc = doc
            own.add(page, is_heading, text)
            size += len(GRANULARITIES) * len(text)
    _cut(own, out)
    if out[0]:
        yield give()


def _cut(own: Rechunk | None, out: list[list]) -> None:
    for g in GRANULARITIES if own else ():
        texts = [chunk[-1] for chunk in own.chunks(g)]
        for column, more in zip(out, ([own.doc] * len(texts), [g] * len(texts), range(len(texts)), texts), strict=True):
            column += more
