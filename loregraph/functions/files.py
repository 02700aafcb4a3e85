"""Files as table rows: their type, and their content as Markdown."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loregraph.functions.text import strip

# The kinds of files by suffix, and the languages of code.
KINDS = {
    "pdf": ["pdf"],
    "docx": ["docx"],
    "xlsx": ["xlsx"],
    "xls": ["xls"],
    "csv": ["csv", "tsv"],
    "image": "png jpg jpeg gif bmp tiff tif webp".split(),
    "code": "py js ts jsx tsx c cpp h hpp java go rs rb php swift kt scala r sql css scss less html htm xml svg json yaml yml dockerfile makefile cmake".split(),
    "text": "txt md rst log cfg ini toml conf properties env sh bash zsh fish bat cmd ps1".split(),
    "binary": "exe dll so dylib bin dat pyc pyo class o obj lib a zip tar gz bz2 7z rar xz lz lz4 zst mp3 wav ogg flac aac wma mp4 avi mov mkv wmv flv webm ttf otf woff woff2 eot ico icns cur db sqlite sqlite3 mdb pkl pickle joblib h5 hdf5 pt pth onnx pb tflite".split(),
}
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "h": "c", "hpp": "cpp", "rs": "rust", "rb": "ruby", "kt": "kotlin", "htm": "html", "svg": "xml", "yml": "yaml"}


def suffix(name: Column) -> Column:
    """The lower-cased suffix without its dot; empty where a name has none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def is_text(content: Column, sample: int = 1024) -> Column:
    """No NUL and over 90% printable ASCII in the first ``sample`` characters; an empty content is text."""
    head = F.left(content, F.lit(sample))
    printable = F.length(F.regexp_replace(head, r"[^ -~\t\n\r]", ""))
    return (F.length(head) == 0) | ((F.instr(head, "\x00") == 0) & (printable > 0.9 * F.length(head)))


def file_type(name: Column, content: Column) -> Column:
    """The kind by suffix, else by a look at the content (null: not read), else text."""
    known = F.create_map(*[F.lit(x) for kind, ends in KINDS.items() for end in ends for x in (end, kind)])
    return F.coalesce(known[suffix(name)], F.when(content.isNotNull() & (content != ""), F.when(is_text(content), "text").otherwise("binary")), F.lit("text"))


def code_language(name: Column) -> Column:
    """The language of a code file's suffix; empty for other files."""
    known = F.create_map(*[F.lit(x) for end in KINDS["code"] for x in (end, LANGUAGES.get(end, end))])
    return F.coalesce(known[suffix(name)], F.lit(""))


def fenced(language: Column | str, content: Column) -> Column:
    return F.concat(F.lit("```"), language if isinstance(language, Column) else F.lit(language), F.lit("\n"), content, F.lit("\n```\n"))


@F.pandas_udf(StringType())
def _set_out(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            out = text and json.dumps(json.loads(text), ensure_ascii=False, indent=2)
            return out and out.encode().decode()
        except (ValueError, RecursionError):  # no JSON, half a surrogate pair, or too deep
            return text

    return texts.map(one)


def pretty_json(content: Column) -> Column:
    """Valid JSON with one member a line and two blanks for each level, members in their order; other texts as they are.

    Spark's JSON writer keeps neither order nor nested levels of a value without a schema, so batches go through Python's.
    """
    return _set_out(content)


def markdown_cell(value: Column) -> Column:
    """A number as a cell: whole ones without decimals, null as nothing."""
    return F.coalesce(F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string")), F.lit(""))


def markdown_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, value) -> markdown of each table; short rows are filled with empty cells, and the first is the head."""
    by_row = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_cells"), F.max("col").alias("_last"))
    widest = by_row.groupBy(*keys).agg(F.max("_last").alias("_width"), F.collect_list(F.struct("row", "_cells")).alias("_rows"))

    def line(r: Column) -> Column:
        at = F.map_from_entries(r["_cells"])
        return F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_width")), lambda c: F.coalesce(at[c], F.lit(""))), " | "), F.lit(" |"))

    lines = F.transform(F.array_sort("_rows"), line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("_width") + 1))
    return widest.select(*keys, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n").alias("markdown"))


def clean_output(said: Column) -> Column:
    """What counts of a model's answer: the first fenced block, else a diagram from its first word on, else the table's lines, else all."""
    t = strip(said)
    block = F.regexp_extract(t, r"(?s)```(?:mermaid)?\s*\n(.*?)\n\s*```", 1)
    diagram = F.regexp_extract(t, r"(?i)((?:graph |flowchart |sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie)[\s\S]*)", 1)
    diagram = F.regexp_replace(diagram, r"(?s)\n\s*\n\s*(The user|Let me|I need|Okay|Looking|The prompt|Analyze|Based on|This is).*", "")
    table = F.array_join(F.filter(F.split(t, "\n"), lambda p: p.rlike(r"^\s*\|")), "\n")
    has_table = t.rlike(r"(?m)^\s*\|.*\|\s*$")
    return F.when(block != "", strip(block)).when(diagram != "", strip(diagram)).when(has_table, strip(table)).otherwise(t)


Converter = Callable[[Column, Column], Column]

#: kind -> function of (name, content) that gives Markdown.
CONVERTERS: dict[str, Converter] = {
    "text": lambda name, content: fenced("text", content),
    "code": lambda name, content: fenced(code_language(name), F.when(suffix(name) == "json", pretty_json(F.when(suffix(name) == "json", content))).otherwise(content)),
    "csv": lambda name, content: fenced("csv", content),
}


def convert_files(files: DataFrame, converters: dict[str, Converter] | None = None) -> DataFrame:
    """Files (name, content) -> name, kind, success, markdown and errors. A kind without a converter and content that
    is missing or isn't text give a row with an error; the others go on."""
    registry = CONVERTERS if converters is None else converters
    f = files.withColumn("kind", file_type(F.col("name"), F.col("content")))
    markdown = F.lit(None).cast("string")
    for kind, convert in registry.items():
        markdown = F.when(F.col("kind") == kind, convert(F.col("name"), F.col("content"))).otherwise(markdown)
    error = F.when(~F.col("kind").isin(*registry), F.concat(F.lit("No converter for file type: "), "kind")).when(F.col("content").isNull(), "File has no content").when(F.instr("content", "\x00") > 0, "File is not valid UTF-8 text")
    f = f.withColumns({"_error": error, "_markdown": markdown})
    return f.select("name", "kind", F.col("_error").isNull().alias("success"), F.when(F.col("_error").isNull(), F.col("_markdown")).alias("markdown"), F.filter(F.array("_error"), lambda e: e.isNotNull()).alias("errors"))
