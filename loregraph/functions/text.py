"""Column functions over text: tokens, slugs, splitting, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token classes of the data model.
TOKEN = r"[a-zA-Zа-яА-ЯёЁ0-9]+"
EXPANSION_TOKEN = TOKEN + r"(?:[-+]\d+)?"
SENTENCE_END = r"(?<=[.!?…])\s+(?=[«\"А-ЯA-Z0-9])|(?<=\.)\s*\n+\s*(?=[А-ЯA-Z])"


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (trim drops spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokenize(c: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def slug(*parts: Column) -> Column:
    """Parts joined by _, lower case, anything but letters, digits, _ and + as _, runs of _ squeezed, ends trimmed."""
    joined = F.lower(F.concat_ws("_", *parts))
    squeezed = F.regexp_replace(F.regexp_replace(joined, r"(?U)[^\w+]+", "_"), "_+", "_")
    return F.regexp_replace(squeezed, "^_+|_+$", "")


def normalize_size_class(c: Column) -> Column:
    return F.regexp_replace(strip(F.replace(c, F.lit("мкм"), F.lit(""))), r"\s+", " ")


def metal_from_header(c: Column) -> Column:
    """Ni or Cu from a column header that names element 28 or 29, or gives its tonnes."""
    named = lambda n: c.contains(f"Элемент {n}") | (c.contains(", т") & c.contains(str(n)))
    return F.when(named(28), "Ni").when(named(29), "Cu")


def split_windows(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Stretches of ``size`` characters, each starting size - overlap after the last; stripped, without empty ones."""
    t = strip(c)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: strip(F.substring(t, s + 1, F.lit(size)))), lambda p: p != "")


def split_sentences(c: Column, least: int = 40) -> Column:
    """Sentences; a piece shorter than ``least`` characters is joined to the one before it. Pieces ahead of the first long
    one wait for it: together they begin it, and they stand before it twice, as the data model has it."""
    pieces = F.filter(F.transform(F.split(strip(c), SENTENCE_END), strip), lambda p: p != "")
    start = F.named_struct(F.lit("done"), F.array().cast("array<string>"), F.lit("ahead"), F.lit("").cast("string"))

    def join(state: Column, piece: Column) -> Column:
        done, ahead = state["done"], state["ahead"]
        cand = F.when(ahead != "", F.concat_ws(" ", ahead, piece)).otherwise(piece)
        short = F.length(cand) < least
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(done, F.lit(-1)), cand)))
        whole = F.concat(done, F.array(F.when(ahead != "", F.concat_ws(" ", ahead, cand)).otherwise(cand)))
        next_done = F.when(short & (F.size(done) > 0), longer).when(short, done).otherwise(whole)
        next_ahead = F.when(short & (F.size(done) == 0), cand).otherwise("")
        return F.named_struct(F.lit("done"), next_done, F.lit("ahead"), next_ahead)

    def end(state: Column) -> Column:
        return F.when((F.size(state["done"]) == 0) & (state["ahead"] != ""), F.array(state["ahead"])).otherwise(state["done"])

    return F.aggregate(pieces, start, join, end)


def split_paragraphs(c: Column, least: int = 80) -> Column:
    """Blocks between blank lines; one shorter than ``least`` without closing punctuation is joined to the one before it."""
    pieces = F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")

    def join(done: Column, piece: Column) -> Column:
        loose = (F.length(piece) < least) & ~piece.rlike(r"[.!?»\"]$")
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws("\n", F.try_element_at(done, F.lit(-1)), piece)))
        return F.when((F.size(done) > 0) & loose, merged).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), join)


def split_blocks(c: Column) -> Column:
    """Blocks between blank lines; a text that has no blank line gives its lines."""
    blocks = F.filter(F.transform(F.split(c, r"\n\s*\n+"), strip), lambda p: p != "")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p != "")
    return F.when(F.size(blocks) > 1, blocks).otherwise(lines)


def join_spaced_letters(c: Column) -> Column:
    """Collapse blanks; where five single letters stand in a row, drop all blanks between characters."""
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(flat.rlike(r"(?U)(?:\b\w\s){4,}\w\b"), F.regexp_replace(flat, r"(?<=\S)\s(?=\S)", "")).otherwise(flat)


def is_noise(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) < 8) | t.startswith("![") | t.rlike(r"(?U)^[\d\W]+$")


def needs_reextraction(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    spaced = c.rlike(r"(?U)(?:\b\w\s){4,}\w\b")
    return (F.length(strip(c)) < 80) | spaced | (letters < F.lit(0.35) * F.length(c))


def frontmatter(c: Column) -> Column:
    """The ``key: value`` lines between the leading --- marks as a map of strings; the last of equal keys counts."""
    head = F.regexp_extract(c, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda p: F.instr(p, ":") > 1)

    def pair(p: Column) -> Column:
        key, value = strip(F.substring_index(p, ":", 1)), strip(p.substr(F.instr(p, ":") + 1, F.length(p)))
        return F.named_struct(F.lit("key"), key, F.lit("value"), F.regexp_replace(value, r"^[\"'](.*)[\"']$", "$1"))

    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def image_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def strip_images(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""))


def excerpt(c: Column, most: int = 320) -> Column:
    t = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def highlight(query: Column, text: Column, most: int = 120) -> Column:
    """A snippet around the longest query token of over 3 characters that the text holds (ties: the first in order), else its start."""
    longer = F.filter(F.array_distinct(tokenize(query)), lambda t: F.length(t) > 3)
    ranked = F.transform(F.sort_array(F.transform(longer, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    head = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)

    def cut(low: Column, token: Column) -> Column:
        at = F.instr(low, token)
        start = F.greatest(at - 40, F.lit(1))
        snippet = strip(F.substring(text, start, at + F.length(token) + 80 - start))
        short = F.when(F.length(snippet) > most, F.concat(F.substring(snippet, 1, most - 1), F.lit("…"))).otherwise(snippet)
        return F.when(token.isNull(), head).otherwise(short)

    # The text is searched from the longest token on, until one is found, and lower-cased once: what a lambda names without
    # being given it is worked out again for each token.
    first = lambda low: F.aggregate(ranked, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() & (F.instr(low, t) > 0), t).otherwise(best))
    given = lambda c, f: F.transform(F.array(c), f)[0]
    return given(F.lower(text), lambda low: given(first(low), lambda token: cut(low, token)))


def embed_text(text: Column, summary: Column, questions: Column) -> Column:
    return F.concat_ws("\n", text, F.nullif(summary, F.lit("")), F.nullif(F.array_join(questions, " "), F.lit("")))


def json_from_output(c: Column) -> Column:
    """The first JSON array or object in a model's output, without code fences; the stripped output where there is none."""
    plain = strip(F.regexp_replace(c, r"```[a-zA-Z]*", ""))
    found = F.regexp_extract(plain, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.when(found != "", found).otherwise(plain)


def source_entry(c: Column) -> tuple[Column, Column]:
    """(title, url) of a source string."""
    url = F.nullif(F.regexp_extract(c, r"(https?://\S+)", 1), F.lit(""))
    return strip(F.regexp_replace(c, r"\s*[(\[]?https?://\S+[)\]]?", "")), url


def roadmap_steps(c: Column) -> Column:
    """Numbered lines as structs (order, title of at most 120 characters)."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p.rlike(r"^\d+[.)]\s+\S"))
    return F.transform(lines, lambda p, i: F.struct((i + 1).alias("order"), F.substring(F.regexp_replace(p, r"^\d+[.)]\s+", ""), 1, 120).alias("title")))


# Source types by chunk type, and the ids of page chunks.
SOURCE_TYPES = {"excel_bucket": "excel", "pdf_text": "pdf", "book_text": "book", "scheme_caption": "scheme", "constraint_regulation": "regulation", "constraint_budget": "constraint", "constraint_example": "example", "external_text": "external"}
PAGE_CHUNK = r"_p(\d+)_(\d+)$"


def citation(chunk_id: Column, source: Column, chunk_type: Column, text: Column, meta: Column, source_url: Column) -> Column:
    """A struct with source, type, place (page, paragraph, cell by metal, sheet), excerpt of at most 320 characters and
    display_ref. Page and paragraph come from the metadata (map), else from the chunk's id."""
    number = lambda c: F.expr("null") if c is None else c.try_cast("int")
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    kind = F.coalesce(kinds[chunk_type], chunk_type)
    own, by_id = number(meta["paragraph_index"]), chunk_id.rlike(PAGE_CHUNK)
    paragraph = F.coalesce(own, F.when(by_id, number(F.regexp_extract(chunk_id, PAGE_CHUNK, 2))))
    page = F.coalesce(number(meta["page"]), F.when(own.isNull() & by_id, number(F.regexp_extract(chunk_id, PAGE_CHUNK, 1))))
    cell = F.coalesce(F.when(meta["metal"] == "Ni", meta["excel_cell_ni"]).otherwise(meta["excel_cell_cu"]), meta["excel_cell"])
    name, t = F.coalesce(F.nullif(source, F.lit("")), chunk_id), strip(text)
    ref = F.concat_ws(", ", name, F.concat(F.lit("стр. "), page), F.concat(F.lit("§"), paragraph + 1), F.concat(F.lit("ячейка "), cell), F.when(kind == "external", source_url), F.concat(F.lit("лист «"), meta["sheet"], F.lit("»")))
    cut = F.when(F.length(t) > 320, F.concat(F.left(t, F.lit(319)), F.lit("…"))).otherwise(t)
    return F.struct(name.alias("source"), kind.alias("source_type"), page.alias("page"), paragraph.alias("paragraph_index"), cell.alias("excel_cell"), meta["sheet"].alias("sheet"), cut.alias("excerpt"), ref.alias("display_ref"))


def confidence(score: Column) -> Column:
    """A fifth of the score, 1 at most; 0.7 without one."""
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, 0.7).otherwise(F.least(F.lit(1.0), score / 5))


def impact_band(share: Column) -> Column:
    return F.when(share >= 0.85, "high").when(share >= 0.7, "medium").otherwise("low")


def novelty(c: Column) -> Column:
    low = F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("medium")))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")
