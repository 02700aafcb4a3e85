"""Operators on texts against brute force over every row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.llm import suffix_dedup
from loregraph.llm.decontaminate import decontaminate, overlaps
from loregraph.llm.licenses import TEMPLATES, reliability, scan_licenses, unknown_lines
from loregraph.llm.licenses import _held as held_licenses
from loregraph.llm.licenses import train as train_licenses
from loregraph.llm.ngram_join import jaccard_components, keep_one
from loregraph.llm.substring import remove_repeats
from loregraph.llm.suffix_dedup import repeated_passages


def words(text):
    return (text or "").encode().split()


def components(rows, k, percent):
    sets = []
    for _, text, _ in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    holders, root, links = defaultdict(list), list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links.update([i, j])
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = defaultdict(lambda: 1 << 62)
    for i, (doc_id, _, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc_id)
    return Counter((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, k, percent):
    got = Counter(tuple(r) for r in jaccard_components(docs, k, percent).collect())
    assert got == components(rows, k, percent)


def test_keep_one(docs, rows):
    want = {doc_id for doc_id, _, component, _ in components(rows, 5, 80) if doc_id == component}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_keep_one_with_null_and_repeated_ids(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (1, text("d")), (2, text("e")), (2, text("f")), (3, text("g")), (3, text("g")), (None, ""), (None, None), (4, " ")]
    got = Counter(tuple(r) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (1, text("d")), (2, text("e")), (2, text("f")), (3, text("g")), (None, ""), (None, None), (4, " ")]
    assert got == Counter(want)


def covered(rows, span):
    seen = Counter(tuple(w[s : s + span]) for w in (words(t) for _, t, _ in rows) for s in range(len(w) - span + 1))
    for doc_id, text, _ in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if seen[tuple(w[s : s + span])] > 1:
                gone[s : s + span] = [True] * span
        yield doc_id, w, gone


def test_substring_dedup(docs, rows):
    want = Counter((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for i, w, g in covered(rows, 35))
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == want


def test_suffix_dedup(docs, rows):
    want = Counter((i, len(w), sum(g)) for i, w, g in covered(rows, 50))
    got = repeated_passages(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_repeated").collect()) == want
    assert all(r["n_repeated"] == sum(s["size"] for s in r["spans"]) for r in got.collect())


def test_suffix_dedup_with_frequent_stock_text(spark):
    own = lambda tag, n: " ".join(f"{tag}-{j}" for j in range(n))
    rows = [(i, f"{own(f'a{i}', 20)} {own(f'footer{i % 8}', 30)} {own(f'b{i}', 30)}", None) for i in range(640)]
    rows += [(1000 + i, f"{own(f'p{i // 2}', 20)} {own(f'footer{i // 2 % 8}', 30)} {own(f'q{i}', 30)}", None) for i in range(160)]
    want = {i: sum(g) for i, _, g in covered(rows, 50)}
    assert sum(want.values()) == 160 * 50
    got = repeated_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeated"] for r in got.collect()} == want


def test_suffix_dedup_across_partitions(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PARTITION_ROWS", 150)
    want = Counter((i, len(w), sum(g)) for i, w, g in covered(rows, 50))
    got = repeated_passages(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_repeated").collect()) == want


def test_decontamination_finds_substituted_passages(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    w = item.split()
    w[5], w[13] = "changed", "other"
    more = spark.createDataFrame([(1, "before " + " ".join(w) + " after"), (2, "before " + " ".join(w[:8])), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in overlaps(more, bench).collect()}
    assert set(got) == {(1, 1)}
    assert (got[1, 1]["doc_start"], got[1, 1]["n_tokens"], got[1, 1]["n_matches"]) == (1, 20, 18)
    assert sorted(r["doc_id"] for r in decontaminate(more, bench).collect()) == [2, 3]
    short = {r["doc_id"] for r in overlaps(docs, bench).collect()}
    assert {9006, 9007} <= short


def test_decontamination_finds_inner_parts_in_many_short_documents(spark):
    item = [f"item{i}" for i in range(59)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    parts = [(100 * size + start, start, size) for size in (12, 16, 20) for start in range(59 - size + 1)]
    docs = spark.createDataFrame([(i, " ".join(item[start : start + size])) for i, start, size in parts], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["doc_start"], r["item_start"], r["n_matches"]) for r in overlaps(docs, bench).collect()}
    assert got == {(i, 0, start, size) for i, start, size in parts}
    assert decontaminate(docs, bench).isEmpty()


def test_decontamination_finds_verbatim_items(spark, docs, rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = {(i, b["item_id"]) for i, t, _ in rows for b in bench.collect() if t and b["text"] in t}
    got = {(r["doc_id"], r["item_id"]) for r in overlaps(docs, bench).collect()}
    assert want <= got


def tokens_of(text):
    return [t for t in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]


def overlaps_item(text, item, least=12, identity=0.75, mismatch=-2):
    """Whether the best stretch of some diagonal counts, and a spaced seed (or a whole short item) hits on it."""
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in ("110110101111", "111010011011", "101101110111", "111101101101")]
    if len(item) < 8:
        return False
    places = defaultdict(list)
    for i, t in enumerate(item):
        places[t].append(i)
    for d in {p - q for p, t in enumerate(text) for q in places.get(t, ())}:
        lo, hi = max(d, 0), min(d + len(item), len(text))
        same = [text[p] == item[p - d] for p in range(lo, hi)]
        whole = len(item) < 12 and len(same) == len(item) and all(same)
        if not whole and not any(p + 12 <= len(same) and all(same[p + i] for i in m) for p in range(len(same)) for m in masks):
            continue
        best, start, score, found = 0, 0, 0, (0, 0)
        for p, s in enumerate(same):
            score += 1 if s else mismatch
            if score < 0:  # a stretch is as long as it can be
                score, start = 0, p + 1
            elif score > best:
                best, found = score, (start, p + 1)
        matches, n = sum(same[found[0] : found[1]]), found[1] - found[0]
        enough = min(least, (len(item) + 1) // 2) if len(item) >= 16 else min(least, len(item))
        if matches >= enough and matches >= identity * n:
            return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 9, 14, 20, 45, 60])))) for i in range(30)]
    docs = []
    for i in range(400):
        part = rng.choice(items)[1].split()
        lo = rng.randrange(len(part))
        part = part[lo : lo + rng.randint(1, 60)]
        part = [rng.choice(words) if rng.random() < rng.choice([0, 0.1, 0.25]) else w for w in part]
        docs.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 40)), *part, *rng.choices(words, k=rng.randint(0, 40))])))
    docs += [(900, None), (901, ""), (902, items[5][1]), (902, items[5][1]), (903, "w1 " * 40000)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([*items, (77, None)], "item_id long, text string")
    want = Counter((i, k) for i, t in docs for k, item in items if overlaps_item(tokens_of(t), tokens_of(item)))
    assert 50 < len(want) and Counter((r["doc_id"], r["item_id"]) for r in overlaps(table, bench).collect()) == want
    assert Counter(r["doc_id"] for r in decontaminate(table, bench).collect()) == Counter(i for i, _ in docs if i not in {i for i, _ in want})
    assert overlaps(table.limit(0), bench).isEmpty() and overlaps(table, bench.limit(0)).isEmpty()


def test_licenses(spark):
    rows = [(1, "intro text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing to see"), (4, None), (5, ""), (6, "a driving license was lost\nunder the bridge"), (2, "All rights reserved")]
    got = Counter((r["doc_id"], r["paragraph"], r["family"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1, "Apache-2.0"), (2, 0, "GPL-3.0"), (2, 0, "Proprietary")])


def test_licenses_in_wrapped_and_joined_lines(spark):
    """Every planted notice is found in its family, wrapped or beside another, among words of real texts; few others are."""
    rng = random.Random(5)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    filler = [w for t in unknown_lines(d)[:300] for w in t.split()]
    notices = [(f, t) for f, group in TEMPLATES.items() for t in group]
    rows, want = [], Counter()
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 3)):
            family, text = rng.choice(notices)
            w, k = text.split(), rng.randint(3, 6)
            parts += [" ".join(rng.choices(filler, k=rng.randint(2, 12))), text if rng.random() < 0.5 else "\n".join(" ".join(w[j : j + k]) for j in range(0, len(w), k))]
            want[i, family] += 1
        parts.append(" ".join(rng.choices(filler, k=20)))
        rows.append((i, rng.choice([". ", "\n", " "]).join(parts)))
    rows.append((1000, "Licensed under the MIT License " + "word " * 50000 + "Licensed under the MIT License"))
    want[1000, "MIT"] += 2
    got = Counter((r["doc_id"], r["family"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    both = sum((got & want).values())
    assert both >= 0.98 * sum(want.values()) and both >= 0.97 * sum(got.values())


def test_license_probabilities_are_calibrated(spark):
    lines = unknown_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    model = train_licenses(lines)
    x, labels = held_licenses(model, lines[1::2], 60, np.random.default_rng(99))
    unknown = labels == len(TEMPLATES)
    accuracy, gap = reliability(model, x, labels)
    assert unknown.sum() > 300 and accuracy > 0.97 and gap < 0.03
    best, p, share = model.judge(x)
    found = (best < len(TEMPLATES)) & (p >= 0.6) & (share >= 0.6)
    assert found[unknown].mean() < 0.01 and (found & (best == labels))[~unknown].mean() > 0.95


@pytest.mark.parametrize("run", [lambda d: jaccard_components(d), remove_repeats, repeated_passages, scan_licenses])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_all_rows_alike(spark):
    one = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same words " * 40).alias("text"))
    assert {r["component_id"] for r in jaccard_components(one).collect()} == {0}
    assert {r["n_removed"] for r in remove_repeats(one).collect()} == {80}
    assert {r["n_repeated"] for r in repeated_passages(one).collect()} == {80}
