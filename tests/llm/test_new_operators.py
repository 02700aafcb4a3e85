"""MinHash near duplicates, the Merkle manifest and vector codes against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.llm import merkle as M
from loregraph.llm import minhash as H
from loregraph.llm import vector_codes as C

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- near duplicates


def shingles(text, k):
    w = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked(rows, k, percent):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and (find(i) not in least or doc < least[find(i)]):
            least[find(i)] = doc
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def variants(n, words=120, changed=3, seed=1):
    """Texts that share most of one stock text, each with a few own words."""
    rng = np.random.default_rng(seed)
    base = [f"s{i}" for i in range(words)]
    for i in range(n):
        own = list(base)
        for at in rng.integers(0, words, changed):
            own[at] = f"v{i}_{at}"
        yield " ".join(own)


def test_near_duplicates_equal_all_pairs(spark, docs, rows):
    more = [(20000 + i, t) for i, t in enumerate(variants(60))] + [(None, "a null id " * 9), (None, "another null id " * 9), (30001, "a null id " * 9)]
    every = docs.select("doc_id", "text", "rank").union(spark.createDataFrame(more, "doc_id long, text string").withColumn("rank", F.lit("clash")))
    plain = [(r["doc_id"], r["text"]) for r in every.collect()]
    for percent in (80, 85):
        got = H.near_duplicates(every, percent=percent)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        out = got.collect()
        assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == key(linked(plain, 5, percent))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_large_buckets_and_clusters_in_blocks(spark, monkeypatch):
    """Stock texts fill buckets of several blocks; links across blocks, and of texts outside a cluster's largest component, are found."""
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "GROUP", 8)
    texts = [*variants(90, changed=2), *variants(60, changed=6, seed=2), *variants(40, changed=9, seed=3)]
    plain = list(enumerate(texts))
    got = H.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string"), percent=85).collect()
    want = linked(plain, 5, 85)
    assert len({c for _, _, c in want}) > 3
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(want)


def test_bands_meet_at_the_threshold():
    """Pairs of just the similarity asked for share a band of each collection."""
    m = H.bands(85)
    assert 2 * m * H.ROWS_PER_BAND < 100 and (1 - (1 - 0.85**H.ROWS_PER_BAND) ** m) ** 2 > 1 - 2e-6
    rng = np.random.default_rng(5)
    for trial in range(300):
        both, own = rng.integers(0, 1 << 63, 170, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 15), dtype=np.uint64)
        a, b = np.sort(np.concatenate([both, own[0]])), np.sort(np.concatenate([both, own[1]]))
        h = H.band_hashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), m)
        same = h[0] == h[1]
        assert same[:m].any() and same[m:].any(), trial


def test_minhashes_agree_as_often_as_sets(docs):
    """The share of equal bands is the similarity to the power of a band's rows."""
    rng = np.random.default_rng(7)
    both, own = rng.integers(0, 1 << 63, 600, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 200), dtype=np.uint64)
    a, b = np.concatenate([both, own[0]]), np.concatenate([both, own[1]])
    h = H.band_hashes(np.concatenate([a, b]), np.array([0, 800, 1600]), 3000, rows=1)
    assert abs((h[0] == h[1]).mean() - 0.6) < 0.03


def test_one_very_long_text(spark):
    """Texts longer than a segment: a near copy is linked, another isn't."""
    rng = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 120_000))
    assert len(long) > 1 << 19
    rows = [(1, long), (2, long + " tail"), (3, " ".join(long.split()[:70_000])), (4, "short text")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}


def test_near_duplicates_of_nothing(spark, empty):
    assert H.near_duplicates(empty).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """(root, siblings of each node level by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(at):
            lo = j - j % arity
            paths[i].append(("".join(nodes[lo:j]), "".join(nodes[j + 1 : lo + arity])))
            at[i] = j // arity
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""
    groups = {}
    for r in rows:
        d, s, g, n, t = r
        bad = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(g, []).append(((d is not None, d or 0), plain_leaf(r), plain_leaf((d, s, g, n + 1, t)) if bad else None, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], arity) for g in names}
    root, tops = climb([trees[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, leaf, claimed, d), path in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1], strict=True):
            h, path = claimed or leaf, path + top
            for left, right in path:
                h = digest(left, h, right)
            out.append((d, leaf, trees[g][0], root, digest(*(x + y for x, y in path)), h, h == root))
    return key(out)


def manifest(df, **how):
    altered = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in M.FIELDS]
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, M.leaf(altered))
    m = M.merkle_manifest(df, claimed=claimed, **how).withColumn("f", M.fold(F.col("claimed"), F.col("path")))
    return key(map(tuple, m.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("path")), "f", F.col("f") == F.col("root")).collect()))


@pytest.mark.parametrize("arity, width", [(2, 256), (2, 4), (3, 9), (2, 2)])
def test_manifest_equals_plain_trees(spark, docs, arity, width):
    """Trees of several rounds of blocks, odd last runs, null groups, ids and fields, repeated rows and equal ids, a clashing column."""
    more = [(None, None, None, None, None), (None, "é", "en", 3, "x"), (5, "s", "zz", None, "ü"), (5, "s", "zz", 2, "ü"), (5, "s", "zz", 2, "ü"), (6, "s", "", 1, "alone"), (7, "s", "é", 1, "t" * 700_000)]
    own = docs.select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    every = own.union(spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string"))
    every = every.withColumns({"tree": F.lit("clash"), "digest": F.lit(1), "pos": F.lit(None).cast("int")})
    want = plain_manifest([tuple(r)[:5] for r in every.collect()], arity)
    assert manifest(every, arity=arity, width=width) == want
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_little(spark, docs):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest(spark.createDataFrame([], schema)) == []
    row = [(1, "s", "en", 1, "x")]
    assert manifest(spark.createDataFrame(row, schema)) == plain_manifest(row)
    assert M.op12_merkle(spark, DATA).where("not verified").count() > 0


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, entries=256, rounds=4):
    """(vec_id, code, error), label errors and the digest, by Python integers."""
    kept = [(i, lab, [int(np.floor(float(x) * 1024)) for x in v]) for i, lab, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2]) // 4
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[list(part(v, p)) for _, _, v in kept[:entries]] for p in range(4)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(part(v, p), book)[0], []).append(part(v, p))
            for e, xs in own.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, labels = [], {}
    for i, lab, v in kept:
        found = [near(part(v, p), b) for p, b in enumerate(books)]
        error = sum(f for _, f in found)
        labels[lab] = labels.get(lab, 0) + error
        out.append((i, lab, "".join(f"{at:02x}" for at, _ in found), error))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return key(out), labels, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1.0, 3e4])
def test_codes_equal_plain_integers(spark, size):
    """Ties and repeated rows, null and odd vectors, null labels and ids; large components need several limbs."""
    rng = np.random.default_rng(1)
    rows = [(int(i), int(i) % 3 if i % 5 else None, (rng.normal(size=16) * size).astype(np.float32).tolist()) for i in rng.permutation(400)]
    rows += rows[:40] + [(7, 1, rows[3][2]), (None, 1, rows[5][2])]
    odd = [(901, 1, None), (902, 1, []), (903, 1, [None] * 16), (904, 1, [float("nan")] * 16), (905, 1, [float("inf")] * 16), (906, 1, [1.0] * 8)]
    schema = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame(rows + odd, schema).repartition(5).withColumns({"code": F.lit(1), "vec": F.lit("clash")})
    out, books = C.vector_codes(df)
    want, _, sha = plain_codes(rows)
    assert key(map(tuple, out.collect())) == want and books.digest() == sha


def test_codes_of_little(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert C.vector_codes(spark.createDataFrame([(1, 1, None)], schema))[0].count() == 0
    few = [(2, None, [0.5] * 8), (1, 1, [-0.5] * 8)]
    out, books = C.vector_codes(spark.createDataFrame(few, schema))
    assert key(map(tuple, out.collect())) == [(1, 1, "00000000", 0), (2, None, "01010101", 0)] and len(books.books[0]) == 2
    with pytest.raises(ValueError, match="too large"):
        C.fixed_point(np.array([[1e30]]), 1024)


@pytest.mark.parametrize("bits", [10, 25, 28])
def test_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (n, 16)) for n in (50, 70))
    assert (C.exact_products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a])).all()
    at, far = C.nearest(a, b)
    plain = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)) for c in b] for r in a]
    assert at.tolist() == [p.index(min(p)) for p in plain] and far.tolist() == [min(p) for p in plain]


def test_label_errors(spark):
    got = C.op13_codes(spark, DATA).toPandas()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    want, labels, sha = plain_codes(rows)
    of = {i: labels[lab] for i, lab, _, _ in want}
    assert set(got["codebooks_sha256"]) == {sha} and {int(i): int(e) for i, e in zip(got["vec_id"], got["label_error"], strict=True)} == of


