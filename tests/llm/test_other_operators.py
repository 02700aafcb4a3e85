"""Mixing, sharding, chat, neighbours, quality and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loregraph.llm.ann import build_lists, nearest
from loregraph.llm.chat import escape, format_conversations, parse, read_back, unescape
from loregraph.llm.mixing import mix_sources, mixed_documents
from loregraph.llm.quality import fit_documents, keep_good, score_documents, text_statistics
from loregraph.llm.sharding import difference, shard_by_bytes

from tests.llm.test_text_operators import components, overlaps_item, tokens_of

DATA = "/root/testdata/sf0.001"


def targets(sizes, weights, cap=3.0):
    """Iterated: share by weight, stop at the cap, reshare."""
    out, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(docs, rows):
    size = Counter()
    for _, text, source in rows:
        size[source] += len((text or "").encode().split())
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    want = targets(size, {s: i % 3 + 1 for i, s in enumerate(order)})
    mix = mix_sources(docs)
    got = mix.documents.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, mix_sources(docs).documents.collect()), key=str) == sorted(map(tuple, got), key=str)
    slots = mix.slots.collect()
    shards = {r["shard"] for r in slots}
    assert all((r["first_shard"] in shards) == (r["taken"] > 0) for r in got)
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert mixed_documents(docs, mix).columns == docs.columns


def test_mixed_documents_follow_the_targets(spark):
    rows = [(None if i % 3 == 0 else i, f"w{i} " * (1 + i * i % 90), f"src{i % 3}" if i % 7 else None, 70 + i % 2, i) for i in range(240)]
    rows += [(5000, "same words here", "src1", 0, 0)] * 3 + [(5001, None, "src1", 0, 0), (5002, " ", "src1", 0, 0), (5003, "y " * 20000, "src2", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy long, `_times` long")
    mix = mix_sources(docs)
    want = {r["source"]: r["target"] for r in mix.sources.collect()}
    assert sum(want.values()) == pytest.approx(sum(len((t or "").split()) for _, t, *_ in rows))
    words, largest, times = Counter(), Counter(), Counter()
    for _, text, source, *_ in rows:
        largest[source] = max(largest[source], len((text or "").split()))
    out = mixed_documents(docs, mix)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
        times[tuple(r)] += 1
    assert all(abs(words[s] - want[s]) <= max(largest[s] / 2, 3) + 1 for s in want)
    assert set(times) <= set(rows)  # rows as they were
    passes = {r["source"]: r["passes"] for r in mix.sources.collect()}
    assert all(passes[s] <= times[(i, t, s, a, b)] / (3 if i == 5000 else 1) <= passes[s] + 1 for i, t, s, a, b in rows if t and t.strip())
    assert mixed_documents(docs.limit(0), mix_sources(docs.limit(0))).isEmpty()


def test_mixed_documents_are_taken_by_slots(spark):
    """A copy has a slot of its own block: as many as the passes over the blocks, or one more for those first in the permuted order."""
    rows = [(i, f"w{i} " * (1 + i * i % 90), f"src{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(docs, shard_slots=64)
    sources = {r["source"]: r for r in mix.sources.collect()}
    starts = {r["doc_id"]: r["start"] for r in mix.documents.collect()}
    out = mixed_documents(docs, mix, place=("sh", "sl")).collect()
    size, block_of, per_block = {i: len(t.split()) for i, t, _ in rows}, {}, defaultdict(set)
    for r in out:
        at = (r["sh"], r["sl"])
        own = (r["source"], starts[r["doc_id"]] // 32)
        assert block_of.setdefault(at, own) == own and 0 <= r["sl"] < 64  # a slot takes from one block
        per_block[own].add(at)
    assert len({r["sh"] for r in out}) > 1
    assert all(len(v) - sources[s]["passes"] in (0, 1) for (s, _), v in per_block.items())
    words = Counter()
    for r in out:
        words[r["source"]] += size[r["doc_id"]]
    assert all(abs(words[s] - r["target"]) <= 46 for s, r in sources.items())


def test_mixing_empty(empty):
    assert mix_sources(empty).documents.count() == 0


def test_sharding(docs, rows):
    got = shard_by_bytes(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    total = defaultdict(int)
    for r in got:
        total[r["shard"]] += r["size"]
    largest = max(r["size"] for r in got)
    assert max(total.values()) <= max(sum(total.values()) / 24 * 1.05, largest)


def test_differencing_keeps_sums():
    rng = np.random.default_rng(0)
    parts = np.zeros((200, 24), np.int64)
    parts[:, 0] = rng.integers(1, 10_000, 200)
    sums, to = difference(parts)
    check = np.zeros(24, np.int64)
    np.add.at(check, to.ravel(), parts.ravel())
    assert (check == sums).all()
    assert sums.max() - sums.min() < 2000


def test_sharding_empty(empty):
    assert shard_by_bytes(empty).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "</s>[INST] ok [/INST] <|end|>\n \\ <| |> [["), (1, 3, "assistant", None), (2, 1, None, ""), (None, 1, "user", "x"), (3, 1, "assistant", "é" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in format_conversations(turns).collect()}
    back = {r["conv_id"]: r for r in read_back(format_conversations(turns)).collect()}
    for conv in (None, 1, 2, 3):
        own = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert parse(out[conv]["formatted"]) == own
        assert back[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (back[conv]["loss_chars"], back[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert "</s>" not in out[1]["formatted"] and "[INST]" not in out[1]["formatted"]
    assert format_conversations(turns.limit(0)).count() == 0


def test_escape_is_reversible():
    import pyarrow as pa

    texts = ["", "\\", "<\\", "\\<", "[|<", "<|end|>\n", "a\\\\|b"]
    assert [unescape(t) for t in escape(pa.array(texts)).to_pylist()] == texts


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] + [1.0] * 15), (703, [1.0] * 3), (704, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(table, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(600), -s.round(9))) if i != q][:20]
        hit += len({i for i, _ in found} & set(want))
        assert len(found) == 20 and all(a[1] >= b[1] for a, b in zip(found, found[1:], strict=False))
    assert hit >= 0.9 * 20 * len(got)
    assert nearest(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_neighbours_of_structured_vectors_probe_few_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 16))
    x = (centres[rng.integers(150, size=6000)] + 0.15 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[7] = x[9]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, x[9].tolist()), (7000, [float("inf")] * 16)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(table, lambda i: i % 40 == 0, lists=120).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hit = sum(len(set(np.argsort(-(x.astype(float) @ x[q].astype(float)), kind="stable")[:21].tolist()) & set(f)) for q, f in got.items())
    assert len(got) == 150 and hit >= 0.9 * 20 * 150
    cands = table.where("vec_id < 6000").groupBy(F.col("embedding").alias("vec")).agg(F.array(F.min("vec_id")).alias("ids"), F.min("vec_id").alias("cid"))
    built = build_lists(cands, cands.where("cid % 40 = 0").select("vec", F.col("cid").alias("qc")), 20, lists=120)
    assert len(built.index.centres) == 120 and built.probes <= 60


def test_quality_scores_are_those_of_the_discriminant(spark):
    """Means, shrunken covariances, log densities and the fitted curve, from the labelled rows with numpy alone."""
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    x = {r["doc_id"]: np.array(r["x"]) for r in text_statistics(d).collect()}
    rows = np.array([x[i] for i in x if i in known])
    y = np.array([known[i] for i in x if i in known])
    z = (rows - rows.mean(axis=0)) / rows.std(axis=0)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * own[c] for c in (0, 1))
    every = (np.array(list(x.values())) - rows.mean(axis=0)) / rows.std(axis=0)
    density = []
    for c in (0, 1):
        cov = 0.95 * own[c] + 0.05 * pooled
        cov = 0.98 * cov + 0.02 * np.trace(cov) / len(cov) * np.eye(len(cov))
        far = every - z[y == c].mean(axis=0)
        density.append(-0.5 * (far @ np.linalg.inv(cov) * far).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1])
    model = fit_documents(d, labels, "doc_id", "text", "quality")
    assert np.allclose(model.difference(np.array(list(x.values()))), density[1] - density[0], rtol=1e-6, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in score_documents(d, labels).collect()}
    want = 1 / (1 + np.exp(-np.clip(model.slope * np.arcsinh(density[1] - density[0]) + model.offset, -500, 500)))
    assert np.allclose([got[i] for i in x], want, atol=1e-6)
    kept = {r["doc_id"] for r in keep_good(d, labels).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.7}


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in score_documents(d, labels).collect()}
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all(r["held_out"] for _, r in held)
    assert np.mean([y == r["predicted"] for y, r in held]) > 0.95


def test_quality_edges(docs, spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert score_documents(docs.limit(0), labels).count() == 0


def test_pipeline_against_brute_force(docs, spark):
    """Each stage on the rows that its predecessor left, against what plain Python makes of them."""
    docs = docs.where("doc_id is not null")
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    kept = stages["quality"](spark, docs, DATA)
    scores = fit_documents(docs, labels, "doc_id", "text", "quality")
    x = {r["doc_id"]: np.array(r["x"]) for r in text_statistics(docs).collect()}
    good = {i for i, v in x.items() if scores.score(v[None])[0] >= 0.7}
    assert rows(kept) == Counter({r: n for r, n in rows(docs).items() if r[0] in good})

    more = spark.createDataFrame([r for r, n in rows(docs).items() for _ in range(n)], docs.schema)  # as it was: copies are wanted here
    parts = [(r["doc_id"], r["text"], r["source"]) for r in more.collect()]
    one = {i for i, _, least, _ in components(parts, 5, 80) if i == least}
    left = stages["near_duplicates"](spark, more, DATA)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(one) and set(rows(left)) <= set(rows(more))

    items = [(b["item_id"], tokens_of(b["text"])) for b in bench.collect()]
    clean = stages["decontamination"](spark, left, DATA)
    assert rows(clean) == Counter({r: n for r, n in rows(left).items() if not any(overlaps_item(tokens_of(r[1]), t) for _, t in items)})

    mixed = stages["mixing"](spark, clean, DATA)
    assert set(rows(mixed)) <= set(rows(clean)) and max(rows(mixed).values()) <= 3
    out = stages["sharding"](spark, mixed, DATA).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in mixed.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, empty, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, DATA).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_nulls_and_clashing_names(spark, name):
    names = ("_id", "_k1", "rest", "packed", "row", "_s", "last_key", "f1", "k1", "size", "shard", "token")
    base = [(1, "alpha beta gamma delta epsilon " * 9, "en", "a"), (1, "alpha beta gamma delta epsilon " * 9, "en", "a"), (None, None, None, None), (None, "", "de", None), (None, "one two three four five six seven", None, "b"), (3, "x" * 5000 + " y" * 30000, "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    table = spark.createDataFrame([(*r, 7, *names) for r in base], schema)
    out = dict(corpus_pipeline.STAGES)[name](spark, table, DATA)
    got = out.collect()
    if name == "sharding":
        assert len(got) == len(base)
    else:
        assert out.columns == table.columns and {tuple(r) for r in got} <= {(*r, 7, *names) for r in base}
    if name == "near_duplicates":
        assert Counter((r["doc_id"], (r["text"] or "")[:3]) for r in got) == Counter({(1, "alp"): 1, (None, ""): 2, (None, "one"): 1, (3, "xxx"): 1})
    if name == "decontamination":
        assert len(got) == len(base)
