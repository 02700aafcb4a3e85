"""Streams of messages give what the batch gives: keyed tables, knowledge base, postings index, errors and answers."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from loregraph.operators.requests import hybrid_search, rewrite_hits
from loregraph.plans import ingest_queries as N
from loregraph.plans import knowledge_queries as K
from loregraph.plans import source_queries as Q
from loregraph.plans import views as V
from loregraph.streaming import index as X
from loregraph.streaming import ingest as I
from loregraph.streaming.knowledge import add_triplets
from loregraph.streaming.ledger import KEEP, Change, Ledger

DATA = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def fed(spark, messages, root, files=3):
    """The messages as a stream of several batches."""
    messages.repartition(files).write.parquet(f"{root}/in")
    return I.envelopes(spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))


def done(query):
    query.awaitTermination(300)
    assert query.exception() is None


def keyed(spark, *rows):
    return spark.createDataFrame(rows, "key string, payload string, ts long, seq long")


def held(spark, path):
    return {r["key"]: r["payload"] for r in I.current(spark, path).collect()}


def test_stream_equals_batch(spark):
    root = folder()
    stream = fed(spark, Q.messages(spark, DATA), root, 4)
    done(I.start_upserts(stream.select("key", "type", "payload", "ts", "seq"), f"{root}/table", f"{root}/checkpoint"))
    want = Q.st3(spark, DATA)
    assert sorted(map(tuple, I.current(spark, f"{root}/table").select("key", "payload", "seq").collect())) == sorted(map(tuple, want.collect()))


def test_bad_and_legacy_messages(spark):
    rows = [('{"type": "chunk.get", "payload": "p"}',), ('{"query": "q", "top_k": 3}',), ('{"question": "q"}',), ('{"type": "nope"}',), ("not json",)]
    out = I.dispatch(I.envelopes(spark.createDataFrame(rows, "value string"))).select(F.col("route")).collect()
    assert [r["route"] for r in out] == ["chunk.get", I.QUERY, I.QUERY, "dead_letter", "dead_letter"]


def test_upserts_touch_their_buckets_only(spark):
    path = folder() + "/t"
    I.upsert(spark, keyed(spark, *((f"k{i}", "old", 1, i) for i in range(300))), path, 0)
    before = Ledger(spark, path).state()["tables"][I.ROWS]
    for _ in range(2):  # a batch that comes again changes nothing
        I.upsert(spark, keyed(spark, ("k5", "new", 2, 0), ("k6", "late", 0, 0), ("k999", "more", 2, 1)), path, 1)
    assert held(spark, path) == {f"k{i}": "old" for i in range(300)} | {"k5": "new", "k999": "more"}
    after = Ledger(spark, path).state()
    assert after["version"] == 2 and 1 <= sum(before.get(b) != f for b, f in after["tables"][I.ROWS].items()) <= 3


def test_a_new_checkpoint_goes_on_where_the_table_is(spark):
    path = folder() + "/t"
    for number in range(3):
        I.upsert(spark, keyed(spark, *((f"k{i}", f"old{number}", number, i) for i in range(50))), path, number, "first")
    I.upsert(spark, keyed(spark, *((f"k{i}", "new", 9, i) for i in range(50))), path, 0, "second")
    assert held(spark, path) == {f"k{i}": "new" for i in range(50)}
    I.upsert(spark, keyed(spark, ("k1", "again", 10, 0)), path, 2, "first")  # the first stream's last batch once more
    assert held(spark, path)["k1"] == "new"


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark):
    path = folder() + "/t"
    ledger = Ledger(spark, path)
    I.upsert(spark, keyed(spark, ("a", "1", 1, 1), ("b", "1", 1, 2)), path, 0)

    def dies(change):
        change.upsert(I.ROWS, keyed(spark, ("a", "2", 2, 1)))
        raise InterruptedError

    with pytest.raises(InterruptedError):
        ledger.transact(dies, "batch", 1)
    assert held(spark, path) == {"a": "1", "b": "1"} and ledger.sweep(1e6) == 0
    assert ledger.sweep(0) == 1 and held(spark, path) == {"a": "1", "b": "1"}
    I.upsert(spark, keyed(spark, ("a", "2", 2, 1)), path, 1)
    assert held(spark, path) == {"a": "2", "b": "1"}


def test_two_writers_and_old_files(spark):
    """A commit that another one overtakes is worked out again; what no late version names is removed."""
    path = folder() + "/t"
    ledger, raced = Ledger(spark, path), []

    def slow(change):
        if not raced:
            raced.append(True)
            I.upsert(spark, keyed(spark, ("a", "fast", 1, 1)), path, 0, "other")
        change.upsert(I.ROWS, keyed(spark, ("a", "slow", 2, 1), ("b", "slow", 2, 1)))

    ledger.transact(slow, "batch", 0)
    assert held(spark, path) == {"a": "slow", "b": "slow"} and ledger.state()["version"] == 2
    for i in range(1, 6):
        I.upsert(spark, keyed(spark, ("a", str(i), i + 2, 1)), path, i)
    assert len(ledger.versions()) == KEEP and len(ledger.files.names(f"{path}/{I.ROWS}")) >= KEEP
    assert held(spark, path) == {"a": "5", "b": "slow"}
    live = {f"{f}/part={p}" for p, f in ledger.state()["tables"][I.ROWS].items()}
    there = {f"{f}/{p}" for f in ledger.files.names(f"{path}/{I.ROWS}") for p in ledger.files.names(f"{path}/{I.ROWS}/{f}") if p.startswith("part=")}
    assert live <= there and len(there) <= len(live) + KEEP


def test_triplets_as_a_stream(spark):
    root = folder()
    messages = N.triplet_messages(spark, DATA)
    done(I.start_triplets(fed(spark, messages, root), f"{root}/graph", f"{root}/checkpoint"))
    ledger = Ledger(spark, f"{root}/graph")
    for table, want, key in zip(("nodes", "edges"), I.triplet_rows(I.envelopes(messages)), (["node_id", "node_type", "label"], ["source", "relation", "target"]), strict=True):
        rows = lambda df: sorted((*(r[c] for c in key), sorted(r["attrs"].items())) for r in df.select(*key, "attrs").collect())  # noqa: E731, B023
        assert rows(ledger.table(table)) == rows(want)


def test_index_equals_a_corpus_after_interleaved_upserts(spark):
    """Answers from segments, with chunks replaced, taken out, put in again and segments merged, are those of the corpus as it is."""
    ledger = Ledger(spark, folder() + "/kb")
    every = V.paragraphs(spark, DATA).select("chunk_id", "text")
    part = lambda n, i: every.where(F.pmod(F.xxhash64("chunk_id"), F.lit(n)) == i)
    queries = V.eval_queries(spark, DATA)
    steps = [part(2, 0), part(2, 1), part(5, 1).withColumn("text", F.concat("text", F.lit(" new words "), "chunk_id")), part(7, 2).withColumn("text", F.lit(None).cast("string")), part(7, 2).withColumn("text", F.reverse("text")), part(11, 3).withColumn("text", F.lit(""))]
    now = every.limit(0)
    for i, batch in enumerate(steps):
        ledger.transact(lambda change, batch=batch: X.add_chunks(change, batch))
        now = now.join(batch.select("chunk_id"), "chunk_id", "left_anti").union(batch.where("text is not null"))
        if i == 3:
            assert X.merge(ledger, most=2) and not X.merge(ledger, most=8)
    assert len(ledger.state()["facts"]["segments"]) < len(steps)
    found = X.indexed_search(queries, Change(ledger, ledger.state()), 20)
    key = ["query_id", "chunk_id", "rank"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, hybrid_search(queries, now, 20).select(key).collect()))


def envelope(kind, **payload):
    return json.dumps({"type": kind, "payload": json.dumps(payload)})


def test_messages_of_every_kind_and_their_errors(spark):
    """A malformed payload of each route leaves one error row and the rest goes on; questions of both types are answered."""
    book = "---\ndoc_id: book7\nsource: Handbook\n---\nschkeit and eaux\n---chunk---\npage: 4\n---\nungl, schkeit again"
    book = "---\ndoc_id: book7\nsource: Handbook\n---\nschkeit and eaux\n---chunk---\nungl, schkeit again\n"
    bucket = "---\nfactory: F1\nsize_class: +71\nmineral_form: pyrite\nmetal: Ni\ntonnes: 5\n---\n"
    good = [
        envelope("graph.triplet", subject={"node_id": "mech_a", "label": "A", "attributes": {"x": "1", "y": "1"}}, predicate="LIKES", object={"node_id": "process_a"}, attributes={"w": "2"}),
        envelope("graph.triplet", subject={"node_id": "mech_a", "attributes": {"y": "2"}}, object={"node_id": "mech_b"}),
        envelope("ingest.markdown", markdown=book, source_path="in/book7.md"),
        envelope("ingest.markdown", markdown=bucket, filename="bucket.md"),
        envelope("external.ingest", title="Note", text="schkeit with eaux\nand ungl", source_url="https://x.org/n"),
        envelope("external.ingest", text="untitled eaux", source_url="https://x.org/1"),
        envelope("external.ingest", text="untitled ouche", source_url="https://x.org/2"),
        envelope("chunk.upsert", chunk_id="own_1", text="a chunk about eaux", chunk_type="book_text", source="Own", graph_node_ids=["process_a"], metadata={"page": "3"}),
        envelope("chunk.get", chunk_id="own_1"),
        envelope("ingest.bootstrap"),
    ]
    bad = [envelope(t) for t in ("chunk.get", "chunk.upsert", "graph.triplet", "graph_rag.query", "graphrag.query", "nl_cypher.ask", "external.ingest", "ingest.markdown")]
    bad += [json.dumps({"type": t, "payload": "{broken"}) for t in I.TYPES] + [envelope("nope"), "not json", envelope("chunk.get", chunk_id="lost")]
    rows = [(i, i, i, v) for i, v in enumerate(good + bad)]
    messages = spark.createDataFrame(rows, "key long, t long, seq long, value string").select("key", F.timestamp_seconds("t").alias("ts"), "seq", "value")
    root = folder()
    done(I.start_messages(fed(spark, messages, root, 1), V.lexicon(spark), f"{root}/kb", f"{root}/checkpoint"))
    ledger = Ledger(spark, f"{root}/kb")
    errors = {r["seq"]: r["error"] for r in ledger.table("errors").collect()}
    assert sorted(errors) == list(range(len(good), len(good) + len(bad))) and ledger.table("errors").count() == len(bad)
    assert errors[len(rows) - 1] == "chunk not found: lost" and errors[len(good)] == "chunk_id required" and errors[len(good) + 8] == "malformed payload"
    nodes = {r["node_id"]: r for r in ledger.table("nodes").collect()}
    assert nodes["mech_a"]["attrs"] == {"x": "1", "y": "2"} and nodes["lossform_f1_+71_pyrite_ni"]["attrs"]["tonnes"] == "5.0"
    assert {"source_handbook", "source_external_note", "passage_book_book7_i0", "passage_book_book7_i1", "passage_own_1", "mech_b"} <= set(nodes)
    edges = {(r["source"], r["relation"], r["target"]): r["attrs"] for r in ledger.table("edges").collect()}
    assert edges["mech_a", "LIKES", "process_a"] == {"w": "2"} and ("mech_a", "RELATED_TO", "mech_b") in edges
    assert {("passage_book_book7_i0", "NEXT_PASSAGE", "passage_book_book7_i1"), ("passage_book_book7_i0", "PART_OF", "source_handbook")} <= set(edges)
    assert all(s in nodes and t in nodes for s, r, t in edges if r in ("EVIDENCED_BY", "MENTIONS"))
    chunks = {r["chunk_id"]: r for r in ledger.table("chunks").collect()}
    assert sum(c["source"].startswith("External source https://x.org/") for c in chunks.values()) == 2
    got = ledger.table("found").collect()
    assert [(r["chunk_id"], r["text"], r["display_ref"]) for r in got] == [("own_1", "a chunk about eaux", "Own, стр. 3")]
    assert ledger.table("counts").first()["chunks"] == len(chunks)

    asked = [(1, 1, 1, envelope("graph_rag.query", question="eaux and schkeit")), (2, 2, 2, envelope("graphrag.query", question="ungl", retrieval_queries=["ouche"])), (3, 3, 3, json.dumps({"query": "own chunk"}))]
    messages = spark.createDataFrame(asked, "key long, t long, seq long, value string").select("key", F.timestamp_seconds("t").alias("ts"), "seq", "value")
    out = folder()
    done(I.start_queries(fed(spark, messages, out, 2), V.lexicon(spark), f"{root}/kb", f"{out}/answers", f"{out}/checkpoint"))
    found = spark.read.parquet(f"{out}/answers").collect()
    assert {r["query_id"] for r in found} == {1, 2, 3} and all(r["display_ref"] for r in found)


def test_documents_as_a_stream(spark):
    """Several batches give the chunks, nodes and evidence of one."""
    messages = K.document_messages(spark, DATA)
    runs, catalog = [], V.lexicon(spark).select("node_id", F.lit("Entity").alias("node_type"), F.col("node_id").alias("label"), F.create_map().cast("map<string, string>").alias("attrs"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(0).cast("long").alias("seq"))
    nothing = catalog.limit(0).select(F.col("node_id").alias("source"), F.col("node_type").alias("relation"), F.col("label").alias("target"), "attrs", "ts", "seq")
    for files in (1, 2):
        root = folder()
        Ledger(spark, f"{root}/kb").transact(lambda change: add_triplets(change, catalog, nothing))  # passages mention entities that are there
        done(I.start_messages(fed(spark, messages, root, files), V.lexicon(spark), f"{root}/kb", f"{root}/checkpoint"))
        ledger = Ledger(spark, f"{root}/kb")
        edges = ledger.table("edges").where("relation in ('PART_OF', 'MENTIONS')").select("source", "relation", "target")
        runs.append([sorted(map(tuple, df.collect())) for df in (ledger.table("chunks").select("chunk_id"), ledger.table("nodes").select("node_id"), edges)])
    assert runs[0] == runs[1] and all(runs[0])


def test_answers_are_those_of_the_batch(spark):
    """A query stream over the index gives the hybrid hits of a search over all chunks."""
    few = I.envelopes(N.query_messages(spark, DATA).where("key < 6"))
    chunks = V.paragraphs(spark, DATA)
    ledger = Ledger(spark, folder() + "/kb")
    ledger.transact(lambda change: X.add_chunks(change, chunks.select("chunk_id", "text")))
    asked = I.asked_queries(few)
    each = asked.select(F.concat_ws("#", "query_id", "q_idx").alias("query_id"), "text")
    got = I.split_hits(X.indexed_search(each, Change(ledger, ledger.state()), 60), "long").where("rank <= 8")
    want = rewrite_hits(asked, chunks).where("rank <= 8")
    key = ["query_id", "q_idx", "chunk_id", "rank"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_steps_as_a_state_machine(spark):
    """Events in several batches, late ones too, leave each step as windows over all events do; a later step closes running ones."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root = folder()
    events = K.step_events(spark, DATA)
    events.repartition(3, "seq").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/n={number}")

    done(I.step_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    got = spark.read.parquet(f"{root}/out").groupBy("request_id", "step_id").agg(F.max_by(F.struct("status", "elapsed"), "batch").alias("r")).select("request_id", "step_id", "r.*")
    want = I.step_status(events).withColumn("elapsed", F.col("elapsed").cast("double")).collect()
    assert {r["status"] for r in want} == {"running", "done"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
