"""Message streams that keep the knowledge tables current: envelopes, dispatch, upserts and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loregraph.operators.chunking import tag_entities
from loregraph.operators.requests import K_CHANNEL, cited, rank_candidates, retrieve, split_hits
from loregraph.store import stored
from loregraph.streaming.index import indexed_search, merge
from loregraph.streaming.knowledge import CHUNK, CHUNKS, MENTIONS, Facts, add_facts, add_triplets, external_facts, keyed_edges, markdown_facts, merge_attrs
from loregraph.streaming.ledger import Change, Ledger, newest, stream_id

ROWS = "rows"

# Message types that have a handler.
TYPES = ("chunk.upsert", "graph.triplet", "graph_rag.query", "graphrag.query", "nl_cypher.ask", "external.ingest", "ingest.markdown", "ingest.bootstrap", "chunk.get")
QUERY = TYPES[3]
QUERIES = TYPES[2:4]


def envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """type and payload of JSON messages; the legacy shape {query or question, top_k} is a query. Other columns stay."""
    m = raw.withColumn("_m", F.from_json(value, "type string, payload string, query string, question string, top_k int"))
    asked = F.coalesce("_m.question", "_m.query")
    legacy = F.to_json(F.struct(asked.alias("question"), F.col("_m.top_k").alias("top_k")))
    out = m.withColumn("type", F.coalesce("_m.type", F.when(asked.isNotNull(), QUERY)))
    return out.withColumn("payload", F.coalesce("_m.payload", F.when(asked.isNotNull(), legacy))).drop("_m")


def dispatch(messages: DataFrame) -> DataFrame:
    """Add ``route``: the type if it has a handler, else dead_letter."""
    return messages.withColumn("route", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("dead_letter"))


def checked(messages: DataFrame) -> DataFrame:
    """Add ``route`` and ``error``: what keeps a message from its handler, null if nothing does. An error is a row, and the other messages go on."""
    m = dispatch(messages)
    p = F.try_parse_json("payload")
    at = lambda path: F.coalesce(F.trim(F.try_variant_get(p, f"$.{path}", "string")), F.lit(""))
    any_of = lambda *paths: F.concat(*(at(x) for x in paths))
    need = {
        ("chunk.get", "chunk.upsert"): (any_of("chunk_id"), "chunk_id required"),
        (*QUERIES, "nl_cypher.ask"): (any_of("question", "query"), "question required"),
        ("external.ingest",): (any_of("text", "content"), "text required"),
        ("ingest.markdown",): (any_of("markdown", "content"), "markdown required"),
    }
    error = F.when(F.col("route") == "dead_letter", F.concat(F.lit("unknown message type: "), F.coalesce("type", F.lit(""))))
    error = error.when(F.coalesce(F.schema_of_variant(p), F.lit("")).startswith("OBJECT") == F.lit(False), "malformed payload")
    for routes, (value, text) in need.items():
        error = error.when(F.col("route").isin(*routes) & (value == ""), text)
    ends = (at("subject.node_id") == "") | (at("object.node_id") == "")
    return m.withColumn("error", error.when((F.col("route") == "graph.triplet") & ends, "subject and object need a node_id"))


def latest_per_key(messages: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return newest(messages, key, order)


def upsert(spark: SparkSession, batch: DataFrame, path: str, number: int, stream: str = "batch") -> None:
    """Apply batch ``number`` of a stream to the keyed table at ``path`` (key, ts, seq, ...): of each key the last row counts,
    among the table's and the batch's. A batch that comes again changes nothing; another stream goes on where the table is."""
    Ledger(spark, path).transact(lambda change: change.upsert(ROWS, batch), stream, number)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the keyed table at ``path``; None if nothing has been written."""
    return Ledger(spark, path).table(ROWS)


def start_upserts(stream: DataFrame, path: str, checkpoint: str, route: str = "chunk.upsert") -> StreamingQuery:
    """Apply the messages of one route (key, payload, ts, seq) to the table at ``path``."""

    def apply(batch: DataFrame, number: int) -> None:
        own = dispatch(batch).where(F.col("route") == route).select("key", "payload", "ts", "seq")
        upsert(batch.sparkSession, own, path, number, stream_id(batch.sparkSession, checkpoint))

    return _start(stream, checkpoint, apply)


def _start(stream: DataFrame, checkpoint: str, apply) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


NODE = "struct<node_id: string, node_type: string, label: string, attributes: map<string, string>>"
TRIPLET = f"subject {NODE}, predicate string, relation string, object {NODE}, attributes map<string, string>"
EXTERNAL = "title string, source_url string, text string, markdown string, content string, graph_node_ids array<string>"
MARKDOWN = "markdown string, content string, source_path string, filename string, source_url string, factory string"
QUESTION = "question string, query string, top_k int, retrieval_queries array<string>"
UPSERT = "chunk_id string, text string, source string, factory string, chunk_type string, graph_node_ids array<string>, external boolean, source_url string, metadata map<string, string>"


def _null() -> Column:
    return F.lit(None).cast("string")


def triplet_facts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph.triplet messages with their attributes (attrs), a row for each time that a message names one (ts, seq)."""
    t = dispatch(messages).where("route = 'graph.triplet'").select("ts", "seq", F.from_json("payload", TRIPLET).alias("p")).where("p.subject.node_id is not null and p.object.node_id is not null")
    none = F.create_map().cast("map<string, string>")
    ends = t.select("ts", "seq", F.posexplode(F.array("p.subject", "p.object")).alias("end", "n"))
    # Where a message has a node twice, its object counts, as it comes last.
    ends = ends.groupBy("ts", "seq", F.col("n.node_id").alias("node_id")).agg(F.max_by("n", "end").alias("n"), F.max_by("n.attributes", "end").alias("_a"))
    nodes = ends.select("node_id", F.coalesce("n.node_type", F.lit("Entity")).alias("node_type"), F.coalesce("n.label", "n.node_id").alias("label"), F.coalesce("_a", none).alias("attrs"), "ts", "seq")
    edges = t.select(F.col("p.subject.node_id").alias("source"), F.coalesce("p.predicate", "p.relation", F.lit("RELATED_TO")).alias("relation"), F.col("p.object.node_id").alias("target"), F.coalesce("p.attributes", none).alias("attrs"), "ts", "seq")
    return nodes, edges


def triplet_rows(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, node_type, label, attrs) and edges (source, relation, target, attrs) of graph.triplet messages: of each the last
    message counts, and of attributes, which are merged, the last value."""
    nodes, edges = triplet_facts(messages)
    nodes = merge_attrs(nodes, "node_id").select("node_id", "node_type", "label", "attrs")
    return nodes, merge_attrs(keyed_edges(edges), "key").select("source", "relation", "target", "attrs")


def ingested_texts(messages: DataFrame, routes: tuple[str, ...] = ("external.ingest", "ingest.markdown")) -> DataFrame:
    """The texts of messages: title, source_url, text, explicit; blank ones are left out. Of one title the last message counts;
    texts without a title are told apart by their address or message, which their title then names."""
    m = dispatch(messages).where(F.col("route").isin(*routes)).select("key", "ts", "seq", F.from_json("payload", EXTERNAL).alias("p"))
    text = F.coalesce(F.nullif("p.text", F.lit("")), F.nullif("p.markdown", F.lit("")), "p.content")
    title = F.coalesce(F.nullif("p.title", F.lit("")), F.concat(F.lit("External source "), F.coalesce(F.nullif("p.source_url", F.lit("")), F.concat_ws("_", "key", "seq"))))
    m = m.select("ts", "seq", title.alias("title"), F.col("p.source_url").alias("source_url"), text.alias("text"), F.coalesce("p.graph_node_ids", F.array().cast("array<string>")).alias("explicit")).where("trim(text) <> ''")
    return m.groupBy("title").agg(F.max_by(F.struct("source_url", "text", "explicit"), F.struct("ts", "seq")).alias("r")).select("title", "r.*")


def markdown_documents(messages: DataFrame) -> DataFrame:
    """The documents of ingest.markdown messages: path, raw, source_url, factory; of one path the last message counts."""
    m = dispatch(messages).where("route = 'ingest.markdown'").select("key", "ts", "seq", F.from_json("payload", MARKDOWN).alias("p"))
    raw = F.coalesce(F.nullif(F.trim("p.markdown"), F.lit("")), F.trim("p.content"))
    path = F.coalesce(F.nullif("p.source_path", F.lit("")), F.nullif("p.filename", F.lit("")), F.concat(F.lit("upload_"), "key", F.lit("_"), "seq", F.lit(".md")))
    m = m.select("ts", "seq", path.alias("path"), raw.alias("raw"), F.col("p.source_url").alias("source_url"), F.col("p.factory").alias("factory")).where("raw <> ''")
    return m.groupBy("path").agg(F.max_by(F.struct("raw", "source_url", "factory"), F.struct("ts", "seq")).alias("r")).select("path", "r.*")


def document_facts(messages: DataFrame, lexicon: DataFrame) -> Facts:
    """What the documents of a batch say: ingest.markdown through the document parser, external.ingest as external texts."""
    return markdown_facts(markdown_documents(messages), lexicon).union(external_facts(ingested_texts(messages, ("external.ingest",)), lexicon))


def upserted_chunks(messages: DataFrame) -> DataFrame:
    """The chunks of chunk.upsert messages, of each id the last."""
    m = dispatch(messages).where("route = 'chunk.upsert'").select("ts", "seq", F.from_json("payload", UPSERT).alias("p")).where("p.chunk_id <> ''")
    meta = F.coalesce("p.metadata", F.create_map().cast("map<string, string>"))
    c = m.select("p.chunk_id", F.coalesce("p.text", F.lit("")).alias("text"), "p.source", _null().alias("source_id"), F.coalesce("p.chunk_type", F.lit("pdf_text")).alias("chunk_type"), "p.factory", F.coalesce("p.external", F.lit(False)).alias("external"), "p.source_url", meta["doc_id"].alias("doc_id"), meta["page"].try_cast("int").alias("page"), meta["paragraph_index"].try_cast("int").alias("paragraph_index"), F.coalesce("p.graph_node_ids", F.array().cast("array<string>")).alias("graph_node_ids"), meta.alias("metadata"), "ts", "seq")
    return newest(c, "chunk_id", ("ts", "seq"))


def asked_queries(messages: DataFrame) -> DataFrame:
    """Requests of query messages of both types, legacy ones too: query_id, q_idx, text (a row for each rewrite)."""
    q = dispatch(messages).where(F.col("route").isin(*QUERIES)).select(F.col("seq").alias("query_id"), F.from_json("payload", QUESTION).alias("p"))
    q = q.select("query_id", F.coalesce("p.question", "p.query").alias("question"), F.coalesce("p.retrieval_queries", F.array().cast("array<string>")).alias("more")).where("trim(question) <> ''")
    every = F.array_distinct(F.filter(F.concat(F.array("question"), F.col("more")), lambda x: F.trim(x) != ""))
    return q.select("query_id", F.posexplode(every).alias("q_idx", "text"))


def start_triplets(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the graph's nodes and edges at ``path`` current: nodes by id and edges by (source, relation, target), in one commit a batch."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        Ledger(spark, path).transact(lambda change: add_triplets(change, *triplet_facts(batch)), stream_id(spark, checkpoint), number)

    return _start(stream, checkpoint, apply)


def apply_messages(change: Change, messages: DataFrame, lexicon: DataFrame, part: str) -> None:
    """Stage what a batch of messages does to the knowledge base, and its errors, counts and found chunks as parts ``part``."""
    spark = change.ledger.spark
    every = stored(checked(messages).select("key", "ts", "seq", "type", "route", "payload", "error"))
    errors, good = every.where("error is not null"), every.where("error is null")
    at = every.agg(F.max("ts"), F.max("seq")).first()
    if at[1] is None:
        return
    facts, upserts = document_facts(good, lexicon), upserted_chunks(good)
    facts.chunks = facts.chunks.unionByName(upserts.select(*CHUNK).join(facts.chunks.select("chunk_id"), "chunk_id", "left_anti"))
    counts = add_facts(change, facts, at)
    nodes, edges = triplet_facts(good)
    add_triplets(change, nodes, edges)
    wanted = good.where("route = 'chunk.get'").select("key", "seq", F.try_variant_get(F.parse_json("payload"), "$.chunk_id", "string").alias("chunk_id"))
    there = change.read(CHUNKS)
    rows = wanted.where("false").withColumns({c: _null() for c in ("text", "source", "chunk_type", "display_ref")}) if there is None else cited(wanted.join(there.drop("key", "seq", "ts"), "chunk_id")).select("key", "seq", "chunk_id", "text", "source", "chunk_type", "display_ref")
    lost = wanted.join(rows.select("seq"), "seq", "left_anti").select("key", "seq", F.lit("chunk.get").alias("route"), F.concat(F.lit("chunk not found: "), "chunk_id").alias("error"), _null().alias("payload"))
    change.put("errors", errors.select("key", "seq", "route", "error", "payload").unionByName(lost).withColumn("part", F.lit(part)))
    change.put("found", rows.withColumn("part", F.lit(part)))
    change.put("counts", spark.createDataFrame([(part, *(counts[k] for k in ("chunks", "nodes", "edges")))], "batch string, chunks long, nodes long, edges long").withColumn("part", F.lit(part)))


def start_messages(stream: DataFrame, lexicon: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply the stream's messages of every kind but questions to the knowledge base at ``path``: nodes, edges, chunks, mentions and the postings
    index, with tables of errors, counts and found chunks, in one commit a batch."""

    def apply(batch: DataFrame, number: int) -> None:
        ledger, name = Ledger(batch.sparkSession, path), stream_id(batch.sparkSession, checkpoint)
        ledger.transact(lambda change: apply_messages(change, batch, lexicon, f"{name}-{number}"), name, number)
        merge(ledger)

    return _start(stream, checkpoint, apply)


def answers(asked: DataFrame, ledger: Ledger, lexicon: DataFrame, k: int = 8) -> DataFrame | None:
    """The whole retrieval plan over the knowledge base as it is: query_id, position, chunk_id, score, channels, highlight, display_ref.

    asked: query_id, q_idx, text. Text channels come from the postings index, the graph channel from the passages' mentions.
    """
    change = Change(ledger, ledger.state())  # one version for all reads
    chunks = change.read(CHUNKS)
    each = asked.select(F.concat_ws("#", "query_id", "q_idx").alias("query_id"), "text")
    hits = indexed_search(each, change, K_CHANNEL)
    if chunks is None or hits is None:
        return None
    mentions = change.read(MENTIONS)
    nodes = tag_entities(asked.select(F.col("query_id").alias("chunk_id"), "text"), lexicon).withColumnRenamed("chunk_id", "query_id").distinct()
    rows = chunks.select("chunk_id", "text", "source", "chunk_type", "source_url", "metadata")
    cands = rank_candidates(asked, rows.select("chunk_id", "text"), None if mentions is None else stored(nodes), mentions, k_out=k, hits=split_hits(hits, asked.schema["query_id"].dataType.simpleString()))
    return retrieve(cands, k).join(cited(rows).select("chunk_id", "display_ref"), "chunk_id", "left")


def start_queries(stream: DataFrame, lexicon: DataFrame, path: str, out: str, checkpoint: str, k: int = 8) -> StreamingQuery:
    """Answer the stream's requests from the knowledge base at ``path``, in a folder of answers under ``out`` for each batch.

    A batch reads the buckets of its terms in the postings index; no text is split but the requests'.
    """

    def apply(batch: DataFrame, number: int) -> None:
        found = answers(stored(asked_queries(batch)), Ledger(batch.sparkSession, path), lexicon, k)
        if found is not None:
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(stream, checkpoint, apply)


def step_status(events: DataFrame) -> DataFrame:
    """The status of each step (request_id, step_id, status, ts, seq) and the seconds from the request's first event to the step's last.

    A later event of another step closes a step that is still running.
    """
    at = F.struct("ts", "seq")
    whole = events.groupBy("request_id").agg(F.min("ts").alias("_first"), F.max(F.struct("ts", "seq", "step_id")).alias("_end"))
    last = events.groupBy("request_id", "step_id").agg(F.max_by("status", at).alias("status"), F.max(at).alias("_last"))
    closed = (F.col("status") == "running") & (F.col("_end.step_id") != F.col("step_id"))
    status = F.when(closed, "done").otherwise(F.col("status"))
    return last.join(whole, "request_id").select("request_id", "step_id", status.alias("status"), (F.unix_timestamp("_last.ts") - F.unix_timestamp("_first")).alias("elapsed"))


STEPS = "request_id long, step_id string, status string, elapsed double"


class _Steps(StatefulProcessor):
    """The steps of one request: each event sets its own step and closes the others that are running; changed steps are given out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at double")
        self.last = handle.getValueState("last", "step_id string, at double, seq long")
        self.steps = handle.getMapState("steps", "step_id string", "status string, at double, seq long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"])
        known = self.first.get() if self.first.exists() else None
        first = min(events["at"].iloc[0], known[0]) if known else events["at"].iloc[0]
        end = tuple(self.last.get()) if self.last.exists() else None
        before = {k[0]: tuple(v) for k, v in self.steps.iterator()}
        steps = dict(before)
        for step, status, at, seq in zip(events["step_id"], events["status"], events["at"], events["seq"], strict=True):
            if step not in steps or (steps[step][1], steps[step][2]) <= (at, seq):
                steps[step] = (status, float(at), int(seq))
            if end is None or (end[1], end[2]) <= (at, seq):
                end = (step, float(at), int(seq))
        out = []
        for step, (status, at, seq) in steps.items():
            closed = "done" if status == "running" and step != end[0] else status
            if before.get(step) != (closed, at, seq) or (known and first != known[0]):
                self.steps.updateValue((step,), (closed, at, seq))
                out.append((key[0], step, closed, float(int(at) - int(first))))
        self.first.update((float(first),))
        self.last.update(end)
        yield pd.DataFrame(out, columns=["request_id", "step_id", "status", "elapsed"])

    def close(self) -> None:
        pass


def step_stream(events: DataFrame) -> DataFrame:
    """A stream of step events (request_id, step_id, status, ts, seq) as a stream of the steps that change, with state for each request.

    The last row of a step is what ``step_status`` gives for all events. Late events count by their time, as there.
    """
    e = events.select("request_id", "step_id", "status", F.col("ts").cast("timestamp").cast("double").alias("at"), "seq")
    return e.groupBy("request_id").transformWithStateInPandas(statefulProcessor=_Steps(), outputStructType=STEPS, outputMode="Update", timeMode="None")
