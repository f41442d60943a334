"""Retrieval for batches of questions: exact lookup, vector top-k, their union, reranking, answers and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import report as R
from plumbline.operators.align import dot
from plumbline.session import dealt
from plumbline.settings import DEFAULT, Settings

#: Chunks: collection, id, text, pid, revision_label, type, page, note_number, embedding. Questions: query_id, collection, question, embedding.
CHUNK = ["collection", "id", "text", "pid", "revision_label", "type", "page", "note_number"]


def element_chunks(elements: DataFrame, collection: str | Column) -> DataFrame:
    name = F.lit(collection) if isinstance(collection, str) else collection
    return elements.filter(~X.blank(F.col("text"))).select(
        name.alias("collection"), "id", "text", "pid", F.nullif(F.coalesce(F.col("revision_label") if "revision_label" in elements.columns else F.lit(""), F.lit("")), F.lit("")).alias("revision_label"),
        "type", F.col("bbox.page").alias("page"), F.coalesce(F.col("attributes")["note_number"], F.lit("")).alias("note_number"),
    )


def delta_chunks(deltas: DataFrame, collection: str, pairs: DataFrame) -> DataFrame:
    """Changes with a text as chunks. pairs: pair_id, pid_a, pid_b; a chunk's pid names both documents."""
    named = R.text_bearing(deltas).join(dealt(pairs.select("pair_id", "pid_a", "pid_b")), "pair_id")
    return named.select(
        F.lit(collection).alias("collection"), R.chunk_id().alias("id"), R.sentence().alias("text"), F.concat("pid_a", F.lit("→"), "pid_b").alias("pid"), F.lit(None).cast("string").alias("revision_label"),
        F.col("element_type").alias("type"), F.coalesce(R.page(), F.lit(0)).alias("page"), F.lit("").alias("note_number"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Rows of both by key; the newest stays. ``version`` orders rows of one key; else ``new`` beats ``old``."""
    keys = keys or ["collection", "id"]
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    order = [F.col(version).desc()] if version else []
    order += [F.col("_turn").desc(), *[F.col(c).desc() for c in old.columns if c not in keys and "map" not in str(old.schema[c].dataType).lower()]]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n", "_turn")


def exact_lookup(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, id of chunks whose whole text is a label in the question, or whose note it names."""
    shared = ["collection"]
    by_text = questions.select("query_id", "collection", F.explode(F.transform(X.tag_tokens(F.col("question")), F.lower)).alias("k"))
    by_note = questions.select("query_id", "collection", F.explode(X.note_numbers(F.col("question"))).alias("k"))
    texts = chunks.select("collection", "id", F.lower(X.strip(F.col("text"))).alias("k"))
    notes = chunks.filter("note_number <> ''").select("collection", "id", F.col("note_number").alias("k"))
    found = by_text.join(texts, [*shared, "k"]).unionByName(by_note.join(notes, [*shared, "k"]))
    return found.select("query_id", "id").distinct().withColumn("score", F.lit(1.0)).withColumn("source", F.lit("exact"))


#: Chunks of one block of a collection.
BLOCK_ROWS = 20_000
#: Bytes up to which passages are sent to every executor.
SENT_BYTES = 32 << 20
ANCHOR = 16


def holding(docs: DataFrame, passages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Documents (text) with each passage (column ``passage``) that their text contains.

    Passages are counted first: up to ``sent_bytes`` they go to all executors, beyond that a text's pieces meet the
    passages' beginnings by hash, and what meets is compared whole.
    """
    size, least = passages.agg(F.sum(F.octet_length("passage")), F.min(F.length("passage"))).first()
    whole = F.contains(F.col("text"), F.col("passage"))
    if not least or size <= sent_bytes:
        return docs.join(F.broadcast(passages), whole)
    n = min(least, ANCHOR)
    last = F.length("text") - n + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.substring("text", i, F.lit(n))))
    pieces = docs.withColumn("_anchor", F.explode(F.array_distinct(hashes)))
    return pieces.join(passages.withColumn("_anchor", F.xxhash64(F.substring("passage", 1, n))), "_anchor").filter(whole).drop("_anchor")


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = DEFAULT.retrieved, blocks: int | None = None) -> DataFrame:
    """query_id, id, score of the k nearest chunks by cosine of unit vectors, exactly; ties by id.

    A collection's chunks are dealt into blocks (by default one for each BLOCK_ROWS chunks) and its questions go to each
    of them, so one large collection is no one task's work. The k best of a question and block are found first, so what
    meets in the end is k rows a block.
    """
    blocks = blocks or chunks.count() // BLOCK_ROWS + 1
    q = questions.filter("embedding is not null").select("query_id", "collection", F.col("embedding").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    c = chunks.filter("embedding is not null").select("collection", "id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    scored = c.join(q, ["collection", "block"]).select("query_id", "block", "id", F.greatest(F.lit(0.0), dot(F.col("qv"), F.col("embedding"))).alias("score"))
    best = [F.col("score").desc(), "id"]
    inside = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*best))).filter(F.col("rank") <= k)
    order = Window.partitionBy("query_id").orderBy(*best)
    return inside.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", F.lit("vector").alias("source"))


def hybrid(exact: DataFrame, vector: DataFrame) -> DataFrame:
    """Exact rows, then vector rows whose chunk isn't among them."""
    return exact.unionByName(vector.join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti"))


def reranked(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """What an answer is made from: all exact rows, and the best vector rows (column ``rerank``) up to the budget."""
    exact = found.filter("source = 'exact'")
    used = exact.groupBy("query_id").agg(F.count("*").alias("used"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "id")
    best = found.filter("source = 'vector'").withColumn("rank", F.row_number().over(order)).join(used, "query_id", "left")
    budget = F.greatest(F.lit(s.answered_from) - F.coalesce("used", F.lit(0)), F.lit(0))
    return exact.unionByName(best.filter(F.col("rank") <= budget).select(*exact.columns))


def reranked_all(found: DataFrame, k: int = DEFAULT.answered_from) -> DataFrame:
    """The evaluation's form: exact and vector rows compete alike."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def context(rows: DataFrame) -> DataFrame:
    """query_id, context: one line per chunk, in the order of ``place``; a revision is named where there is a label."""
    revision = F.coalesce(F.concat(F.lit(", "), F.nullif("revision_label", F.lit(""))), F.lit(""))
    line = F.concat(F.lit("["), F.col("id"), F.lit("] (page "), F.col("page").cast("string"), revision, F.lit("): "), F.col("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def answers(replies: DataFrame, context_ids: DataFrame) -> DataFrame:
    """query_id, refused, reason, cited, invalid of replies (query_id, reply); ids outside the context are invalid.

    A question without context is refused, whatever the reply.
    """
    known = context_ids.groupBy("query_id").agg(F.collect_set("id").alias("known"))
    rows = replies.join(known, "query_id", "left").withColumn("r", X.refusal(F.coalesce("reply", F.lit(""))))
    none = F.array().cast("array<string>")
    refused = F.col("r.refused") | F.col("known").isNull()
    found = F.when(refused, none).otherwise(X.citations(F.coalesce("reply", F.lit(""))))
    rows = rows.withColumn("found", found).withColumn("held", F.coalesce("known", none))
    return rows.select("query_id", refused.alias("refused"), F.when(F.col("known").isNull(), "nothing retrieved").otherwise(F.col("r.reason")).alias("reason"), F.array_intersect("found", "held").alias("cited"), F.array_except("found", "held").alias("invalid"))


def cited_chunks(answered: DataFrame, chunks: DataFrame) -> DataFrame:
    return answered.select("query_id", F.posexplode("cited").alias("place", "id")).join(chunks, "id")
