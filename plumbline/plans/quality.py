"""Queries about telemetry and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators import retrieval as R
from plumbline.operators import telemetry as T
from plumbline.operators.groups import numbered
from plumbline.plans.changes import part_delta
from plumbline.plans.registry import query
from plumbline.session import table
from plumbline.sources.tables import newest_first


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a span log: an event's value is its duration, its k the tokens."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("string")
    calls = F.when(F.col("event_type") == "error", "llm.complete").otherwise("llm.read_image_text")
    purpose = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")))
    attributes = F.create_map(F.lit("model"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")), F.lit("purpose"), purpose, F.lit("input_tokens"), k, F.lit("output_tokens"), F.lit("2"), F.lit("added"), k, F.lit("removed"), F.lit("1"), F.lit("modified"), F.lit("0"), F.lit("alignment_rate"), F.lit("0.5"), F.lit("recall_at_k"), (F.col("event_id") % 2).cast("string"), F.lit("mrr"), F.lit("0.25"))
    return e.select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("event_type").alias("name"), calls.alias("call"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("start_time"), F.lit(0.0).alias("end_time"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), attributes.alias("attributes"))


@query("SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n, round(avg(value), 3) AS mean_ms, round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms, round(quantile_cont(value, 0.99), 3) AS p99_ms, round(max(value), 3) AS max_ms FROM events GROUP BY event_type")
def latency_by_stage(spark, sf_dir):
    return T.latency(event_spans(spark, sf_dir))


CALLS = """
WITH c AS (SELECT 'm' || CAST(user_id % 4 AS VARCHAR) AS model, CASE WHEN event_id % 5 = 0 THEN 'untagged' ELSE 'p' || CAST(event_id % 3 AS VARCHAR) END AS purpose, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, 2 AS o FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
g AS (SELECT CASE WHEN model IS NOT NULL THEN 'model' WHEN purpose IS NOT NULL THEN 'purpose' ELSE 'total' END AS kind, coalesce(model, purpose, 'all') AS name, CAST(count(*) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum((i * 3.0 + o * 15.0) / 1e6), 6) AS cost_usd
  FROM c GROUP BY GROUPING SETS ((model), (purpose), ()))
"""


def used(spark, sf_dir):
    return T.usage(event_spans(spark, sf_dir).withColumn("name", F.col("call")))


@query(CALLS + "SELECT * FROM g")
def usage_by_model_purpose(spark, sf_dir):
    return used(spark, sf_dir)


@query(CALLS + "SELECT name AS purpose, calls, round(cost_usd / greatest(calls, 1), 6) AS cost_per_call FROM g WHERE kind = 'purpose'")
def cost_per_call(spark, sf_dir):
    return T.cost_per_call(used(spark, sf_dir))


@query("SELECT CAST(count(*) AS BIGINT) AS runs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_added, CAST(count(*) AS BIGINT) AS total_removed, CAST(0 AS BIGINT) AS total_modified, CAST(0.5 AS DOUBLE) AS avg_alignment_rate, CAST(NULL AS DOUBLE) AS avg_exact_key_rate FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def delta_totals(spark, sf_dir):
    return T.delta_totals(event_spans(spark, sf_dir).withColumn("name", F.lit(T.DELTA_SPAN)))


@query("SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(event_id % 2), 4) AS recall_at_k, CAST(0.25 AS DOUBLE) AS mean_reciprocal_rank FROM events WHERE event_type = 'click'")
def retrieval_span_metrics(spark, sf_dir):
    return T.retrieval_metrics(event_spans(spark, sf_dir).withColumn("name", F.when(F.col("name") == "click", T.RETRIEVAL_SPAN).otherwise(F.col("name"))))


@query("SELECT CAST(count(*) AS BIGINT) AS total_spans, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM events")
def error_rate(spark, sf_dir):
    return T.error_rate(event_spans(spark, sf_dir))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1, 2")
def span_window_counts(spark, sf_dir):
    """The windowed aggregate of the stream, over the batch."""
    from plumbline.streaming.spans import windowed

    return windowed(event_spans(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "name", "n", "errors")


@query("""WITH p AS (SELECT quality, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (guess = 1 AND quality = 1) AS tp, count(*) FILTER (guess = 1 AND quality = 0) AS fp, count(*) FILTER (guess = 0 AND quality = 1) AS fn FROM p),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM c)
SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM r""")
def prf1_quality(spark, sf_dir):
    """A length rule as the prediction of the quality label."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    guess, real = F.col("n_chars") >= 200, F.col("quality") == 1
    counts = both.agg(F.count_if(guess & real).alias("tp"), F.count_if(guess & ~real).alias("fp"), F.count_if(~guess & real).alias("fn"))
    return counts.withColumn("r", E.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))).select("tp", "fp", "fn", "r.*")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 4) AS exact_correctness, round(avg(abs(quality - toxic)), 4) AS mean_abs_diff_correctness, CAST(1.0 AS DOUBLE) AS exact_groundedness, CAST(0.0 AS DOUBLE) AS mean_abs_diff_groundedness FROM labels")
def judge_agreement(spark, sf_dir):
    two = {"human_correctness": "quality", "judge_correctness": "toxic", "human_groundedness": "quality", "judge_groundedness": "quality"}
    return E.agreement(table(spark, sf_dir, "labels").select(*[F.col(c).alias(n) for n, c in two.items()]))


@query("SELECT CAST(round(avg(quality), 4) AS DOUBLE) AS avg_correctness, CAST(NULL AS DOUBLE) AS avg_groundedness, coalesce(round(avg(CASE WHEN toxic = 0 THEN CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END END), 4), 1.0) AS refusal_accuracy, coalesce(round(avg(CASE WHEN toxic = 1 THEN CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END END), 4), 0.0) AS over_refusal_rate FROM labels")
def chat_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("answerable"), (F.col("quality") == 0).alias("refused"), F.col("quality").alias("correctness"), F.lit(None).cast("int").alias("groundedness"))
    return E.chat_summary(rows)


RANKED = """
WITH s AS (SELECT source, item_id, position(b.text IN d.text) > 0 AS hit, d.doc_id FROM documents d, benchmark b WHERE position(b.text IN d.text) > 0),
each_ AS (SELECT b.item_id, min(1 + (doc_id * 31) % 7) AS first FROM benchmark b LEFT JOIN s USING (item_id) GROUP BY 1)
"""


@query(RANKED + "SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k, round(avg(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0.0 END), 4) AS mrr FROM each_")
def retrieval_recall_mrr(spark, sf_dir):
    """Benchmark passages held in documents; a document's rank is derived from its id."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = R.holding(d, b.select("item_id", F.col("text").alias("passage"))).select(F.col("item_id").alias("query_id"), (1 + F.col("doc_id") * 31 % 7).alias("rank"), F.col("passage").alias("text"))
    asked = b.select(F.col("item_id").alias("query_id"), F.lit(True).alias("answerable"), F.array("text").alias("expected"))
    return E.retrieval_quality(hits, asked)[1]


@query()
def fuzzy_match(spark, sf_dir):
    """Names against themselves with a letter changed. The ratio has no SQL twin; tests hold it to the library's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.translate("p_name", "aeiou", "eioua").alias("other"))
    ratio = E.similarity(spark)
    return p.select("p_partkey", ratio(F.col("p_name"), F.col("other")).alias("ratio"), E.texts_match(ratio, F.col("p_name"), F.col("other")).alias("matches"))


@query("""WITH o AS (SELECT l_returnflag || l_linestatus AS label, round(avg(l_discount), 4) AS v FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R' GROUP BY 1), n AS (SELECT l_returnflag || l_linestatus AS label, round(avg(l_tax), 4) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(o.label, n.label) AS label, o.v AS old, n.v AS new, round(n.v - o.v, 4) AS delta, coalesce(round(n.v - o.v, 4) < 0, false) AS regressed FROM o FULL OUTER JOIN n ON o.label = n.label""")
def scorecard_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus"))
    card = lambda rows, c: rows.groupBy("label").agg(F.round(F.avg(c), 4).alias("value")).withColumn("higher_is_better", F.lit(True))
    return E.scorecard_diff(card(li.filter("l_linestatus = 'O' or l_returnflag = 'R'"), "l_discount"), card(li.filter("l_returnflag <> 'R'"), "l_tax"))


@query()
def ground_truth_quality(spark, sf_dir):
    """The change feed of parts against itself with every tenth change left out: all expected are found."""
    feed, stats = part_delta(spark, sf_dir)
    ids = F.concat_ws("/", "change_type", "old_element_id", "new_element_id")
    deltas = feed.withColumn("delta_id", ids)
    expected = deltas.filter(F.pmod(F.xxhash64("delta_id"), F.lit(10)) != 0).withColumn("gt_id", F.col("delta_id")).withColumn("b", F.coalesce("new_bbox", "old_bbox"))
    expected = expected.select("pair_id", "gt_id", "change_type", "element_type", "old_text", "new_text", F.struct(F.array("b.x0", "b.y0", "b.x1", "b.y1").alias("bbox")).alias("locator"))
    pairs = deltas.select("pair_id").distinct().withColumn("negative_control", F.lit(False))
    return E.delta_quality(deltas, expected, pairs, stats).select("pair_id", "tp", "fp", "fn", "noise", "prf1.precision", "prf1.recall", "prf1.f1")


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS qa_id, quality, toxic FROM labels WHERE doc_id % 3 = 0)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 4) AS exact_correctness, round(avg(abs(quality - toxic)), 4) AS mean_abs_diff_correctness,
  round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 4) AS exact_groundedness, round(avg(abs(1 - toxic)), 4) AS mean_abs_diff_groundedness FROM l WHERE CAST(qa_id AS BIGINT) % 5 <> 0""")
def held_out_agreement(spark, sf_dir):
    """A person's and a judge's scores of held-out questions; replies that couldn't be read have none."""
    rows = table(spark, sf_dir, "labels").withColumn("qa_id", F.col("doc_id").cast("string"))
    unread = F.col("doc_id") % 5 == 0
    judged = rows.select("qa_id", F.when(~unread, F.col("toxic")).alias("correctness"), F.col("toxic").alias("groundedness"))
    people = rows.select("qa_id", F.col("quality").alias("correctness"), F.lit(1).alias("groundedness"))
    questions = rows.select("qa_id", F.when(F.col("doc_id") % 3 == 0, True).otherwise(F.when(F.col("doc_id") % 2 == 0, False)).alias("held_out"))
    return E.agreement(E.judged_rows(judged, people, questions))


@query("""WITH q AS (SELECT CAST(doc_id AS VARCHAR) AS qa_id, doc_id, quality, toxic, doc_id % 4 = 0 AS silent, doc_id % 3 = 0 AS declined FROM labels)
SELECT qa_id, toxic = 0 AS answerable, CASE WHEN silent THEN '' WHEN declined THEN 'NOT_GROUNDED: no' ELSE 'see [' || qa_id || '] and [x]' END AS answer, silent OR declined AS refused, (silent OR declined) = (toxic <> 0) AS correct_refusal,
  CASE WHEN silent OR declined THEN '' ELSE qa_id END AS citations, CASE WHEN silent OR declined THEN '' ELSE 'x' END AS invalid_citations, CASE WHEN doc_id % 5 <> 0 THEN quality END AS correctness, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS groundedness FROM q""")
def chat_items(spark, sf_dir):
    """Records of an evaluated chat: some questions have no reply, some replies decline, some judgements can't be read."""
    rows = table(spark, sf_dir, "labels").withColumn("qa_id", F.col("doc_id").cast("string"))
    questions = rows.select("qa_id", F.lit("?").alias("question"), (F.col("toxic") == 0).alias("answerable"))
    said = F.when(F.col("doc_id") % 3 == 0, "NOT_GROUNDED: no").otherwise(F.format_string("see [%s] and [x]", "qa_id"))
    replies = rows.filter("doc_id % 4 <> 0").select(F.col("qa_id").alias("query_id"), said.alias("reply"))
    answered = R.answers(replies, replies.select("query_id", F.col("query_id").alias("id"))).join(replies, "query_id").withColumnRenamed("query_id", "qa_id")
    judged = rows.select("qa_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality")).alias("correctness"), F.col("toxic").alias("groundedness"))
    items = E.chat_items(questions, answered, judged)
    return items.withColumns({c: F.array_join(c, ",") for c in ("citations", "invalid_citations")}).drop("question")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CAST(row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS place FROM orders")
def sessions_newest_first(spark, sf_dir):
    """Orders as sessions, with their place in the list."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderdate").alias("created_at"))
    return numbered(newest_first(rows)).select("session_id", "place")
