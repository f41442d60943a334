"""Queries about recognised words, boxes, numbering and the smaller joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import models
from plumbline.functions import text as X
from plumbline.operators import classify as C
from plumbline.operators import ocr
from plumbline.operators import report as R
from plumbline.operators import telemetry as T
from plumbline.plans.changes import ELEMENTS, LINES, numbered_lines, part_delta
from plumbline.plans.quality import event_spans
from plumbline.plans.registry import query
from plumbline.session import table

WORDS = (
    "WITH "
    + LINES
    + """, words AS (SELECT CAST(o AS VARCHAR) AS pid, r AS seq, layer || entity AS text, q * 2 - 3 AS conf, n % 2 AS block_num, n % 3 AS line_num, CAST(q AS BIGINT) * 7 % 500 AS l, CAST(p AS BIGINT) % 700 AS t, 10 + n AS w, 8 + n AS h FROM rows_)
"""
)


def words(spark, sf_dir):
    """Line items as recognised words: one page per order."""
    q, n = F.col("q").cast("int"), F.col("n")
    return numbered_lines(spark, sf_dir).select(
        F.col("o").cast("string").alias("pid"), F.lit(0).alias("page"), F.col("r").alias("seq"), F.concat("layer", "entity").alias("text"), (F.col("q") * 2 - 3).alias("conf"), (n % 2).alias("block_num"), F.lit(0).alias("par_num"), (n % 3).alias("line_num"),
        (q * 7 % 500).alias("left"), (F.rint(F.col("p")).cast("long") % 700).cast("int").alias("top"), (n + 10).alias("width"), (n + 8).alias("height"),
    )


@query(WORDS + "SELECT pid, CAST(block_num AS BIGINT) AS block_num, CAST(line_num AS BIGINT) AS line_num, string_agg(text, ' ' ORDER BY seq) AS text, CAST(min(l) AS DOUBLE) AS x0, CAST(min(t) AS DOUBLE) AS y0, CAST(max(l + w) AS DOUBLE) AS x1, CAST(max(t + h) AS DOUBLE) AS y1, round(avg(conf), 6) AS confidence FROM words WHERE conf >= 0 GROUP BY pid, block_num, line_num")
def ocr_lines(spark, sf_dir):
    return ocr.lines(words(spark, sf_dir)).select("pid", F.col("block_num").cast("long").alias("block_num"), F.col("line_num").cast("long").alias("line_num"), "text", "x0", "y0", "x1", "y1", F.round("confidence", 6).alias("confidence"))


@query()
def ocr_clusters(spark, sf_dir):
    """Stacks of lines per page. The scan stops early by rule, which no join says; tests hold it to plain code."""
    return ocr.clusters(ocr.lines(words(spark, sf_dir))).groupBy("pid", "block").agg(F.count("*").alias("n_lines"))


@query(
    WORDS
    + """, a AS (SELECT pid, seq, l, t, l + w AS x1, t + h AS y1 FROM words), b AS (SELECT pid, l + 3 AS l, t + 3 AS t, l + w + 3 AS x1, t + h + 3 AS y1, conf FROM words)
SELECT a.pid, a.seq AS line, round(greatest(0, least(1, coalesce(min(b.conf) FILTER (a.l < b.x1 AND b.l < a.x1 AND a.t < b.y1 AND b.t < a.y1), 0) / 100)), 6) AS confidence FROM a JOIN b USING (pid) GROUP BY a.pid, a.seq"""
)
def overlap_confidence(spark, sf_dir):
    """Drafts take the least confidence of the lines that they overlap."""
    w = words(spark, sf_dir)
    box = lambda d: {"x0": F.col("left") + d, "y0": F.col("top") + d, "x1": F.col("left") + F.col("width") + d, "y1": F.col("top") + F.col("height") + d}
    drafts = w.select("pid", "page", F.lit(0).alias("block"), F.col("seq").alias("line"), *[c.cast("double").alias(n) for n, c in box(0).items()])
    lines = w.select("pid", "page", F.lit(0).alias("block"), *[c.cast("double").alias(n) for n, c in box(3).items()], F.col("conf").alias("confidence"))
    return ocr.line_confidence(drafts, lines).select("pid", "line", F.round("confidence", 6).alias("confidence"))


DOUBTFUL = """
WITH e AS (SELECT p_partkey AS k, CAST(p_partkey // 500 AS BIGINT) AS page, CASE WHEN p_partkey % 11 = 0 THEN p_name || '¤' ELSE p_name END AS text, (p_partkey * 37 % 101) / 100 AS c FROM part),
d AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END, c, k) AS rank FROM e WHERE c < 0.6 OR k % 11 = 0)
"""


def doubtful(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("d").alias("pid"), key.cast("string").alias("id"), key.alias("seq"), F.struct(F.floor(key / 500).alias("page")).alias("bbox"), F.when(key % 11 == 0, F.concat("p_name", F.lit("¤"))).otherwise(F.col("p_name")).alias("text"), F.create_map().cast("map<string,string>").alias("attributes"), (key * 37 % 101 / 100).alias("extraction_confidence"))


@query(DOUBTFUL + "SELECT CAST(k AS VARCHAR) AS id, page, CAST(rank AS BIGINT) AS rank, rank <= 40 AS selected FROM d")
def reread_candidates(spark, sf_dir):
    found = ocr.reread_candidates(doubtful(spark, sf_dir))
    return found.select("id", F.col("bbox.page").cast("long").alias("page"), F.col("rank").cast("long").alias("rank"), "selected")


@query(
    DOUBTFUL
    + """SELECT CAST(k AS VARCHAR) AS id, CASE k % 5 WHEN 0 THEN 'new text' ELSE text END AS text, CASE WHEN k % 5 <= 1 THEN 0.9 ELSE c END AS confidence,
 CASE k % 5 WHEN 0 THEN 'vision_llm' WHEN 1 THEN 'vision_llm_confirmed' WHEN 2 THEN 'vision_llm_unreadable' WHEN 3 THEN 'error' END AS outcome, CASE k % 5 WHEN 0 THEN text END AS before FROM e"""
)
def apply_rereading(spark, sf_dir):
    e = doubtful(spark, sf_dir)
    n = F.col("seq") % 5
    replies = e.filter(n < 4).select("id", F.when(n == 0, "new text").when(n == 1, F.col("text")).otherwise("").alias("reply"), F.when(n == 3, "error").otherwise("ok").alias("outcome"))
    done = ocr.apply_rereading(e, replies)
    return done.select("id", "text", F.col("extraction_confidence").alias("confidence"), F.col("attributes")["ocr_fallback"].alias("outcome"), F.col("attributes")["ocr_text"].alias("before"))


@query("SELECT o_orderkey AS k, round((10.0 + 30) / 2 / CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE o_custkey END, 9) AS x, round((o_orderkey % 100 + o_orderkey % 100 + 8) / 2 / 200, 9) AS y, round(least(1, greatest(0, o_totalprice / 300000)), 9) AS clamped, round(o_totalprice * 72 / 300, 6) AS points FROM orders")
def box_geometry(spark, sf_dir):
    """Normalised centres, clamping and points; a page side of zero counts as one."""
    o = table(spark, sf_dir, "orders")
    wide = F.when(F.col("o_custkey") % 5 == 0, 0.0).otherwise(F.col("o_custkey").cast("double"))
    top = (F.col("o_orderkey") % 100).cast("double")
    box = F.struct(F.lit(10.0).alias("x0"), top.alias("y0"), F.lit(30.0).alias("x1"), (top + 8).alias("y1"), wide.alias("page_width"), F.lit(200.0).alias("page_height"))
    x, y = G.centre(F.col("box"))
    rows = o.withColumn("box", box)
    return rows.select(F.col("o_orderkey").alias("k"), F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(G.clamp(F.col("o_totalprice") / 300000, 0.0, 1.0), 9).alias("clamped"), F.round(G.points(F.col("o_totalprice"), 300), 6).alias("points"))


@query("SELECT o_orderkey AS k, ((o_orderkey % 256) / 255.0)::DOUBLE AS r, 1.0::DOUBLE AS g, 0.0::DOUBLE AS b FROM orders")
def hex_colours(spark, sf_dir):
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("o_orderkey") % 256)), 2, "0"), F.lit("ff00"))
    share = X.rgb(colour)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), share[0].alias("r"), share[1].alias("g"), share[2].alias("b"))


@query("SELECT CAST(doc_id AS VARCHAR) || ':pdf_native:' || lpad(CAST(line AS VARCHAR), 5, '0') AS id, CAST(line AS BIGINT) AS seq FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)")
def element_numbering(spark, sf_dir):
    """Elements get ids in reading order; here each line of a document is one."""
    from plumbline.sources.tables import text_lines

    docs = table(spark, sf_dir, "documents")
    drafts = text_lines(docs).select("pid", "page", "block", "line", F.lit("text_block").alias("type"), "text", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")], F.create_map().cast("map<string,string>").alias("attributes"))
    pages = docs.select(F.col("doc_id").cast("string").alias("pid"), F.lit(0).alias("page"), F.lit(1.0).alias("page_width"), F.lit(1.0).alias("page_height"))
    return C.elements(drafts, pages, "pdf_native", "pdf_points").select("id", "seq")


@query(ELEMENTS + "SELECT CAST(count(*) FILTER (length(trim(coalesce(new_text, old_text))) >= 20) AS BIGINT) AS charted, CAST(count(*) FILTER (coalesce(new_text, old_text) <> '' AND length(trim(coalesce(new_text, old_text))) < 20) AS BIGINT) AS noise, CAST(count(*) AS BIGINT) AS bearing FROM feed")
def feed_filters(spark, sf_dir):
    feed = part_delta(spark, sf_dir)[0]
    kinds = {"charted": R.worth_charting(feed, 20), "noise": R.noise(feed, 20), "bearing": R.text_bearing(feed)}
    told = [rows.select(F.lit(name).alias("kind")) for name, rows in kinds.items()]
    return told[0].unionByName(told[1]).unionByName(told[2]).agg(*[F.count_if(F.col("kind") == name).alias(name) for name in kinds])


@query("SELECT l_orderkey AS k, CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(min(l_discount) AS DOUBLE) AS y0, CAST(max(l_quantity + l_tax) AS DOUBLE) AS x1, CAST(max(l_discount + l_tax) AS DOUBLE) AS y1 FROM lineitem GROUP BY l_orderkey")
def united_boxes(spark, sf_dir):
    """The box around the boxes of one order's lines."""
    x, y, wide = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + wide).alias("x1"), (y + wide).alias("y1"))
    boxes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(box).alias("boxes"))
    return boxes.select("k", G.union(F.col("boxes")).alias("u")).select("k", "u.*")


@query("SELECT CAST(e.event_id AS VARCHAR) AS span_id, p.event_type AS parent_name FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_id = e.event_id - 50")
def span_parents(spark, sf_dir):
    spans = event_spans(spark, sf_dir).withColumn("parent_span_id", (F.col("span_id").cast("long") - 50).cast("string"))
    return T.span_tree(spans).select("span_id", "parent_name")


@query("SELECT 'stage ' || event_type AS label, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def labelled_latency(spark, sf_dir):
    """Stages with a label; absent ones and those without are left out."""
    names = event_spans(spark, sf_dir).filter("name <> 'error'").select("name").distinct()
    labels = names.select("name", F.concat(F.lit("stage "), F.col("name")).alias("label"))
    absent = spark.createDataFrame([("nothing", "stage nothing")], "name string, label string")
    return T.labelled_latency(event_spans(spark, sf_dir), labels.unionByName(absent)).select("label", "n")


@query()
def default_embeddings(spark, sf_dir):
    """Unit vectors of the default embedder, held against plain code in the tests."""
    embed = models.embedding()
    return table(spark, sf_dir, "part").select("p_partkey", embed(F.col("p_name")).alias("embedding"))
