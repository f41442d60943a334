"""Queries about labels, lines and replies: the text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import classify as C
from plumbline.plans.registry import query
from plumbline.session import table
from plumbline.sources import tables

LABELS = """
labels_ AS (
  SELECT 'valve' AS source, p_partkey AS k, lpad(CAST(p_size AS VARCHAR), 2, '0') || 'BL' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS t FROM part
  UNION ALL SELECT 'line', p_partkey, CAST(p_size AS VARCHAR) || '"-VF-43-' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') || '-AC21S-00' FROM part
  UNION ALL SELECT 'setpoint', p_partkey, 'SP = ' || CAST(p_size AS VARCHAR) || ' bar (g)' FROM part
  UNION ALL SELECT 'size', p_partkey, CAST(p_size AS VARCHAR) || ' x ' || CAST(p_size + 1 AS VARCHAR) FROM part
  UNION ALL SELECT 'name', p_partkey, p_name FROM part
  UNION ALL SELECT 'tag', s_suppkey, '26-KA-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') FROM supplier
  UNION ALL SELECT 'limit', s_suppkey, 'HH: ' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'reference', s_suppkey, 'NOTE ' || CAST(s_suppkey AS VARCHAR) || ', 7' FROM supplier
  UNION ALL SELECT 'note', s_suppkey, CAST(s_suppkey % 1000 AS VARCHAR) || '. ' || s_name FROM supplier
  UNION ALL SELECT 'flag', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'LO' ELSE 'X' END FROM supplier
  UNION ALL SELECT 'instrument', o_orderkey, 'PIT-' || lpad(CAST(o_custkey % 1000000 AS VARCHAR), 5, '0') FROM orders)
"""
_INSTRUMENTS = ", ".join(f"'{x}'" for x in X.INSTRUMENTS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, o = (table(spark, sf_dir, n) for n in ("part", "supplier", "orders"))
    as_text = lambda c: F.col(c).cast("string")
    key, size, supplier = F.col("p_partkey"), as_text("p_size"), F.col("s_suppkey")
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    rows = [
        p.select(F.lit("valve").alias("source"), key.alias("k"), F.concat(F.lpad(size, 2, "0"), F.lit("BL"), padded(key % 100000, 5)).alias("t")),
        p.select(F.lit("line"), key, F.concat(size, F.lit('"-VF-43-'), padded(key % 1000000, 6), F.lit("-AC21S-00"))),
        p.select(F.lit("setpoint"), key, F.concat(F.lit("SP = "), size, F.lit(" bar (g)"))),
        p.select(F.lit("size"), key, F.concat(size, F.lit(" x "), (F.col("p_size") + 1).cast("string"))),
        p.select(F.lit("name"), key, "p_name"),
        s.select(F.lit("tag"), supplier, F.concat(F.lit("26-KA-"), padded(supplier % 10000, 4))),
        s.select(F.lit("limit"), supplier, F.concat(F.lit("HH: "), supplier.cast("string"))),
        s.select(F.lit("reference"), supplier, F.concat(F.lit("NOTE "), supplier.cast("string"), F.lit(", 7"))),
        s.select(F.lit("note"), supplier, F.concat((supplier % 1000).cast("string"), F.lit(". "), F.col("s_name"))),
        s.select(F.lit("flag"), supplier, F.when(supplier % 2 == 0, "LO").otherwise("X")),
        o.select(F.lit("instrument"), F.col("o_orderkey"), F.concat(F.lit("PIT-"), padded(F.col("o_custkey") % 1000000, 5))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "WITH "
    + LABELS
    + f""", c AS (SELECT source, k, t, CASE WHEN regexp_matches(t, {_sql(X.NOTE_LINE)}) THEN 'note' WHEN regexp_matches(t, {_sql(X.NOTE_REFERENCE)}) THEN 'note' WHEN regexp_matches(t, {_sql(X.LINE_NUMBER)}) THEN 'line_number'
  WHEN regexp_matches(t, {_sql(X.INSTRUMENT)}) AND regexp_extract(t, {_sql(X.INSTRUMENT)}, 1) IN ({_INSTRUMENTS}) THEN 'instrument_loop' WHEN regexp_matches(t, {_sql(X.VALVE)}) THEN 'valve' WHEN regexp_matches(t, {_sql(X.TAG)}) THEN 'tag'
  WHEN regexp_matches(t, {_sql(X.SETPOINT)}) THEN 'setpoint' WHEN regexp_matches(t, {_sql(X.LIMIT)}) THEN 'setpoint' WHEN regexp_matches(t, {_sql(X.SIZE_CHANGE)}) THEN 'dimension' ELSE 'text_block' END AS type FROM labels_)
SELECT source, k, t AS text, type,
  CASE WHEN type = 'note' AND regexp_matches(t, {_sql(X.NOTE_LINE)}) THEN 'definition' WHEN type = 'note' THEN 'reference' WHEN type = 'dimension' THEN 'size_transition' WHEN t IN ('LO') THEN 'valve_status_flag' WHEN regexp_matches(t, '^[A-Z]$') THEN 'flag' ELSE '' END AS kind,
  CASE WHEN type = 'setpoint' AND regexp_matches(t, {_sql(X.SETPOINT)}) THEN regexp_extract(t, {_sql(X.SETPOINT)}, 2) WHEN type = 'setpoint' THEN regexp_extract(t, {_sql(X.LIMIT)}, 2) WHEN type = 'instrument_loop' THEN regexp_extract(t, {_sql(X.INSTRUMENT)}, 2) WHEN type = 'note' AND regexp_matches(t, {_sql(X.NOTE_LINE)}) THEN regexp_extract(t, {_sql(X.NOTE_LINE)}, 1) ELSE '' END AS value FROM c"""
)
def element_classify(spark, sf_dir):
    made = labels(spark, sf_dir).withColumn("m", X.one_line(F.col("t")))
    at = lambda n: F.col("m.attributes")[n]
    return made.select("source", "k", F.col("m.text").alias("text"), F.col("m.type").alias("type"), F.coalesce(at("kind"), F.lit("")).alias("kind"), F.coalesce(at("value"), at("loop_number"), at("note_number"), F.lit("")).alias("value"))


_T = {n: _sql(X._tolerant(p)) for n, p in (("line", X.LINE_NUMBER), ("loop", X.INSTRUMENT), ("valve", X.VALVE), ("tag", X.TAG))}


@query(
    "WITH "
    + LABELS
    + f""", c AS (SELECT source, k, CASE source WHEN 'valve' THEN substr(t, 1, 2) || translate(substr(t, 3, 2), 'BLKAPITVF', '81XA91TVF') || substr(t, 5) WHEN 'instrument' THEN translate(substr(t, 1, 3), 'I', '1') || substr(t, 4)
  WHEN 'line' THEN replace(t, 'VF', '5B') WHEN 'tag' THEN replace(t, 'KA', 'K8') ELSE t END AS t FROM labels_)
SELECT source, k, t AS text, CASE WHEN regexp_matches(t, {_sql(X.NOTE_LINE)}) OR regexp_matches(t, {_sql(X.NOTE_REFERENCE)}) THEN 'note' WHEN regexp_matches(t, {_sql(X.LINE_NUMBER)}) THEN 'line_number'
  WHEN regexp_matches(t, {_sql(X.INSTRUMENT)}) AND regexp_extract(t, {_sql(X.INSTRUMENT)}, 1) IN ({_INSTRUMENTS}) THEN 'instrument_loop' WHEN regexp_matches(t, {_sql(X.VALVE)}) THEN 'valve' WHEN regexp_matches(t, {_sql(X.TAG)}) THEN 'tag'
  WHEN regexp_matches(t, {_sql(X.SETPOINT)}) OR regexp_matches(t, {_sql(X.LIMIT)}) THEN 'setpoint' WHEN regexp_matches(t, {_sql(X.SIZE_CHANGE)}) THEN 'dimension' WHEN t = 'LO' OR regexp_matches(t, '^[A-Z]$') THEN 'text_block'
  WHEN regexp_matches(t, {_T['line']}) THEN 'line_number' WHEN regexp_matches(t, {_T['loop']}) AND translate(regexp_extract(t, {_T['loop']}, 1), '{X.MISREAD}', '{X.MEANT}') IN ({_INSTRUMENTS}) THEN 'instrument_loop'
  WHEN regexp_matches(t, {_T['valve']}) THEN 'valve' WHEN regexp_matches(t, {_T['tag']}) THEN 'tag' ELSE 'text_block' END AS type FROM c"""
)
def ocr_retry(spark, sf_dir):
    """Labels with letters misread as digits get their type back; the text stays as it was read."""
    t, source = F.col("t"), F.col("source")
    spoilt = (
        F.when(source == "valve", F.concat(F.substring(t, 1, 2), F.translate(F.substring(t, 3, 2), "BLKAPITVF", "81XA91TVF"), F.substring(t, 5, 1000)))
        .when(source == "instrument", F.concat(F.translate(F.substring(t, 1, 3), "I", "1"), F.substring(t, 4, 1000)))
        .when(source == "line", F.replace(t, F.lit("VF"), F.lit("5B")))
        .when(source == "tag", F.replace(t, F.lit("KA"), F.lit("K8")))
        .otherwise(t)
    )
    rows = labels(spark, sf_dir).withColumn("t", spoilt).withColumn("m", X.one_line(F.col("t"), ocr_tolerant=True))
    return rows.select("source", "k", F.col("m.text").alias("text"), F.col("m.type").alias("type"))


LINES_OF = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


@query("WITH " + LINES_OF + " SELECT CAST(doc_id AS VARCHAR) AS pid, CAST(line AS BIGINT) AS line, text FROM l")
def doc_lines_scan(spark, sf_dir):
    return tables.text_lines(table(spark, sf_dir, "documents")).select("pid", "line", "text")


@query("WITH " + LINES_OF + ", m AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN CAST(line // 3 % 900 + 1 AS VARCHAR) || '. ' || text ELSE text END AS text FROM l), s AS (SELECT *, sum(CASE WHEN regexp_matches(trim(text), '^\\d{1,3}\\.$') OR regexp_matches(trim(text), '^\\d{1,3}\\.\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS note FROM m) SELECT CAST(doc_id AS VARCHAR) AS pid, CAST(note AS BIGINT) AS note, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, note")
def note_sessionise(spark, sf_dir):
    lines = tables.text_lines(table(spark, sf_dir, "documents"))
    marked = lines.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat((F.floor(F.col("line") / 3) % 900 + 1).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text")))
    return C.note_sessions(marked).groupBy("pid", "note").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("WITH b AS (SELECT o_orderkey AS k, 0 AS line, 'PIT' AS t FROM orders UNION ALL SELECT o_orderkey, 1, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') FROM orders UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 2 = 0 THEN '26' ELSE 'GAS SKID' END FROM orders), a AS (SELECT k, line, t, lead(t, 1) OVER (PARTITION BY k ORDER BY line) AS n, lead(t, 2) OVER (PARTITION BY k ORDER BY line) AS u FROM b) SELECT CAST(k AS VARCHAR) AS pid, t || '-' || n AS text, CASE WHEN regexp_matches(u, '^\\d{1,3}$') THEN u END AS unit FROM a WHERE t = 'PIT'")
def bubble_lookahead(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = F.array(F.lit("PIT"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.when(F.col("o_orderkey") % 2 == 0, "26").otherwise("GAS SKID"))
    lines = o.select(F.col("o_orderkey").cast("string").alias("pid"), F.lit(0).alias("page"), F.lit(0).cast("long").alias("block"), F.posexplode(parts).alias("line", "text"))
    return C.bubbles(lines).select("pid", "text", "unit")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pid, 'instrument_loop' AS type, 'PIT-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS text, 0 AS line FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'note' ELSE 'text_block' END, CASE WHEN o_orderkey % 2 = 0 THEN '7. ' || o_orderpriority ELSE o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 2 END FROM orders")
def classify_blocks(spark, sf_dir):
    """Blocks of several lines: a bubble, then a note with its body or a plain line."""
    o = table(spark, sf_dir, "orders")
    number = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    parts = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("PIT"), number, F.lit("7."), F.col("o_orderpriority"))).otherwise(F.array(F.lit("PIT"), number, F.col("o_orderpriority")))
    zero = F.lit(0.0)
    lines = o.select(F.col("o_orderkey").cast("string").alias("pid"), F.floor(F.col("o_orderkey") / 1000).cast("int").alias("page"), F.lit(0).cast("long").alias("block"), F.posexplode(parts).alias("line", "text")).withColumns({c: zero for c in ("x0", "y0", "x1", "y1")})
    # one page's blocks are one call: orders of a thousand keys share a page here
    folded = lines.withColumn("block", F.col("pid").cast("long")).withColumn("pid", F.lit("d"))
    return C.classify(folded.withColumn("line", F.col("line").cast("long"))).select(F.col("block").cast("string").alias("pid"), "type", "text", F.col("line").cast("int").alias("line"))


@query(f"WITH b AS (SELECT page_id, regexp_extract_all(html, {_sql(tables.HTML_BLOCK)}, 1) AS x FROM pages), c AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS block, unnest(x) AS raw FROM b), d AS (SELECT page_id, CAST(block AS BIGINT) AS block, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM c) SELECT * FROM d WHERE text <> ''")
def html_blocks_scan(spark, sf_dir):
    return tables.html_blocks(table(spark, sf_dir, "pages"))


@query("SELECT p_partkey AS k, p_name AS text FROM part")
def ocr_edge_clean(spark, sf_dir):
    """Stray marks around a line go; the line itself comes back."""
    junk = F.concat(F.lit("\\ ( "), F.col("p_name"), F.lit(" | / "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.edge_cleaned(junk).alias("text"))


QUESTION = "'What changed at ' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'BL' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || ' and in note ' || CAST(p_size AS VARCHAR) || ' or Note number #' || CAST(p_partkey % 100 AS VARCHAR) || '?'"


def questions(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat(F.lit("What changed at "), F.lpad(size, 2, "0"), F.lit("BL"), F.lpad(key.cast("string"), 5, "0"), F.lit(" and in note "), size, F.lit(" or Note number #"), (key % 100).cast("string"), F.lit("?"))
    return p.select(key.alias("query_id"), F.lit("c").alias("collection"), text.alias("question"))


@query(f"SELECT p_partkey AS query_id, unnest(list_filter(list_distinct(regexp_extract_all({QUESTION}, '([A-Za-z0-9][A-Za-z0-9\\-/]{{1,}})', 1)), lambda x: length(x) >= 3 AND regexp_matches(x, '\\d'))) AS token FROM part")
def tag_tokens(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.explode(X.tag_tokens(F.col("question"))).alias("token"))


@query(f"SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all({QUESTION}, '(?i)\\bnote\\s*(?:number\\s*)?#?\\s*(\\d{{1,3}})\\b', 1)) AS number FROM part")
def note_numbers(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.explode(X.note_numbers(F.col("question"))).alias("number"))


ANSWER = "CASE WHEN turn % 4 = 3 THEN 'NOT_GROUNDED: ' || role ELSE text || ' [' || CAST(conv_id AS VARCHAR) || '] and [x' || CAST(turn AS VARCHAR) || '], again [' || CAST(conv_id AS VARCHAR) || ']' END"


def replies(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("NOT_GROUNDED: "), F.col("role"))).otherwise(F.concat(F.col("text"), F.lit(" ["), conv, F.lit("] and [x"), turn, F.lit("], again ["), conv, F.lit("]")))
    return c.select(F.concat_ws("-", conv, turn).alias("query_id"), "conv_id", "turn", text.alias("reply"))


@query(f"WITH r AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id, {ANSWER} AS reply FROM conversations) SELECT query_id, starts_with(reply, 'NOT_GROUNDED:') AS refused, CASE WHEN starts_with(reply, 'NOT_GROUNDED:') THEN trim(substr(reply, 14)) END AS reason FROM r")
def refusal_parse(spark, sf_dir):
    return replies(spark, sf_dir).withColumn("r", X.refusal(F.col("reply"))).select("query_id", "r.refused", "r.reason")


@query("SELECT conv_id, turn, trim(text) AS reply FROM conversations")
def think_strip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("<think>first\nthoughts</think> more </think> "), F.col("text"))
    return c.select("conv_id", "turn", X.without_thinking(said).alias("reply"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS DOUBLE) * 60 + 1.5 WHEN 1 THEN user_id / 1000 WHEN 2 THEN CAST(user_id AS DOUBLE) END AS seconds FROM events")
def retry_wait(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    said = F.concat(F.lit("Rate limit reached. Please Try again in "), F.when(n == 0, F.concat(user, F.lit("m1.5s"))).when(n == 1, F.concat(user, F.lit("ms"))).when(n == 2, F.concat(user, F.lit("s"))).otherwise("a while"), F.lit(". Thanks"))
    return e.select("event_id", X.retry_seconds(said).alias("seconds"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' ELSE event_type END AS reply FROM events")
def empty_reply(spark, sf_dir):
    n = F.col("event_id") % 4
    said = F.when(n == 0, "**EMPTY**").when(n == 1, "No text visible.").when(n == 2, "n/a").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.empty_reply(said).alias("reply"))


@query("SELECT event_id, CAST(greatest(1, user_id % 7) AS INTEGER) FILTER_C, CAST(1 AS INTEGER) FILTER_G FROM events".replace("FILTER_C", "AS c").replace("FILTER_G", "AS g").replace("greatest(1, user_id % 7)", "least(5, greatest(1, user_id % 7))"))
def judge_parse(spark, sf_dir):
    said = F.concat(F.lit("<think>hm</think>**Correctness**: "), (F.col("user_id") % 7).cast("string"), F.lit("\n**Groundedness**: 0\nReason: so it is\nmore"))
    return table(spark, sf_dir, "events").withColumn("v", X.verdict(said)).select("event_id", F.col("v.correctness").alias("c"), F.col("v.groundedness").alias("g"))


@query("SELECT page_id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80) AS n FROM pages)")
def path_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.path_safe(F.col("url")).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '.dxf' ELSE '.pdf' END AS plain, CASE WHEN page_id % 2 = 0 THEN '.dwg' ELSE '.pdf' END AS named, replace(url, '&', '&amp;') AS escaped, url || '\\|x' AS cell FROM pages")
def upload_names(spark, sf_dir):
    kind = F.when(F.col("page_id") % 2 == 0, "dwg").otherwise("pdf")
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.upload_suffix(url, kind).alias("plain"), X.upload_suffix(F.concat(url, F.lit(".DWG")), kind).alias("named"), X.xml_escaped(url).alias("escaped"), X.markdown_cell(F.concat(url, F.lit("|x"))).alias("cell"))
