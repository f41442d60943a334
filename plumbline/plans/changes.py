"""Queries about revisions: change feeds, candidates, assignments, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import align as A
from plumbline.operators import assign, delta, retrieval
from plumbline.operators import report as R
from plumbline.operators.groups import numbered
from plumbline.plans.registry import query
from plumbline.session import dealt, table
from plumbline.sources import tables

# Two revisions of orders: keys that go, keys that come, texts that change.

REVISIONS = """
WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS t FROM orders),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN o_orderpriority || '*' ELSE o_orderpriority END AS t FROM orders WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT o_orderkey + 10000000, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0),
feed AS (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change_type, coalesce(a.k, b.k) AS o_orderkey, a.t AS old_text, b.t AS new_text
         FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.t <> b.t)
"""


def order_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("t"))
    kept = a.filter("k % 97 <> 0").withColumn("t", F.when(F.col("k") % 101 == 0, F.concat("t", F.lit("*"))).otherwise(F.col("t")))
    return a, kept.unionByName(a.filter("k % 89 = 0").withColumn("k", F.col("k") + 10_000_000))


def keyed_feed(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Change feed of two tables with unique keys: one full join, no assignment."""
    both = a.select(F.col(key).alias("ka"), F.col(text).alias("old_text")).join(b.select(F.col(key).alias("kb"), F.col(text).alias("new_text")), F.col("ka") == F.col("kb"), "full_outer")
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(~F.col("old_text").eqNullSafe(F.col("new_text")), "modified")
    return both.select(change.alias("change_type"), F.coalesce("ka", "kb").alias(key), "old_text", "new_text").filter("change_type is not null")


@query(REVISIONS + "SELECT * FROM feed")
def delta_exact_key(spark, sf_dir):
    return keyed_feed(*order_revisions(spark, sf_dir), "k", "t").withColumnRenamed("k", "o_orderkey")


@query(REVISIONS + "SELECT change_type, CAST(count(*) AS BIGINT) AS n FROM feed GROUP BY change_type")
def delta_counts_by_type(spark, sf_dir):
    return keyed_feed(*order_revisions(spark, sf_dir), "k", "t").groupBy("change_type").agg(F.count("*").alias("n"))


# Parts as elements: valves are known by their text, setpoints and free texts by their place.

ELEMENTS = """
WITH base AS (SELECT p_partkey AS k, p_partkey % 3 AS m, CAST((p_partkey // 25) % 40 AS BIGINT) AS page, p_size, p_name FROM part),
a AS (SELECT k, page, CASE m WHEN 0 THEN 'valve' WHEN 1 THEN 'setpoint' ELSE 'text_block' END AS type,
        CASE m WHEN 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || 'BL' || lpad(CAST(k AS VARCHAR), 5, '0') WHEN 1 THEN 'SP = ' || CAST(p_size AS VARCHAR) || ' bar (g)' ELSE p_name END AS text FROM base),
b AS (SELECT k, page, type, CASE WHEN k % 7 = 0 THEN text || ' B' ELSE text END AS text FROM a WHERE k % 97 <> 0
      UNION ALL SELECT k + 10000000, page + 1000, type, text || ' N' FROM a WHERE k % 89 = 0),
feed AS (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change_type, coalesce(b.type, a.type) AS element_type,
        'a:' || CAST(a.k AS VARCHAR) AS old_element_id, 'b:' || CAST(b.k AS VARCHAR) AS new_element_id, a.text AS old_text, b.text AS new_text,
        CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'embedding_proximity' END AS match_tier, coalesce(b.page, a.page) AS page, CAST(1.0 AS DOUBLE) AS confidence
        FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.text <> b.text)
"""


def part_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two revisions of one drawing per 1,000 parts; no two elements of a page are near each other."""
    p = table(spark, sf_dir, "part")
    k, m = F.col("p_partkey"), F.col("p_partkey") % 3
    kind = F.when(m == 0, "valve").when(m == 1, "setpoint").otherwise("text_block")
    size = F.col("p_size").cast("string")
    text = F.when(m == 0, F.concat(F.lpad(size, 2, "0"), F.lit("BL"), F.lpad(k.cast("string"), 5, "0"))).when(m == 1, F.concat(F.lit("SP = "), size, F.lit(" bar (g)"))).otherwise(F.col("p_name"))
    page = F.floor(k / 25) % 40
    x, y = (k % 5) * 0.2, (F.floor(k / 5) % 5) * 0.2

    def rows(source, side, key, on_page, words):
        box = F.struct(on_page.cast("int").alias("page"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), F.lit(1.0).alias("page_width"), F.lit(1.0).alias("page_height"), F.lit("pdf_points").alias("unit"))
        return source.select(
            F.floor(k / 1000).cast("string").alias("pair_id"), F.concat(F.lit(f"{side}:"), key.cast("string")).alias("id"), kind.alias("type"), words.alias("text"), box.alias("bbox"),
            F.create_map().cast("map<string,string>").alias("attributes"), F.lit(1.0).alias("extraction_confidence"),
        )

    a = rows(p, "a", k, page, text)
    kept = rows(p.filter(k % 97 != 0), "b", k, page, F.when(k % 7 == 0, F.concat(text, F.lit(" B"))).otherwise(text))
    new = rows(p.filter(k % 89 == 0), "b", k + 10_000_000, page + 1000, F.concat(text, F.lit(" N")))
    return a, kept.unionByName(new)


def part_delta(spark, sf_dir):
    return delta.compute_delta(*part_elements(spark, sf_dir))


def part_pairs(feed: DataFrame) -> DataFrame:
    """pair_id, pid_a, pid_b of the drawings."""
    name = lambda side: F.concat(F.lit("parts"), "pair_id", F.lit(f"_{side}"))
    return feed.select("pair_id").distinct().select("pair_id", name("A").alias("pid_a"), name("B").alias("pid_b"))


NAMED = """, ids AS (SELECT *, 'parts' || CAST(CAST(substr(coalesce(old_element_id, new_element_id), 3) AS BIGINT) % 10000000 // 1000 AS VARCHAR) AS pair FROM feed),
pids AS (SELECT *, pair || '_A' AS pid_a, pair || '_B' AS pid_b FROM ids),
named AS (SELECT *, CASE change_type WHEN 'modified' THEN 'CHANGED (' || element_type || ') from ' || pid_a || ' to ' || pid_b || ': ''' || old_text || ''' -> ''' || new_text || ''''
  WHEN 'added' THEN 'ADDED in ' || pid_b || ', not present in ' || pid_a || ' (' || element_type || '): ''' || new_text || ''''
  ELSE 'REMOVED from ' || pid_a || ', not present in ' || pid_b || ' (' || element_type || '): ''' || old_text || '''' END AS sentence FROM pids)
"""


@query(ELEMENTS + "SELECT change_type, element_type, old_element_id, new_element_id, old_text, new_text, match_tier, confidence FROM feed")
def delta_engine(spark, sf_dir):
    return part_delta(spark, sf_dir)[0].select("change_type", "element_type", "old_element_id", "new_element_id", "old_text", "new_text", "match_tier", "confidence")


@query(
    ELEMENTS
    + """, sides AS (SELECT CAST(k // 1000 AS VARCHAR) AS pair_id, count(*) AS total_a, count(*) FILTER (type = 'valve') AS keyed_a FROM a GROUP BY 1),
other AS (SELECT CAST((k % 10000000) // 1000 AS VARCHAR) AS pair_id, count(*) AS total_b, count(*) FILTER (type = 'valve') AS keyed_b FROM b GROUP BY 1),
m AS (SELECT CAST(a.k // 1000 AS VARCHAR) AS pair_id, count(*) AS matched, count(*) FILTER (a.type = 'valve' AND a.text = b.text) AS m1, count(*) FILTER (a.text <> b.text) AS modified FROM a JOIN b ON a.k = b.k GROUP BY 1),
c AS (SELECT CAST(CAST(substr(coalesce(old_element_id, new_element_id), 3) AS BIGINT) % 10000000 // 1000 AS VARCHAR) AS pair_id, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed FROM feed GROUP BY 1)
SELECT pair_id, total_a, total_b, keyed_a, keyed_b, matched, matched - modified AS unchanged, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, modified,
  round(matched / greatest(least(total_a, total_b), 1), 4) AS alignment_rate, round(m1 / greatest(least(keyed_a, keyed_b), 1), 4) AS exact_key_rate,
  CAST(CASE WHEN least(keyed_a, keyed_b) >= 20 AND m1 / greatest(least(keyed_a, keyed_b), 1) < 0.5 THEN 1 ELSE 0 END + CASE WHEN total_a + total_b >= 20 AND (keyed_a + keyed_b) / (total_a + total_b) < 0.05 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
FROM sides JOIN other USING (pair_id) LEFT JOIN m USING (pair_id) LEFT JOIN c USING (pair_id)"""
)
def delta_stats_and_warnings(spark, sf_dir):
    stats = part_delta(spark, sf_dir)[1]
    return stats.withColumn("n_warnings", F.size("warnings").cast("long")).drop("matched_by_tier", "warnings")


@query(ELEMENTS + "SELECT page, CAST(count(*) FILTER (change_type = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change_type = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (change_type = 'modified') AS BIGINT) AS modified FROM feed GROUP BY page")
def delta_counts_by_page(spark, sf_dir):
    return R.by_page(part_delta(spark, sf_dir)[0].withColumn("pair_id", F.lit("all"))).select(F.col("page").cast("long").alias("page"), "added", "removed", "modified")


@query(ELEMENTS + "SELECT element_type, CAST(count(*) FILTER (change_type = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change_type = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (change_type = 'modified') AS BIGINT) AS modified, CAST(count(*) AS BIGINT) AS total FROM feed GROUP BY element_type")
def delta_counts_by_element_type(spark, sf_dir):
    return R.by_element_type(part_delta(spark, sf_dir)[0].withColumn("pair_id", F.lit("all"))).drop("pair_id")


@query(
    ELEMENTS
    + NAMED
    + """SELECT sentence, 'delta:' || change_type || ':' || coalesce(old_element_id, '_') || ':' || coalesce(new_element_id, '_') AS id,
 CASE change_type WHEN 'modified' THEN 'modified ' || element_type || ': ' || old_text || ' -> ' || new_text WHEN 'added' THEN 'added ' || element_type || ': ' || new_text ELSE 'removed ' || element_type || ': ' || old_text END AS label
FROM named"""
)
def delta_sentences(spark, sf_dir):
    feed = part_delta(spark, sf_dir)[0]
    return R.text_bearing(feed).join(dealt(part_pairs(feed)), "pair_id").select(R.sentence().alias("sentence"), R.chunk_id().alias("id"), R.label().alias("label"))


@query(ELEMENTS + NAMED + "SELECT change_type, old_element_id, new_element_id, CAST(row_number() OVER (ORDER BY pair, change_type, coalesce(old_element_id, ''), coalesce(new_element_id, '')) AS BIGINT) AS place FROM named")
def delta_in_order(spark, sf_dir):
    """Every change with its place in the report's order."""
    return numbered(delta.in_order(part_delta(spark, sf_dir)[0])).select("change_type", "old_element_id", "new_element_id", "place")


_LABEL = "CASE change_type WHEN 'modified' THEN 'modified ' || element_type || ': ' || old_text || ' -> ' || new_text WHEN 'added' THEN 'added ' || element_type || ': ' || new_text ELSE 'removed ' || element_type || ': ' || old_text END AS label"


@query(ELEMENTS + f"SELECT 'a' AS side, change_type, page, {_LABEL} FROM feed WHERE change_type IN ('removed', 'modified') UNION ALL SELECT 'b', change_type, page, {_LABEL} FROM feed WHERE change_type IN ('added', 'modified')")
def boxes_for_side(spark, sf_dir):
    feed = part_delta(spark, sf_dir)[0]
    both = [R.boxes(feed, s).select(F.lit(s).alias("side"), "change_type", F.col("bbox.page").cast("long").alias("page"), "label") for s in ("a", "b")]
    return both[0].unionByName(both[1])


@query(ELEMENTS + NAMED + "SELECT 'delta:' || change_type || ':' || coalesce(old_element_id, '_') || ':' || coalesce(new_element_id, '_') AS id, sentence AS text, pid_a || '→' || pid_b AS pid, element_type AS type, CAST(page AS BIGINT) AS page FROM named")
def delta_chunk_rows(spark, sf_dir):
    feed = part_delta(spark, sf_dir)[0]
    return retrieval.delta_chunks(feed, "deltas", part_pairs(feed)).select("id", "text", "pid", "type", F.col("page").cast("long").alias("page"))


@query("""WITH n AS (SELECT 'customer' AS s, c_name AS t FROM customer), m AS (SELECT 'supplier' AS s, s_name AS t FROM supplier),
r AS (SELECT (SELECT count(*) FROM n) AS keyed_a, (SELECT count(*) FROM m) AS keyed_b, (SELECT count(*) FROM n JOIN m USING (t)) AS matched)
SELECT keyed_a, keyed_b, matched, least(keyed_a, keyed_b) >= 20 AND matched / greatest(least(keyed_a, keyed_b), 1) < 0.5 AS warned FROM r""")
def negative_control_warning(spark, sf_dir):
    """Two tables that aren't revisions of each other must raise a warning."""

    def rows(name, column, side):
        zero = F.lit(0.0)
        box = F.struct(F.lit(0).alias("page"), zero.alias("x0"), zero.alias("y0"), zero.alias("x1"), zero.alias("y1"), F.lit(1.0).alias("page_width"), F.lit(1.0).alias("page_height"), F.lit("pdf_points").alias("unit"))
        return table(spark, sf_dir, name).select(F.lit("control").alias("pair_id"), F.concat(F.lit(side), F.col(column)).alias("id"), F.lit("tag").alias("type"), F.col(column).alias("text"), box.alias("bbox"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(1.0).alias("extraction_confidence"))

    a, b = rows("customer", "c_name", "a"), rows("supplier", "s_name", "b")
    matches = A.exact_key(A.located(a), A.located(b))
    stats = delta.statistics(matches, delta.change_feed(matches, a, b), a, b)
    return stats.select("keyed_a", "keyed_b", "matched", F.exists("warnings", lambda w: w["kind"] == "low_exact_key_rate").alias("warned"))


# Line items: (order, line number) repeats, so equal keys have to be assigned.

LINES = """
rows_ AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS layer, l_linestatus AS entity, l_quantity AS q, l_extendedprice AS p,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS r FROM lineitem)
"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("entity"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.row_number().over(order).cast("long").alias("r"))


def _rounds(group: list[str], n: int) -> str:
    """Mutual-best rounds over c0(group, a_id, b_id, score, d), unrolled."""
    g = ", ".join(group)
    same = " AND ".join(f"x.{c} = c.{c}" for c in group)
    out = []
    for i in range(n):
        out.append(f"m{i} AS (SELECT {g}, a_id, b_id, score, d FROM (SELECT *, row_number() OVER (PARTITION BY {g}, a_id ORDER BY score DESC, a_id, b_id) AS ra, row_number() OVER (PARTITION BY {g}, b_id ORDER BY score DESC, a_id, b_id) AS rb FROM c{i}) WHERE ra = 1 AND rb = 1)")
        out.append(f"c{i + 1} AS (SELECT c.* FROM c{i} c WHERE NOT EXISTS (SELECT 1 FROM m{i} x WHERE {same} AND x.a_id = c.a_id) AND NOT EXISTS (SELECT 1 FROM m{i} x WHERE {same} AND x.b_id = c.b_id))")
    return ",\n".join(out) + ",\nmatched AS (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(n)) + ")"


@query(
    "WITH "
    + LINES
    + """, c0 AS (SELECT a.o, a.n, a.r AS a_id, b.r AS b_id, 1 - abs(a.p - b.p) / 100000 AS score, abs(a.p - b.p) / 100000 AS d FROM rows_ a JOIN rows_ b ON a.o = b.o AND a.n = b.n AND a.q <= 25 AND b.q > 25),
"""
    + _rounds(["o", "n"], 8)
    + " SELECT o, n, a_id, b_id, round(score, 9) AS score FROM matched"
)
def delta_duplicates_greedy(spark, sf_dir):
    rows = numbered_lines(spark, sf_dir)
    a = rows.filter("q <= 25").select("o", "n", F.col("r").alias("a_id"), F.col("p").alias("ap"))
    b = rows.filter("q > 25").select("o", "n", F.col("r").alias("b_id"), F.col("p").alias("bp"))
    far = F.abs(F.col("ap") - F.col("bp")) / 100000
    candidates = a.join(b, ["o", "n"]).select("o", "n", "a_id", "b_id", (1 - far).alias("score"))
    return assign.one_to_one(candidates, ["o", "n"]).withColumn("score", F.round("score", 9))


GEOMETRY = (
    "WITH "
    + LINES
    + """, g AS (SELECT o, layer, entity, CASE WHEN n % 2 = 0 THEN 'B' ELSE '' END AS block, q / 50 AS x, p / 100000 AS y, r FROM rows_),
c0 AS (SELECT a.o, a.layer, a.entity, a.block, a.r AS a_id, b.r AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, 1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS score
  FROM g a JOIN (SELECT o, layer, entity, block, x + 0.0123 AS x, y + 0.0045 AS y, r FROM g) b ON a.o = b.o AND a.layer = b.layer AND a.entity = b.entity AND a.block = b.block
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= CASE WHEN a.block <> '' THEN 0.3 ELSE 0.03 END)"""
)


def line_geometry(spark, sf_dir):
    """Line items as drawn elements, one drawing per order; the second revision is shifted."""
    g = numbered_lines(spark, sf_dir).select(F.col("o").cast("string").alias("pair_id"), F.col("r").alias("id"), F.lit("geometry").alias("type"), "layer", "entity", F.when(F.col("n") % 2 == 0, "B").otherwise("").alias("block"), F.lit(0).alias("page"), (F.col("q") / 50).alias("x"), (F.col("p") / 100000).alias("y"))
    return g, g.withColumns({"x": F.col("x") + 0.0123, "y": F.col("y") + 0.0045})


@query(GEOMETRY + " SELECT CAST(o AS VARCHAR) AS pair_id, layer, entity, block, a_id, b_id, round(d, 6) AS d FROM c0")
def geometry_candidates(spark, sf_dir):
    return A.geometry_candidates(*line_geometry(spark, sf_dir)).select("pair_id", "layer", "entity", "block", "a_id", "b_id", F.round("d", 6).alias("d"))


@query(GEOMETRY + ",\n" + _rounds(["o", "layer", "entity", "block"], 10) + " SELECT CAST(o AS VARCHAR) AS pair_id, a_id, b_id, 'geometry' AS tier, round(score, 6) AS match_score, round(d, 6) AS bbox_distance FROM matched")
def geometry_match(spark, sf_dir):
    return A.geometry(*line_geometry(spark, sf_dir)).withColumns({"match_score": F.round("match_score", 6), "bbox_distance": F.round("bbox_distance", 6)})


PROXIMITY = """
WITH v AS (SELECT vec_id AS k, label AS type, vec_id % 4 AS page, ((vec_id * 37) % 101) / 101 AS x, ((vec_id * 53) % 97) / 97 AS y, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT a.type, a.page, a.k AS a_id, b.k AS b_id, sqrt((a.x - b.x - 0.0041) * (a.x - b.x - 0.0041) + (a.y - b.y - 0.0033) * (a.y - b.y - 0.0033)) AS d, list_dot_product(a.e, b.e) AS sim
  FROM v a JOIN v b ON a.type = b.type AND a.page = b.page)
"""


def placed_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit("p").alias("pair_id"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.lit("some text").alias("text"), (F.col("vec_id") % 4).alias("page"), ((F.col("vec_id") * 37) % 101 / 101).alias("x"), ((F.col("vec_id") * 53) % 97 / 97).alias("y"), "embedding")
    return v, v.withColumns({"x": F.col("x") + 0.0041, "y": F.col("y") + 0.0033})


@query(
    PROXIMITY
    + "SELECT CAST(type AS VARCHAR) AS type, page, a_id, b_id, round(d, 6) AS d, round(CASE WHEN d <= 0.02 THEN 0.9 + 0.1 * (1 - d / 0.02) ELSE sim * 0.89 END, 6) AS score FROM near WHERE d <= 0.02 OR (d <= 0.15 AND sim >= 0.75)"
)
def proximity_candidates(spark, sf_dir):
    return A.proximity_candidates(*placed_vectors(spark, sf_dir)).select("type", "page", "a_id", "b_id", F.round("d", 6).alias("d"), F.round("score", 6).alias("score"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS old_text, '  ' || replace(p_name, ' ', '  ') AS new_text, true AS unchanged FROM part")
def moved_but_same_text_unchanged(spark, sf_dir):
    """Text that only moved, or whose spacing changed, is unchanged."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("text_block").alias("a_type"), F.col("p_name").alias("a_text"), F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("b_text"), F.lit(0.01).alias("bbox_distance"))
    return rows.select("id", F.col("a_text").alias("old_text"), F.col("b_text").alias("new_text"), delta.unchanged().alias("unchanged"))


@query("SELECT p_brand AS k, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS candidates FROM part GROUP BY 1 UNION ALL SELECT p_brand, CAST(1 AS BIGINT), CAST(count(*) * count(*) AS BIGINT) FROM part GROUP BY 1")
def page_scope_guard(spark, sf_dir):
    """Keys on pages 0 and 1 against the same keys on page 1 only: nothing pairs on page 0."""
    rows = table(spark, sf_dir, "part").select(F.lit("p").alias("pair_id"), F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    a = rows.withColumn("page", F.explode(F.array(F.lit(0), F.lit(1))))
    b = rows.withColumn("page", F.lit(1))
    counted = A.exact_key_sizes(a, b).filter("n > 0 and m > 0").select("key", "page", (F.col("n") * F.col("m")).alias("candidates"))
    keys = a.select("key", "page").distinct()
    return keys.join(counted, ["key", "page"], "left").select(F.col("key").alias("k"), F.col("page").cast("long").alias("page"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(ELEMENTS + "SELECT change_type, CAST(4 * count(*) AS BIGINT) AS n FROM feed GROUP BY change_type")
def pages_scale_n(spark, sf_dir):
    """Four copies of every page give four times the changes."""
    a, b = (tables.page_copies(x, 4, 2000) for x in part_elements(spark, sf_dir))
    return delta.compute_delta(a, b)[0].groupBy("change_type").agg(F.count("*").alias("n"))


@query("SELECT text, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_docs(spark, sf_dir):
    """Grouped by digest; the text of a group is fetched once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    groups = d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")
    return d.join(groups.select("copies", "first_id"), F.col("doc_id") == F.col("first_id")).select("text", "copies", "first_id")


@query("SELECT 'c' AS collection, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN lang || ' new' ELSE lang END AS text FROM documents UNION ALL SELECT 'c', CAST(doc_id + 10000000 AS VARCHAR), lang || ' new' FROM documents WHERE doc_id % 3 = 0")
def upsert_latest_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = lambda f, key, text: f.select(F.lit("c").alias("collection"), key.cast("string").alias("id"), text.alias("text"))
    third = d.filter("doc_id % 3 = 0")
    new = F.concat("lang", F.lit(" new"))
    return retrieval.upsert(rows(d, F.col("doc_id"), F.col("lang")), rows(third, F.col("doc_id"), new).unionByName(rows(third, F.col("doc_id") + 10_000_000, new)))
