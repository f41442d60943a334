"""Tables of elements, matches and changes are not broadcast: the driver would hold them whole, however small they are on disk."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import align as A
from plumbline.operators import assign, delta, evaluation
from plumbline.plans import catalogue
from plumbline.plans.changes import part_elements

QUERIES = ["delta_engine", "boxes_for_side", "delta_chunk_rows", "delta_counts_by_element_type", "delta_counts_by_page", "delta_sentences", "delta_stats_and_warnings", "feed_filters", "ground_truth_quality", "pages_scale_n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_queries_of_changes(spark, sf_dir, name):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b")
    assert "Broadcast" not in plan(catalogue.queries()[name](spark, sf_dir))


@pytest.mark.parametrize(("name", "joins"), [("delta_chunk_rows", 1), ("delta_counts_by_element_type", 0), ("delta_sentences", 1), ("delta_stats_and_warnings", 3), ("feed_filters", 0), ("ground_truth_quality", 9)])
def test_changes_are_computed_once(spark, sf_dir, name, joins):
    """What reads the change feed has its own joins in its plan, and not those that make the feed."""
    assert len(re.findall("Join", plan(catalogue.queries()[name](spark, sf_dir)))) <= joins


def test_plans_of_a_delta_are_small(spark, sf_dir, monkeypatch):
    """No plan that is run for change feed or statistics holds the joins of all tiers again and again; the statistics have none."""
    plans = []
    for module in (A, assign, delta):
        monkeypatch.setattr(module, "written", lambda df, name, put=module.written: plans.append((name, plan(df))) or put(df, name))
    told = plan(catalogue.queries()["delta_stats_and_warnings"](spark, sf_dir))
    assert "Join" not in told and {"matches", "feed"} <= {n for n, _ in plans}
    assert max(len(re.findall("Join", p)) for _, p in plans) <= 5


def test_statistics_of_odd_pairs(spark, sf_dir):
    """A pair that one side only has, one without changes, and matches of a pair that neither has."""
    a, b = part_elements(spark, sf_dir)
    a, b = (x.withColumn("pair_id", F.lit("same")).filter("id not like '%:1%'").limit(7) for x in (a, b))
    a = a.withColumn("n", F.monotonically_increasing_id()).withColumn("pair_id", F.when(F.col("n") < 2, "gone").otherwise(F.col("pair_id"))).drop("n")
    found = spark.createDataFrame([("same", "a:x", "b:x", "exact_key", 1.0, 0.0), ("other", "a:y", "b:y", "geometry", 1.0, 0.0)], "pair_id string, a_id string, b_id string, tier string, match_score double, bbox_distance double")
    feed = spark.createDataFrame([("gone", "removed"), ("gone", "removed"), ("other", "added")], "pair_id string, change_type string")
    rows = {r.pair_id: r for r in delta.statistics(found, feed, a, b).collect()}
    assert set(rows) == {"same", "gone"}
    same, gone = rows["same"], rows["gone"]
    assert (same.total_a, same.total_b, same.matched, same.added, same.removed, same.modified) == (5, 7, 1, 0, 0, 0) and same.matched_by_tier == {"exact_key": 1, "geometry": 0, "embedding_proximity": 0}
    assert (gone.total_a, gone.total_b, gone.matched, gone.unchanged, gone.removed, gone.alignment_rate) == (2, 0, 0, 0, 2, 0.0)


def test_places_of_changes(spark, sf_dir):
    """What is sent there is one row a partition; the changes themselves are not."""
    told = plan(catalogue.queries()["delta_in_order"](spark, sf_dir))
    assert "SortMergeJoin" not in told and told.count("BroadcastExchange") <= 1


def test_joins_of_elements(spark, sf_dir):
    a, b = part_elements(spark, sf_dir)
    x, y = A.located(a), A.located(b)
    found = spark.createDataFrame([("0", "a:1", "b:1", "exact_key", 1.0, 0.0)], "pair_id string, a_id string, b_id string, tier string, match_score double, bbox_distance double")
    feed = delta.change_feed(found, a, b)
    pairs = assign.mutual_best(A.proximity_candidates(x, y), ["pair_id", "type", "page"], rest=0)
    joins = [A.exact_key_candidates(x, y), A.geometry_candidates(x, y), A.proximity_candidates(x, y), A.leftover(x, found, "a"), feed, delta.statistics(found, feed, a, b), pairs]
    assert not [p for p in map(plan, joins) if "Broadcast" in p]


def test_quality_of_changes(spark, sf_dir):
    a, b = part_elements(spark, sf_dir)
    feed, stats = delta.compute_delta(a, b)
    deltas = feed.withColumn("delta_id", feed.old_element_id).limit(3)
    expected = deltas.selectExpr("pair_id", "delta_id as gt_id", "change_type", "element_type", "old_text", "new_text", "struct(array(0D, 0D, 0D, 0D) as bbox) as locator")
    assert "Broadcast" not in plan(evaluation.delta_quality(deltas, expected, deltas.selectExpr("pair_id", "false as negative_control").distinct(), stats))


def test_candidates_are_counted_without_making_them(spark):
    """A key of 200,000 elements on either side of a page makes 40 billion candidates; small keys as many as the join."""
    rows = [("p", str(i), f"k{i % 7}" if i % 11 else None, i % 3, 0.0, 0.0) for i in range(90)]
    a = spark.createDataFrame(rows, "pair_id string, id string, key string, page int, x double, y double")
    b = a.filter("page > 0 and key <> 'k3'")
    made = {tuple(r) for r in A.exact_key_candidates(a, b).groupBy("pair_id", "key", "page").count().collect()}
    assert {(r.pair_id, r.key, r.page, r.n * r.m) for r in A.exact_key_sizes(a, b).collect() if r.n * r.m} == made
    many = spark.range(200_000).selectExpr("'p' as pair_id", "cast(id as string) as id", "'k' as key", "0 as page", "0D as x", "0D as y")
    assert [tuple(r) for r in A.exact_key_sizes(many, many).collect()] == [("p", "k", 0, 200_000, 200_000)]
