"""The change feed between two revisions, its statistics and its warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.align import align, leftover
from plumbline.session import dealt, written
from plumbline.settings import DEFAULT, Settings

COLUMNS = ["pair_id", "change_type", "element_type", "old_element_id", "new_element_id", "old_text", "new_text", "old_bbox", "new_bbox", "match_tier", "confidence"]
STILL = 1e-6


def _sided(elements: DataFrame, side: str) -> DataFrame:
    names = ["id", "type", "text", "bbox", "extraction_confidence"]
    return elements.select("pair_id", *[F.col(n).alias(f"{side}_{n}") for n in names])


def unchanged() -> Column:
    """Of a matched pair: geometry that stayed in place, or equal texts."""
    return F.when(F.col("a_type") == "geometry", F.col("bbox_distance") <= STILL).otherwise(X.collapse(F.coalesce("a_text", F.lit(""))) == X.collapse(F.coalesce("b_text", F.lit(""))))


def paired(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches with both elements, and whether they are unchanged."""
    return matches.join(dealt(_sided(a, "a")), ["pair_id", "a_id"]).join(dealt(_sided(b, "b")), ["pair_id", "b_id"]).withColumn("unchanged", unchanged())


def change_feed(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per added, removed or modified element."""
    confidence = F.round(F.least("a_extraction_confidence", "b_extraction_confidence") * F.col("match_score"), 4)
    modified = paired(matches, a, b).filter(~F.col("unchanged")).select(
        "pair_id", F.lit("modified").alias("change_type"), F.col("b_type").alias("element_type"), F.col("a_id").alias("old_element_id"), F.col("b_id").alias("new_element_id"),
        F.col("a_text").alias("old_text"), F.col("b_text").alias("new_text"), F.col("a_bbox").alias("old_bbox"), F.col("b_bbox").alias("new_bbox"), F.col("tier").alias("match_tier"), confidence.alias("confidence"),
    )

    def alone(elements: DataFrame, side: str, change: str) -> DataFrame:
        rows = leftover(elements, matches, side)
        mine, other = ("old", "new") if side == "a" else ("new", "old")
        none = {f"{other}_element_id": "string", f"{other}_text": "string", f"{other}_bbox": elements.schema["bbox"].dataType, "match_tier": "string"}
        own = {f"{mine}_element_id": "id", f"{mine}_text": "text", f"{mine}_bbox": "bbox", "element_type": "type"}
        return rows.select("pair_id", F.lit(change).alias("change_type"), *[F.col(c).alias(n) for n, c in own.items()], *[F.lit(None).cast(t).alias(n) for n, t in none.items()], F.round("extraction_confidence", 4).alias("confidence")).select(*COLUMNS)

    return modified.unionByName(alone(a, "a", "removed")).unionByName(alone(b, "b", "added"))


def in_order(deltas: DataFrame) -> DataFrame:
    empty = F.lit("")
    return deltas.orderBy("pair_id", "change_type", F.coalesce("old_element_id", empty), F.coalesce("new_element_id", empty))


def statistics(matches: DataFrame, deltas: DataFrame, a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per pair: counts, rates and warnings."""
    key = X.element_key(F.col("type"), F.col("text"), F.col("attributes"))
    tiers = ["exact_key", "geometry", "embedding_proximity"]
    change = ["added", "removed", "modified"]
    counts = ["total_a", "keyed_a", "total_b", "keyed_b", "matched", *tiers, *change]

    def counted(rows: DataFrame, **flags: Column) -> DataFrame:
        return rows.select("pair_id", *[flags.get(n, F.lit(False)).alias(n) for n in counts])

    # one aggregation over what is counted: no joins of the four counts
    parts = [counted(e, **{f"total_{x}": F.lit(True), f"keyed_{x}": key.isNotNull()}) for e, x in ((a, "a"), (b, "b"))]
    parts += [counted(matches, matched=F.lit(True), **{t: F.col("tier") == t for t in tiers}), counted(deltas, **{c: F.col("change_type") == c for c in change})]
    rows = reduce(DataFrame.unionByName, parts).groupBy("pair_id").agg(*[F.count_if(F.col(n)).alias(n) for n in counts]).filter("total_a + total_b > 0")
    at_least_one = lambda x: F.greatest(x, F.lit(1))
    rate = F.col("exact_key") / at_least_one(F.least("keyed_a", "keyed_b"))
    fraction = (F.col("keyed_a") + F.col("keyed_b")) / at_least_one(F.col("total_a") + F.col("total_b"))
    low_rate = (F.least("keyed_a", "keyed_b") >= s.least_keyed) & (rate < s.low_key_rate)
    low_fraction = (F.col("total_a") + F.col("total_b") >= s.least_elements) & (fraction < s.low_keyed_fraction)
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    words = F.array(
        F.when(low_rate, F.struct(F.lit("low_exact_key_rate").alias("kind"), rate.alias("value"), F.concat(F.lit("Only "), percent(rate), F.lit(" of the identified elements have a counterpart; these may not be revisions of one document.")).alias("message"))),
        F.when(low_fraction, F.struct(F.lit("low_keyed_fraction").alias("kind"), fraction.alias("value"), F.concat(F.lit("Only "), percent(fraction), F.lit(" of the elements could be identified; most were paired by place and likeness.")).alias("message"))),
    )
    return rows.select(
        "pair_id", "total_a", "total_b", "keyed_a", "keyed_b", "matched", (F.col("matched") - F.col("modified")).alias("unchanged"), "added", "removed", "modified",
        F.map_from_arrays(F.array(*[F.lit(t) for t in tiers]), F.array(*[F.col(t) for t in tiers])).alias("matched_by_tier"),
        F.round(F.col("matched") / at_least_one(F.least("total_a", "total_b")), 4).alias("alignment_rate"), F.round(rate, 4).alias("exact_key_rate"),
        F.filter(words, lambda x: x.isNotNull()).alias("warnings"),
    )


def compute_delta(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(change feed, statistics) of all pairs of two element tables with pair_id; no model takes part.

    An ``embedding`` column (unit vectors) feeds the last tier; without it only very near elements pair there. Null
    texts are empty; an element without a box pairs by key only if that is its page's one; empty tables give no rows.
    """
    matches = align(a, b, s)
    # computed once, however often it is read: its joins are not planned, compiled and run again for each use
    deltas = written(change_feed(matches, a, b), "feed")
    return deltas, statistics(matches, deltas, a, b, s)
