"""Pairing the elements of two revisions, in three tiers; each works on what the former left.

Elements carry ``pair_id``; all pairs are aligned in one job. Ids are unique within a pair and a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text as X
from plumbline.operators.assign import mutual_best, one_to_one
from plumbline.schemas import MATCH
from plumbline.session import dealt, written
from plumbline.settings import DEFAULT, Settings

_NAMES = [x.split(" ")[0] for x in MATCH.split(", ")]


def located(elements: DataFrame) -> DataFrame:
    """What alignment needs of an element: key, centre, page and the rest of the tiers' keys."""
    x, y = G.centre(F.col("bbox"))
    part = lambda name: F.coalesce(F.col("attributes")[name], F.lit(""))
    vector = [F.col("embedding")] if "embedding" in elements.columns else [F.lit(None).cast("array<float>").alias("embedding")]
    return elements.select(
        "pair_id", "id", "type", "text", F.col("bbox.page").alias("page"), x.alias("x"), y.alias("y"),
        X.element_key(F.col("type"), F.col("text"), F.col("attributes")).alias("key"),
        part("layer").alias("layer"), part("entity_type").alias("entity"), part("block_name").alias("block"), *vector,
    )


def _side(rows: DataFrame, side: str, shared: list[str]) -> DataFrame:
    return rows.select(*shared, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in shared])


def _distance():
    return G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))


def _matched(pairs: DataFrame, tier: str, score=None) -> DataFrame:
    return pairs.select("pair_id", "a_id", "b_id", F.lit(tier).alias("tier"), (score if score is not None else F.col("score")).alias("match_score"), F.col("d").alias("bbox_distance"))


def exact_key_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = ["pair_id", "key", "page"]
    keyed = [_side(x.filter("key is not null"), s, shared) for x, s in ((a, "a"), (b, "b"))]
    d = _distance()
    return keyed[0].join(dealt(keyed[1]), shared).select(*shared, "a_id", "b_id", d.alias("d"), (1 - d).alias("score"))


def exact_key_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each key on a page: how many elements have it on either side (n, m). It makes n * m candidates, counted without making them."""
    shared = ["pair_id", "key", "page"]
    sides = [x.filter("key is not null").select(*shared, F.lit(i).alias("side")) for i, x in ((0, a), (1, b))]
    return sides[0].unionByName(sides[1]).groupBy(*shared).agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))


#: Pairs of one key and page up to which all are candidates at once.
CROWDED = 10_000
#: Radii in which the elements of a crowded key are paired, one after the other; at last all that are left meet.
_RADII = (0.0025, 0.01, 0.04, 0.16, 0.64, None)


def exact_key(a: DataFrame, b: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Equal keys on one page; of several, the nearest.

    A key that many elements of a page share would make as many candidates as the product of both sides; above
    ``crowded`` its elements are paired radius by radius, with the same result.
    """
    shared = ["pair_id", "key", "page"]
    many = written(exact_key_sizes(a, b).filter(F.col("n") * F.col("m") > crowded).select(*shared), "crowded")
    if many.isEmpty():
        return _matched(one_to_one(exact_key_candidates(a, b), shared), "exact_key", F.lit(1.0))
    few = [x.join(many, shared, "left_anti") for x in (a, b)]
    plain = _matched(one_to_one(exact_key_candidates(*few), shared), "exact_key", F.lit(1.0))
    return plain.unionByName(_matched(_nearest_first(*[written(x.join(many, shared, "left_semi"), "crowd") for x in (a, b)], shared), "exact_key", F.lit(1.0)))


def _nearest_first(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    """One-to-one pairs by distance, then ids: shared, a_id, b_id, d.

    What the nearest-first order takes within a radius depends on pairs within it only, so radii can follow each other,
    each for what is left. Elements at one place come first: there the order pairs the first with the first, and so on.
    """
    left = [_side(x.select(*shared, "id", "x", "y"), s, shared) for x, s in ((a, "a"), (b, "b"))]
    at = [*shared, "x", "y", "nth"]
    nth = [x.select(*shared, F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y"), f"{s}_id").withColumn("nth", F.row_number().over(Window.partitionBy(*shared, "x", "y").orderBy(f"{s}_id"))) for x, s in zip(left, "ab", strict=True)]
    names = [*shared, "a_id", "b_id", "d"]
    found = written(nth[0].join(dealt(nth[1]), at).withColumn("d", F.lit(0.0)).select(*names), "in-place")
    taken = found
    for radius in _RADII:
        left = [written(x.join(dealt(found.select(*shared, f"{s}_id")), [*shared, f"{s}_id"], "left_anti"), "left") for x, s in zip(left, "ab", strict=True)]
        if left[0].isEmpty() or left[1].isEmpty():
            break
        keys, (p, q) = shared, left
        if radius is not None:
            cell = [G.cells(F.col(f"{s}_x"), F.col(f"{s}_y"), radius * 1.001, s == "b") for s in "ab"]
            keys, p, q = [*shared, "cell"], p.withColumn("cell", cell[0]), q.withColumn("cell", F.explode(cell[1]))
        near = p.join(dealt(q), keys).withColumn("d", _distance()).select(*names)
        found = mutual_best(near if radius is None else near.filter(F.col("d") <= radius), shared, score="d", ascending=True)
        taken = taken.unionByName(found)
    return taken


def geometry_candidates(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Equal layer, entity, block and page, within the radius; a grid cell of that size is part of the join's key."""
    shared = ["pair_id", "layer", "entity", "block", "page"]
    wide, near = s.geometry_distance_named * 1.001, s.geometry_distance_unnamed * 1.001
    cell = lambda around: F.when(F.col("block") != "", F.array(G.cells(F.col("x"), F.col("y"), wide, False)) if not around else G.cells(F.col("x"), F.col("y"), wide, True)).otherwise(F.array(G.cells(F.col("x"), F.col("y"), near, False)) if not around else G.cells(F.col("x"), F.col("y"), near, True))
    sides = []
    for rows, side, around in ((a, "a", False), (b, "b", True)):
        drawn = rows.filter("type = 'geometry'").select(*shared, "id", "x", "y", F.explode(cell(around)).alias("cell"))
        sides.append(_side(drawn, side, [*shared, "cell"]))
    d = _distance()
    radius = F.when(F.col("block") != "", s.geometry_distance_named).otherwise(s.geometry_distance_unnamed)
    return sides[0].join(dealt(sides[1]), [*shared, "cell"]).withColumn("d", d).filter(F.col("d") <= radius).select(*shared, "a_id", "b_id", "d", (1 - F.col("d")).alias("score"))


def geometry(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _matched(one_to_one(geometry_candidates(a, b, s), ["pair_id", "layer", "entity", "block", "page"]), "geometry")


def dot(a, b):
    """Inner product of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def proximity_candidates(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Equal type and page; very near, or near and alike.

    The grid cell makes it an equi-join: a point meets the points of its own and the eight cells around. Vectors are
    not part of the join; only the ids of near pairs fetch them.
    """
    shared = ["pair_id", "type", "page"]
    size = max(s.loose_distance, s.tight_distance) * 1.001
    sides = []
    for rows, side, around in ((a, "a", False), (b, "b", True)):
        cell = G.cells(F.col("x"), F.col("y"), size, around)
        text = rows.filter(~X.blank(F.col("text"))).select(
            *shared, "id", "x", "y", (F.length(X.strip(F.col("text"))) >= s.least_embedded_length).alias("long"), (F.explode(cell) if around else cell).alias("cell")
        )
        sides.append(_side(text, side, [*shared, "cell"]))
    near = sides[0].join(dealt(sides[1]), [*shared, "cell"]).withColumn("d", _distance()).filter(F.col("d") <= s.loose_distance).select(*shared, "a_id", "b_id", "d", (F.col("a_long") & F.col("b_long")).alias("long"))
    tight = F.when(F.lit(s.tight_distance) > 0, 0.9 + 0.1 * (1 - F.col("d") / F.lit(s.tight_distance or 1.0))).otherwise(1.0)
    close = near.filter(F.col("d") <= s.tight_distance).withColumn("score", tight)
    vectors = [dealt(rows.filter("embedding is not null").select("pair_id", F.col("id").alias(f"{x}_id"), F.col("embedding").alias(f"{x}_v"))) for rows, x in ((a, "a"), (b, "b"))]
    alike = near.filter((F.col("d") > s.tight_distance) & F.col("long")).join(vectors[0], ["pair_id", "a_id"]).join(vectors[1], ["pair_id", "b_id"])
    alike = alike.withColumn("sim", dot(F.col("a_v"), F.col("b_v"))).filter(F.col("sim") >= s.embedding_similarity).withColumn("score", F.col("sim") * 0.89)
    names = [*shared, "a_id", "b_id", "d", "score"]
    return close.select(*names).unionByName(alike.select(*names))


def proximity(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return _matched(one_to_one(proximity_candidates(a, b, s), ["pair_id", "type", "page"]), "embedding_proximity")


def leftover(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return rows.join(dealt(matches.select("pair_id", F.col(f"{side}_id").alias("id"))), ["pair_id", "id"], "left_anti")


def align(a: DataFrame, b: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All matches of two element tables (columns: see MATCH)."""
    left_a, left_b = written(located(a), "located-a"), written(located(b), "located-b")
    found = None
    tiers = [exact_key, lambda x, y: geometry(x, y, s), lambda x, y: proximity(x, y, s)]
    for tier in tiers:
        matches = written(tier(left_a, left_b).select(*_NAMES), "matches")
        found = matches if found is None else found.unionByName(matches)
        if tier is not tiers[-1] and not matches.isEmpty():
            # computed once: a tier reads its sides several times, and each reading would plan and run the joins of all tiers before
            left_a, left_b = (written(leftover(x, matches, side), f"left-{side}") for x, side in ((left_a, "a"), (left_b, "b")))
    return found
