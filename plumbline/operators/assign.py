"""One-to-one assignment: best candidates first, each side used once.

The order (score down, a_id, b_id) is total, so taking candidates one by one gives the same pairs as taking, again and
again, all candidates that are the best of both their sides. That is the distributed form: two rankings a round, no
group in one task's memory. ``grouped`` is the form for many small groups: one pass, one Python call a group.
"""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import dealt, reachable, written


#: Candidates that one task takes one by one.
REST = 20_000


def mutual_best(candidates: DataFrame, group: list[str], a: str = "a_id", b: str = "b_id", score: str = "score", ascending: bool = False, ties: list[str] | None = None, rest: int = REST) -> DataFrame:
    """The assigned rows of ``candidates``. ``group`` columns are part of both sides' identity.

    Rows with a null id or score are no candidates; of equal rows one is used. ``ties`` (default: a, b) decide between
    equal scores. Up to ``rest`` candidates of all groups together are taken one by one, with the same result.
    """
    order = [F.col(score).asc() if ascending else F.col(score).desc(), *[F.col(x) for x in (ties or [a, b])]]
    by_a, by_b = (Window.partitionBy(*group, x).orderBy(*order) for x in (a, b))
    left = candidates.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(score).isNotNull()).dropDuplicates([*group, a, b])
    taken: DataFrame | None = None
    while True:
        ranked = written(left.withColumn("_best", (F.row_number().over(by_a) == 1) & (F.row_number().over(by_b) == 1)), "candidates")
        best = ranked.filter("_best").drop("_best")
        taken = best if taken is None else taken.unionByName(best)
        left = ranked.filter("not _best").drop("_best").join(dealt(best.select(*group, a)), [*group, a], "left_anti").join(dealt(best.select(*group, b)), [*group, b], "left_anti").select(*candidates.columns)
        waiting = ranked.filter("not _best").count()
        if not waiting:
            return taken
        if waiting <= rest:
            return taken.unionByName(grouped(left, group, a, b, score, ascending, ties))


def grouped(candidates: DataFrame, group: list[str], a: str = "a_id", b: str = "b_id", score: str = "score", ascending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """The same pairs for groups that are known to be small."""
    reachable(candidates.sparkSession)
    columns, ties = candidates.columns, ties or [a, b]

    def take(rows):
        ranked = rows.take(pc.sort_indices(rows, [(score, "ascending" if ascending else "descending"), *[(t, "ascending") for t in ties]]))
        used_a, used_b, kept = set(), set(), []
        for i, (x, y) in enumerate(zip(ranked[a].to_pylist(), ranked[b].to_pylist(), strict=True)):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                kept.append(i)
        return ranked.take(kept).select(columns)

    full = candidates.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(score).isNotNull())
    return full.groupBy(*group).applyInArrow(take, candidates.schema)


def one_to_one(candidates: DataFrame, group: list[str], small_groups: bool = False) -> DataFrame:
    """Candidates that are alone on both sides need no ranking; the others are assigned."""
    alone_a, alone_b = Window.partitionBy(*group, "a_id"), Window.partitionBy(*group, "b_id")
    counted = written(candidates.withColumn("_alone", (F.count("*").over(alone_a) == 1) & (F.count("*").over(alone_b) == 1)), "counted")
    direct, contested = counted.filter("_alone").drop("_alone"), counted.filter("not _alone").drop("_alone")
    if contested.isEmpty():
        return direct
    return direct.unionByName(grouped(contested, group) if small_groups else mutual_best(contested, group))
