"""Quality of changes, retrieval and answers against what people expect."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.assign import mutual_best
from plumbline.operators.report import noise
from plumbline.session import dealt, reachable, written
from plumbline.settings import DEFAULT


def similarity(spark, least: float = 0.0):
    """UDF (a, b) -> ratio of matching blocks of the lower-cased texts. Not symmetric; no built-in gives it.

    Below ``least`` it may give 0.0 instead, where a cheap upper bound already shows that.
    """
    reachable(spark)

    def one(x, y):
        from difflib import SequenceMatcher

        if x is None or y is None:
            return None
        x, y = x.lower(), y.lower()
        if x == y:
            return 1.0
        m = SequenceMatcher(None, x, y)
        return 0.0 if least and (m.real_quick_ratio() < least or m.quick_ratio() < least) else m.ratio()

    def ratios(a, b):
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    ratios.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratios, "double")


def texts_match(ratio, a: Column, b: Column, threshold: float = DEFAULT.fuzzy_ratio) -> Column:
    """Equal but for white space at the edges, or alike; null matches null only, an empty text matches an empty one."""
    x, y = X.strip(a), X.strip(b)
    # the ratio is at most twice the shorter length over both: only texts that can reach the threshold go to Python
    m, n = F.length(F.lower(x)), F.length(F.lower(y))
    open_ = (x != y) & (2.0 * F.least(m, n) >= F.lit(threshold) * (m + n) - 1e-9)
    asked = F.coalesce(ratio(F.when(open_, x), F.when(open_, y)) >= threshold, F.lit(False))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x == y, True).when((x == "") | (y == ""), False).otherwise(asked)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """struct<precision,recall,f1>; nothing found and nothing expected counts as right."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def match_deltas(deltas: DataFrame, expected: DataFrame) -> DataFrame:
    """gt_id and delta_id of expected changes that were found, one to one, nearest first.

    deltas: pair_id, delta_id and the change feed's columns; expected: pair_id, gt_id, change_type, element_type,
    old_text, new_text, locator. Pairs meet on change and element type; equal distances go by gt_id, then delta_id.
    """
    ratio = similarity(deltas.sparkSession, DEFAULT.fuzzy_ratio)
    keys = ["pair_id", "change_type", "element_type"]
    want = expected.select(*keys, "gt_id", F.col("old_text").alias("e_old"), F.col("new_text").alias("e_new"), F.col("locator.bbox").alias("e_box"))
    have = deltas.select(*keys, "delta_id", "old_text", "new_text", F.coalesce("new_bbox", "old_bbox").alias("box"))
    both = want.join(dealt(have), keys).filter(texts_match(ratio, F.col("e_old"), F.col("old_text")) & texts_match(ratio, F.col("e_new"), F.col("new_text")))
    mid = lambda i: (F.col("e_box")[i] + F.col("e_box")[i + 2]) / 2
    far = F.hypot(mid(0) - (F.col("box.x0") + F.col("box.x1")) / 2, mid(1) - (F.col("box.y0") + F.col("box.y1")) / 2)
    scored = both.select("pair_id", "gt_id", "delta_id", F.coalesce(F.when(F.col("e_box").isNotNull() & F.col("box").isNotNull(), far), F.lit(0.0)).alias("distance"))
    return mutual_best(scored, ["pair_id"], "gt_id", "delta_id", "distance", ascending=True)


def delta_quality(deltas: DataFrame, expected: DataFrame, pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per pair of ``pairs`` (pair_id, negative_control): counts and rates, also without noise.

    A control pair has no rates; it passes if any warning was raised.
    """
    deltas = written(deltas, "changes")
    found = written(match_deltas(deltas, expected).select("pair_id", "delta_id"), "found")
    tp = found.groupBy("pair_id").agg(F.count("*").alias("tp"))
    wanted = expected.groupBy("pair_id").agg(F.count("*").alias("wanted"))
    false_ = deltas.join(dealt(found), ["pair_id", "delta_id"], "left_anti")
    fp = false_.groupBy("pair_id").agg(F.count("*").alias("fp"))
    noisy = noise(false_).groupBy("pair_id").agg(F.count("*").alias("noise"))
    rows = pairs
    for t in (tp, wanted, fp, noisy, stats.select("pair_id", (F.size("warnings") > 0).alias("warned"))):
        rows = rows.join(dealt(t), "pair_id", "left")
    rows = rows.fillna(0, ["tp", "wanted", "fp", "noise"]).withColumn("fn", F.col("wanted") - F.col("tp"))
    own = lambda c: F.when(~F.col("negative_control"), c)
    return rows.select(
        "pair_id", "negative_control", *[own(F.col(c)).alias(c) for c in ("tp", "fp", "fn", "noise")],
        own(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("prf1"), own(precision_recall_f1(F.col("tp"), F.col("fp") - F.col("noise"), F.col("fn"))).alias("prf1_without_noise"),
        F.when(F.col("negative_control"), F.coalesce("warned", F.lit(False))).alias("passed"),
    )


def overall(quality: DataFrame) -> DataFrame:
    rows = quality.filter("not negative_control").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return rows.withColumn("r", precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))).select("tp", "fp", "fn", "r.*")


def agreement(rows: DataFrame) -> DataFrame:
    """Of human_* and judge_* scores: share of equal ones and mean difference; null where there are no rows."""
    out = []
    for d in ("correctness", "groundedness"):
        human, judge = F.col(f"human_{d}"), F.col(f"judge_{d}")
        out += [F.round(F.avg((human == judge).cast("double")), 4).alias(f"exact_{d}"), F.round(F.avg(F.abs(human - judge)), 4).alias(f"mean_abs_diff_{d}")]
    return rows.agg(F.count("*").alias("n"), *out)


def judged_rows(judged: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows for ``agreement``: held-out questions that both a judge and a person scored.

    judged: qa_id, correctness, groundedness (null where the reply could not be read); labels: the same by people.
    """
    held = questions.filter(F.coalesce("held_out", F.lit(False))).select("qa_id")
    scored = lambda t, who: t.filter("correctness is not null and groundedness is not null").select("qa_id", *[F.col(c).alias(f"{who}_{c}") for c in ("correctness", "groundedness")])
    return scored(judged, "judge").join(scored(labels, "human"), "qa_id").join(held, "qa_id", "left_semi")


def regressed(diff: DataFrame) -> bool:
    """Whether any metric of a scorecard difference got worse; what a gate exits on."""
    return bool(diff.agg(F.max("regressed")).first()[0])


def retrieval_quality(ranked: DataFrame, questions: DataFrame, k: int = DEFAULT.answered_from) -> tuple[DataFrame, DataFrame]:
    """(per question, overall) hit within k and reciprocal rank of the first hit.

    ranked: query_id, rank, text; questions: query_id, answerable, expected (array). Only answerable questions with
    something expected count.
    """
    ratio = similarity(ranked.sparkSession, DEFAULT.fuzzy_ratio)
    asked = questions.filter(F.col("answerable") & (F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0))
    pairs = asked.select("query_id", F.explode("expected").alias("want")).join(ranked.filter(F.col("rank") <= k), "query_id")
    first = pairs.filter(texts_match(ratio, F.col("text"), F.col("want"))).groupBy("query_id").agg(F.min("rank").alias("first"))
    each = asked.select("query_id").join(first, "query_id", "left").select("query_id", F.col("first").isNotNull().cast("double").alias("recall_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
    return each, each.agg(F.count("*").alias("queries"), F.round(F.avg("recall_at_k"), 4).alias("recall_at_k"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"))


def chat_summary(items: DataFrame) -> DataFrame:
    """Averages of answered questions: answerable, refused, correctness and groundedness (null where not judged)."""
    right = (F.col("refused") == ~F.col("answerable")).cast("double")
    return items.agg(
        F.round(F.avg("correctness"), 4).alias("avg_correctness"), F.round(F.avg("groundedness"), 4).alias("avg_groundedness"),
        F.coalesce(F.round(F.avg(F.when(~F.col("answerable"), right)), 4), F.lit(1.0)).alias("refusal_accuracy"),
        F.coalesce(F.round(F.avg(F.when(F.col("answerable"), F.col("refused").cast("double"))), 4), F.lit(0.0)).alias("over_refusal_rate"),
    )


def chat_items(questions: DataFrame, answered: DataFrame, judged: DataFrame) -> DataFrame:
    """One record per question: what was replied, whether refusing was right, its citations and the judge's scores.

    questions: qa_id, question, answerable; answered: qa_id and the columns of ``retrieval.answers``, reply; judged:
    qa_id, correctness, groundedness. A question without an answer counts as refused; one whose judgement is missing or
    could not be read has no scores, and stays. What ``chat_summary`` averages.
    """
    none = F.array().cast("array<string>")
    refused = F.coalesce("refused", F.lit(True))
    scores = judged.filter("correctness is not null and groundedness is not null").select("qa_id", "correctness", "groundedness")
    rows = questions.select("qa_id", "question", "answerable").join(answered.select("qa_id", "reply", "refused", "cited", "invalid"), "qa_id", "left").join(scores, "qa_id", "left")
    return rows.select(
        "qa_id", "question", "answerable", F.coalesce("reply", F.lit("")).alias("answer"), refused.alias("refused"), (refused == ~F.col("answerable")).alias("correct_refusal"),
        F.coalesce("cited", none).alias("citations"), F.coalesce("invalid", none).alias("invalid_citations"), "correctness", "groundedness",
    )


def scorecard_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """label, old, new, delta, regressed of two tables (label, value, higher_is_better); a missing value never regresses."""
    a = old.select("label", F.col("value").alias("old"), F.col("higher_is_better").alias("h_old"))
    b = new.select("label", F.col("value").alias("new"), F.col("higher_is_better").alias("h_new"))
    delta = F.round(F.col("new") - F.col("old"), 4)
    worse = F.when(F.coalesce("h_new", "h_old"), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return a.join(b, "label", "full_outer").withColumn("delta", delta).select("label", "old", "new", "delta", F.coalesce(worse, F.lit(False)).alias("regressed"))
