"""Aggregates over span logs (columns: see schemas.SPAN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import cost as token_cost
from plumbline.session import written
from plumbline.settings import DEFAULT, Settings

LLM_SPANS = ["llm.complete", "llm.read_image_text"]
DELTA_SPAN = "delta.compute"
RETRIEVAL_SPAN = "eval.retrieval_query"


def attribute(name: str, kind: str = "string") -> Column:
    return F.col("attributes")[name].try_cast(kind)


def latency(spans: DataFrame) -> DataFrame:
    """Per name: count, mean, exact percentiles by linear interpolation, maximum.

    Equal durations of a name are counted first. Ranks come from a table sorted by range, in which a frequent name lies
    over many partitions, so that no task holds all durations of a name. Null durations count as spans only; null names
    are one name; an empty table gives no rows.
    """
    at = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    counted = written(spans.groupBy("name", "duration_ms").agg(F.count("*").alias("n")), "durations")
    timed = F.when(F.col("duration_ms").isNotNull(), F.col("n"))
    told = counted.groupBy("name").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("duration_ms") * F.col("n")) / F.sum(timed), 3).alias("mean_ms"), F.round(F.max("duration_ms"), 3).alias("max_ms"))

    placed = written(counted.filter("duration_ms is not null").orderBy("name", "duration_ms").withColumn("part", F.spark_partition_id()), "ranked")
    so_far = Window.partitionBy("part", "name").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part", "name").agg(F.sum("n").alias("held"))
    parts = parts.select("part", F.col("name").alias("of"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("name")).alias("all"))
    ranked = placed.withColumn("last", F.sum("n").over(so_far)).join(parts.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("name").eqNullSafe(F.col("of")))
    ranked = ranked.select("name", "duration_ms", "all", (F.col("before") + F.col("last") - F.col("n")).alias("first"), (F.col("before") + F.col("last") - 1).alias("last"))
    place = {n: F.lit(p) * (F.col("all") - 1) for n, p in at.items()}
    holds = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("duration_ms")))
    ends = [x for n, pos in place.items() for x in (holds(F.floor(pos)).alias(f"{n}_low"), holds(F.ceil(pos)).alias(f"{n}_high"))]
    found = ranked.groupBy(F.col("name").alias("of"), "all").agg(*ends)
    share = lambda n: place[n] - F.floor(place[n])  # noqa: E731  of the upper one
    mixed = lambda n: F.col(f"{n}_low") * (F.ceil(place[n]) - place[n]) + F.col(f"{n}_high") * share(n)  # noqa: E731  as the built-in percentile weighs them
    between = lambda n: F.round(F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(mixed(n)), 3).alias(n)
    found = found.select("of", *[between(n) for n in at])
    return told.join(found, F.col("name").eqNullSafe(F.col("of")), "left").select("name", "n", "mean_ms", *at, "max_ms")


def usage(spans: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Calls, tokens and cost by model, by purpose and in all: kind ('model', 'purpose', 'total'), name.

    A span without its own cost is charged at the settings' rates.
    """
    tokens_in, tokens_out = F.coalesce(attribute("input_tokens", "long"), F.lit(0)), F.coalesce(attribute("output_tokens", "long"), F.lit(0))
    calls = spans.filter(F.col("name").isin(LLM_SPANS) & attribute("input_tokens").isNotNull()).select(
        F.coalesce(attribute("model"), F.lit("unknown")).alias("model"), F.coalesce(F.nullif(attribute("purpose"), F.lit("")), F.lit("untagged")).alias("purpose"),
        tokens_in.alias("i"), tokens_out.alias("o"), F.coalesce(attribute("cost_usd", "double"), token_cost(tokens_in, tokens_out, s.cost_in, s.cost_out)).alias("c"),
    )
    sums = [F.count("*").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.round(F.sum("c"), 6).alias("cost_usd")]
    grouped = calls.groupingSets([["model"], ["purpose"], []], "model", "purpose").agg(F.grouping_id().alias("g"), *sums)
    kind = F.when(F.col("g") == 1, "model").when(F.col("g") == 2, "purpose").otherwise("total")
    counted = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cost_usd")}
    return grouped.withColumns(counted).select(kind.alias("kind"), F.coalesce("model", "purpose", F.lit("all")).alias("name"), "calls", "input_tokens", "output_tokens", "cost_usd")


def cost_per_call(used: DataFrame) -> DataFrame:
    return used.filter("kind = 'purpose'").select(F.col("name").alias("purpose"), "calls", F.round(F.col("cost_usd") / F.greatest("calls", F.lit(1)), 6).alias("cost_per_call"))


def delta_totals(spans: DataFrame) -> DataFrame:
    rows = spans.filter((F.col("name") == DELTA_SPAN) & attribute("added").isNotNull())
    total = lambda n: F.coalesce(F.sum(attribute(n, "long")), F.lit(0)).alias(f"total_{n}")
    return rows.agg(F.count("*").alias("runs"), *[total(n) for n in ("added", "removed", "modified")], *[F.round(F.avg(attribute(n, "double")), 4).alias(f"avg_{n}") for n in ("alignment_rate", "exact_key_rate")])


def retrieval_metrics(spans: DataFrame) -> DataFrame:
    """One row, or none where nothing was evaluated."""
    rows = spans.filter(F.col("name") == RETRIEVAL_SPAN)
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(attribute("recall_at_k", "double")), 4).alias("recall_at_k"), F.round(F.avg(attribute("mrr", "double")), 4).alias("mean_reciprocal_rank")).filter("queries > 0")


def error_rate(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("total_spans"), F.coalesce(F.round(F.avg((F.coalesce("status", F.lit("")) == "error").cast("double")), 4), F.lit(0.0)).alias("error_rate"))


def labelled_latency(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """Latency of the stages that ``labels`` (name, label) names; absent stages are left out."""
    return latency(spans).join(labels, "name")


def span_tree(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"))
    return spans.join(parents, ["trace_id", "parent_span_id"], "left")
