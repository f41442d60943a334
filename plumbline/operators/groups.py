"""Sequential rules over sorted groups, without one Python call and one data frame per group; places in a sorted table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import reachable, written


def sorted_groups(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[dict[str, list]], list[tuple]], schema) -> DataFrame:
    """``rule`` over each group's rows, as lists by column in ``order``; it gives rows of ``schema``."""
    fields = _shape(schema).fieldNames()

    def ruled(pdf, starts):
        data = {c: pdf[c].tolist() for c in pdf.columns}
        ends = np.append(starts[1:], len(pdf))
        rows = [row for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for row in rule({c: v[a:b] for c, v in data.items()})]
        return pd.DataFrame(rows, columns=fields)

    return sorted_batches(df, keys, order, ruled, schema)


def sorted_batches(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """``rule`` over batches of whole groups: their rows in ``order``, and at which places the groups start.

    Groups are dealt by key and sorted by Spark, then read as one stream a task: a task holds a batch and the group that
    goes on behind it.
    """
    reachable(df.sparkSession)

    def run(batches):
        held = None

        def bounds(pdf):
            fresh = np.ones(len(pdf), bool)
            fresh[1:] = np.logical_or.reduce([(pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1]) for k in keys])
            return np.flatnonzero(fresh)

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            starts = bounds(pdf)
            held, done = pdf.iloc[starts[-1] :], pdf.iloc[: starts[-1]]
            if len(done):
                yield rule(done, starts[:-1])
        if held is not None:
            yield rule(held, np.array([0]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, _shape(schema))


def _shape(schema) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted table with their place in it, from 1; no task has to see more than its part of the table.

    Places inside the sorted partitions come first, then what lies before each partition is added: one row a partition.
    """
    rows = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(parts, "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_at", "_before")
