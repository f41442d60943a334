"""Sorted groups are whole, also where a batch ends inside one."""

import random
import time

import numpy as np
import pytest

from plumbline.operators import ocr
from plumbline.operators.groups import numbered, sorted_groups


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_groups_are_whole(spark, batch):
    rows = [(f"k{i % 7}", i) for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "k string, v long")
    got = sorted_groups(df, ["k"], ["v"], lambda g: [(g["k"][0], len(g["v"]), g["v"] == sorted(g["v"]))], "k string, n long, sorted boolean").collect()
    none = sorted_groups(df.limit(0), ["k"], ["v"], lambda g: [(g["k"][0], 1, True)], "k string, n long, sorted boolean").count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.k, r.n, r.sorted) for r in got} == {(f"k{i}", len(range(i, 60, 7)), True) for i in range(7)} and none == 0


def test_places_in_a_sorted_table(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("pmod(id * 7919, 5003) as k")
    got = numbered(rows.orderBy("k")).collect()
    assert sorted((r.place, r.k) for r in got) == list(enumerate(sorted(r.k for r in rows.collect()), 1))
    assert numbered(rows.limit(0).orderBy("k")).count() == 0


def test_pages_are_stacked_many_at_once():
    """Each page's stacks are those of the page by itself; 20,000 pages take no call each."""
    r = random.Random(6)
    pages = []
    for _ in range(20_000):
        at = [(r.choice([0, 5, 40]), r.randint(0, 40)) for _ in range(r.choice([1, 2, 3, 5]))]
        pages.append([(x, y, x + r.choice([0, 4, 9]), y + r.choice([1, 3, 8])) for x, y in at])
    starts = np.cumsum([0, *map(len, pages[:-1])])
    began = time.time()
    block, line = ocr._stacked(np.array([b for p in pages for b in p], float).T, starts)
    assert time.time() - began < 5
    for at, boxes in list(zip(starts, pages, strict=True))[::40]:
        assert {i: (b, n) for b, s in enumerate(ocr.stack_order(boxes)) for n, i in enumerate(s)} == {i: (block[at + i], line[at + i]) for i in range(len(boxes))}
