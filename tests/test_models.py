"""Injected models and the default embedder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import models
from plumbline.session import reachable


def test_default_embedder(spark):
    reachable(spark)
    texts = ["valve 26BL9072", "valve 26BL9073", "", None, "quite another thing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", models.embedding()(F.col("t")).alias("v")).collect()
    got = {r.i: np.array(r.v) for r in rows}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], models.hashed_ngrams([t or ""])[0])
    assert got[0] @ got[1] > got[0] @ got[4] and not got[2].any()


def test_reranking_and_reading(spark):
    df = spark.createDataFrame([("q", "aaa", bytearray(b"x")), ("q", "a", bytearray(b"")), ("r", None, bytearray(b"y"))], "q string, p string, b binary")
    score = models.reranking(lambda: lambda query, passages: [len(query) * len(p) for p in passages])
    read = models.reading(lambda: lambda image, hint: {b"x": hint}[image])
    nobody = models.reading(lambda: None)
    rows = df.select(score("q", "p").alias("s"), read("b", "q").alias("r"), nobody("b", "q").alias("n")).collect()
    assert [r.s for r in rows] == [3.0, 1.0, 0.0]
    assert [(r.r.reply, r.r.outcome) for r in rows] == [("q", "ok"), (None, "error"), (None, "error")] and {r.n.outcome for r in rows} == {"unavailable"}


def test_waits_stay_within_the_budget():
    slept = []

    def call(fails):
        if len(slept) < fails:
            raise RuntimeError("limit")
        return "done"

    assert models.patient(lambda: call(2), lambda e: None, 60, slept.append)() == "done" and slept == [16.0, 16.0]
    slept.clear()
    with pytest.raises(RuntimeError):
        models.patient(lambda: call(1), lambda e: 90.0, 60, slept.append)()
    assert slept == []
    with pytest.raises(RuntimeError):
        models.patient(lambda: call(9), lambda e: 40.0, 60, slept.append)()
    assert slept == [41.0]
