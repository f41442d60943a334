"""Recorded spans."""

import random

import numpy as np
import pytest

from plumbline.operators import telemetry
from plumbline.operators.tracing import Recorder
from plumbline.sources import tables


def test_spans_nest_and_errors_go_on(spark, tmp_path):
    recorder = Recorder()
    with recorder.trace("run", pid="x") as trace:
        with recorder.span("step", n=1) as found:
            found["elements"] = 3
        with pytest.raises(ValueError), recorder.span("bad"):
            raise ValueError("no")
    with recorder.span("alone"):
        pass
    tables.write_spans(recorder.spans(spark), str(tmp_path / "log"))
    rows, rejected = tables.spans(spark, str(tmp_path / "log"))
    by_name = {r["name"]: r for r in rows.collect()}
    assert not rejected.count() and set(by_name) == {"run", "step", "bad", "alone"}
    run = by_name["run"]
    assert run.trace_id == trace and run.parent_span_id is None and run.attributes == {"pid": "x"}
    assert by_name["step"].parent_span_id == by_name["bad"].parent_span_id == run.span_id and by_name["step"].attributes == {"n": "1", "elements": "3"}
    assert by_name["bad"].status == "error" and by_name["bad"].attributes == {"error": "no", "error_type": "ValueError"}
    assert by_name["alone"].trace_id != trace and by_name["alone"].parent_span_id is None
    assert all(r.end_time >= r.start_time and abs(r.duration_ms - 1000 * (r.end_time - r.start_time)) < 1 for r in by_name.values())
    assert {r["name"]: r.parent_name for r in telemetry.span_tree(rows).collect()}["step"] == "run"


def test_a_trace_is_one_stretch_of_one_file(spark, tmp_path):
    rows = [(f"t{i % 7}", f"s{i:02}", None, "n", float(50 - i), 60.0, 1.0, "ok", {}) for i in range(50)]
    tables.write_spans(spark.createDataFrame(rows, tables.S.SPAN), str(tmp_path / "log"))
    files = [spark.read.json(str(f)).select("trace_id", "start_time").collect() for f in (tmp_path / "log").glob("part-*")]
    assert sorted(t for f in files for t in {r.trace_id for r in f}) == [f"t{i}" for i in range(7)]
    assert all(f == sorted(f) for f in files)


def test_sessions_newest_first(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1), ("e", None)], "session_id string, created_at int")
    assert [r.session_id for r in tables.newest_first(rows).collect()] == ["c", "a", "b", "d", "e"]


def test_percentiles_are_exact(spark):
    """Ties, a name with most of the rows, names of one span, null durations and a null name."""
    r = random.Random(2)
    rows = [("hot", r.choice([r.random() * 100, float(r.randrange(4))])) for _ in range(3000)] + [("one", 7.5), (None, 1.0), (None, 4.0), ("void", None), ("some", None), ("some", 2.0)]
    df = spark.createDataFrame(rows, "name string, duration_ms double").repartition(7)
    got = {x["name"]: x for x in telemetry.latency(df).collect()}
    assert set(got) == {"hot", "one", None, "void", "some"}
    for name, x in got.items():
        mine = [d for n, d in rows if n == name]
        known = [d for d in mine if d is not None]
        want = [*np.percentile(known, [50, 95, 99]), max(known), np.mean(known)] if known else [None] * 5
        assert x.n == len(mine) and [x.p50_ms, x.p95_ms, x.p99_ms, x.max_ms, x.mean_ms] == [None if w is None else pytest.approx(w, abs=6e-4) for w in want]
    assert telemetry.latency(df.limit(0)).count() == 0
