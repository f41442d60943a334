"""Files in and out."""

import json

from pyspark.sql import functions as F

from plumbline import schemas as S
from plumbline.operators import evaluation
from plumbline.sources import registry, tables


def drawing(pid, n):
    box = {"page": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "page_width": 2.0, "page_height": 0.0, "unit": "pdf_points"}
    return {"pid": pid, "format": "pdf_native", "revision_label": None, "page_count": 1, "raw_source_path": "x.pdf", "elements": [{"id": f"{pid}:pdf_native:{i:05d}", "type": "tag", "text": f"26-KA-{100 + i}", "bbox": box, "attributes": {"layer": "L"}, "source_adapter": "pdf_native", "extraction_confidence": 1.0} for i in range(n)]}


def test_canonical_round_trip(spark, tmp_path):
    for pid, n in (("one", 3), ("two", 1)):
        (tmp_path / f"{pid}.json").write_text(json.dumps(drawing(pid, n), indent=1))
    docs, elements = tables.canonical(spark, str(tmp_path / "*.json"))
    assert {r.pid: r.n_elements for r in docs.collect()} == {"one": 3, "two": 1} and elements.count() == 4
    assert S.valid_elements(elements).count() == 4
    tables.write_canonical(docs.drop("n_elements"), elements, str(tmp_path / "out"))
    again = spark.read.schema(S.DOCUMENT_JSON).json(str(tmp_path / "out"))
    assert {(r.pid, tuple(e.id for e in r.elements), r.elements[0].attributes["layer"]) for r in again.collect()} == {("one", tuple(f"one:pdf_native:{i:05d}" for i in range(3)), "L"), ("two", ("two:pdf_native:00000",), "L")}
    assert registry.load(spark, "canonical", str(tmp_path / "*.json")).count() == 4


def test_invalid_rows_are_named(spark, tmp_path):
    one = drawing("one", 2)
    one["elements"][0]["bbox"] = {**one["elements"][0]["bbox"], "x1": -1.0}
    one["elements"][1] |= {"type": "thing", "extraction_confidence": 1.5}
    (tmp_path / "one.json").write_text(json.dumps(one))
    rows = tables.canonical(spark, str(tmp_path))[1].select("seq", S.element_problems().alias("p")).collect()
    assert {r.seq: r.p for r in rows} == {0: ["bbox"], 1: ["type", "confidence"]}


def test_manifests_and_truth(spark, tmp_path):
    ref = lambda p: {"path": p, "pid": p, "format": "dwg", "revision_label": None}
    (tmp_path / "m.json").write_text(json.dumps({"pair_id": "p", "doc_a": ref("a"), "doc_b": ref("b")}))
    assert {(r.side, r.path) for r in tables.manifests(spark, str(tmp_path / "m.json")).collect()} == {("a", "a"), ("b", "b")}
    (tmp_path / "g.json").write_text(json.dumps({"pair_id": "p", "negative_control": False, "expected_deltas": [{"gt_id": "g1", "change_type": "added", "element_type": "tag", "new_text": "x", "locator": {"page": 0, "bbox": [0, 0, 1, 1]}}]}))
    pairs, expected = tables.ground_truth(spark, str(tmp_path / "g.json"))
    assert not pairs.first().negative_control and expected.first().locator.bbox == [0, 0, 1, 1] and expected.first().old_text is None


def test_scorecards_and_agreement(spark, tmp_path):
    card = lambda v, w: spark.createDataFrame([("f1", v, True), ("over-refusal", w, False)], tables.SCORECARD)
    tables.write_scorecard(card(0.5, 0.2), str(tmp_path / "old"))
    old = tables.scorecard(spark, str(tmp_path / "old"))
    assert not evaluation.regressed(evaluation.scorecard_diff(old, card(0.6, 0.2))) and evaluation.regressed(evaluation.scorecard_diff(old, card(0.6, 0.3)))
    scores = "qa_id string, correctness int, groundedness int"
    judged = spark.createDataFrame([("q1", 4, 5), ("q2", None, None), ("q3", 1, 1)], scores)
    people = spark.createDataFrame([("q1", 5, 5), ("q2", 3, 3), ("q3", 1, 1)], scores)
    asked = spark.createDataFrame([("q1", True), ("q2", True), ("q3", False)], "qa_id string, held_out boolean")
    r = evaluation.agreement(evaluation.judged_rows(judged, people, asked)).first()
    assert (r.n, r.exact_correctness, r.mean_abs_diff_correctness, r.exact_groundedness) == (1, 0.0, 1.0, 1.0)
    assert evaluation.agreement(evaluation.judged_rows(judged.limit(0), people, asked)).first().exact_correctness is None


def test_uploads_are_capped(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"x" * 10)
    (tmp_path / "large").write_bytes(b"x" * 100)
    assert [r.length for r in tables.uploads(spark, str(tmp_path), 50).select("length").collect()] == [10]


def test_copies_have_pages_and_ids_of_their_own(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(drawing("one", 3)))
    rows = tables.page_copies(tables.canonical(spark, str(tmp_path))[1], 4)
    r = rows.agg(F.count_distinct("id").alias("ids"), F.count_distinct("bbox.page").alias("pages")).first()
    assert (r.ids, r.pages) == (12, 4)
