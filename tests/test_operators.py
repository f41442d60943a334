"""Alignment, classification, recognition and drawing rules on hand-made inputs."""

import math
import random
from difflib import SequenceMatcher
from functools import partial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import align, assign, delta, evaluation, ocr, retrieval
from plumbline.operators.classify import rules
from plumbline.sources import dxf, tables

BOX = "struct<page:int,x0:double,y0:double,x1:double,y1:double,page_width:double,page_height:double,unit:string>"
ROW = f"pair_id string, id string, type string, text string, bbox {BOX}, attributes map<string,string>, extraction_confidence double, embedding array<float>"


def el(id_, text, kind="tag", x=0.15, y=0.15, page=0, vector=None, conf=1.0, **attributes):
    return ("p", id_, kind, text, (page, x, y, x, y, 1.0, 1.0, "pdf_points"), attributes, conf, vector)


def run(spark, a, b):
    frames = [spark.createDataFrame(x, ROW) for x in (a, b)]
    matches = align.align(*frames)
    feed = delta.change_feed(matches, *frames)
    stats = delta.statistics(matches, feed, *frames)
    return {(m.a_id, m.b_id): m for m in matches.collect()}, feed.collect(), stats.collect()


def test_duplicate_tags_pair_with_the_nearest(spark):
    m, feed, _ = run(spark, [el("a1", "26-KA-901", x=0.1), el("a2", "26-KA-901", x=0.8)], [el("b1", "26-KA-901", x=0.81), el("b2", "26-KA-901", x=0.11)])
    assert set(m) == {("a1", "b2"), ("a2", "b1")} and not feed


def test_named_block_moves_unnamed_does_not(spark):
    drawn = dict(kind="geometry", layer="L", entity_type="INSERT")
    m, feed, _ = run(spark, [el("a1", "", block_name="B", **drawn), el("a2", "", x=0.5, layer="L", kind="geometry", entity_type="LINE")], [el("b1", "", x=0.2, y=0.2, block_name="B", **drawn), el("b2", "", x=0.6, layer="L", kind="geometry", entity_type="LINE")])
    assert set(m) == {("a1", "b1")} and m["a1", "b1"].bbox_distance == pytest.approx(0.0707, abs=1e-4)
    assert sorted(d.change_type for d in feed) == ["added", "modified", "removed"]


@pytest.mark.parametrize(("va", "vb", "x", "score"), [([1.0, 0.0], [0.1, 0.995], 0.154, 0.98), ([1.0, 0.0], [0.95, 0.3122], 0.25, 0.95 * 0.89), ([1.0, 0.0], [0.3, 0.9539], 0.25, None)])
def test_bands_of_the_last_tier(spark, va, vb, x, score):
    m, _, _ = run(spark, [el("a1", "19057", "text_block", vector=va)], [el("b1", "20500", "text_block", x=x, vector=vb)])
    assert (not m) if score is None else m["a1", "b1"].match_score == pytest.approx(score, abs=1e-3)


def test_short_text_needs_no_vector_in_place_and_never_pairs_away_from_it(spark):
    m, _, _ = run(spark, [el("a1", "*", "text_block"), el("a2", "*", "text_block", x=0.5)], [el("b1", "*", "text_block"), el("b2", "*", "text_block", x=0.55)])
    assert set(m) == {("a1", "b1")}


def test_pages_keep_apart(spark):
    _, feed, _ = run(spark, [el("a1", "26-KA-901", page=0), el("a2", "26-KA-901", page=1)], [el("b1", "26-KA-901", page=1)])
    assert [(d.change_type, d.old_element_id) for d in feed] == [("removed", "a1")]


def test_note_definitions_may_change(spark):
    note = dict(kind_="note")
    a = ("p", "a1", "note", "5. old words", (0, 0.1, 0.1, 0.1, 0.1, 1.0, 1.0, "pdf_points"), {"kind": "definition", "note_number": "5"}, 0.9, None)
    b = ("p", "b1", "note", "5. new words", (0, 0.9, 0.9, 0.9, 0.9, 1.0, 1.0, "pdf_points"), {"kind": "definition", "note_number": "5"}, 1.0, None)
    m, feed, stats = run(spark, [a], [b])
    assert m["a1", "b1"].tier == "exact_key" and feed[0].change_type == "modified" and feed[0].confidence == 0.9 and note
    assert stats[0].modified == 1 and stats[0].exact_key_rate == 1.0


def test_empty_revisions(spark):
    assert run(spark, [], [])[1:] == ([], [])
    _, feed, stats = run(spark, [el("a1", None, "text_block")], [])
    assert [d.change_type for d in feed] == ["removed"] and stats[0].total_b == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4), st.integers(0, 4), st.integers(0, 3)), max_size=25))
def test_mutual_best_is_greedy(spark, rows):
    rows = list({(g, a, b): (g, a, b, s / 3) for g, a, b, s in rows}.values())
    used, want = set(), set()
    for g, a, b, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b))
    df = spark.createDataFrame(rows, "g int, a_id int, b_id int, score double")
    rounds_only = partial(assign.mutual_best, rest=0)
    for form in (assign.mutual_best, rounds_only, assign.grouped, assign.one_to_one):
        assert {(r.g, r.a_id, r.b_id) for r in form(df, ["g"]).collect()} == want


def test_rest_is_taken_like_rounds(spark):
    """A chain of candidates, by distance with other ties, with columns that pandas would change."""
    n = 60
    rows = [("p", f"a{i:02}", f"b{j:02}", float(2 * i + (j - i)), None if i % 2 else 2**60 + i) for i in range(n) for j in (i, i + 1)]
    df = spark.createDataFrame(rows, "g string, a_id string, b_id string, d double, n long")
    forms = [assign.mutual_best(df, ["g"], score="d", ascending=True, ties=["b_id", "a_id"], rest=r).collect() for r in (100, 1000)]
    want = [("p", f"a{i:02}", f"b{i:02}", 2.0 * i, None if i % 2 else 2**60 + i) for i in range(n)]
    assert [sorted(map(tuple, f), key=lambda r: r[1]) for f in forms] == [want, want]


@pytest.mark.parametrize("n, m", [(90, 110), (60, 0)])
def test_crowded_keys_pair_with_the_nearest(spark, n, m):
    """Elements of one key, some at one place, some far out, beside a key that isn't crowded: nearest first over all pairs."""
    r = random.Random(n)
    spot = lambda: r.choice([(0.5, 0.5), (0.25, 0.75), (r.random(), r.random()), (round(r.random(), 2), 0.1), (r.random() * 4, 3.0)])
    sides = [[(f"{s}{i:03}", "26-KA-1" if i % 9 else "26-KA-2", *spot()) for i in range(k)] for s, k in (("a", n), ("b", m))]
    frames = [align.located(spark.createDataFrame([el(i, t, x=x, y=y) for i, t, x, y in s], ROW)) for s in sides]
    pairs = sorted((math.hypot(p[2] - q[2], p[3] - q[3]), p[0], q[0]) for p in sides[0] for q in sides[1] if p[1] == q[1])
    used, want = set(), set()
    for _, p, q in pairs:
        if not {p, q} & used:
            used |= {p, q}
            want.add((p, q))
    for crowded in (10, 2000, 10**6):
        assert {(x.a_id, x.b_id) for x in align.exact_key(*frames, crowded=crowded).collect()} == want


def test_results_do_not_depend_on_partitions(spark):
    r = random.Random(1)
    a = [el(f"a{i}", f"26-KA-{100 + r.randrange(30)}", x=r.random(), y=r.random()) for i in range(80)]
    b = [el(f"b{i}", f"26-KA-{100 + r.randrange(30)}", x=r.random(), y=r.random()) for i in range(80)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(set(run(spark, a, b)[0]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


CASES = [
    ('6"-VF-43-9029-AC21S-00', "line_number"), ("PIT-9062", "instrument_loop"), ("ZZZ-9062", "text_block"), ("26BL9072", "valve"), ("26-HA-911", "tag"), ("SP = 257 bar (g)", "setpoint"),
    ("HH: 245", "setpoint"), ("hh: 245", "text_block"), ('6" x 4"', "dimension"), ("NOTE 4, 7", "note"), ("12. some words", "note"), ("12.", "note"), ("LO", "text_block"), ("M", "text_block"), ("", "text_block"),
]


def test_both_readers_agree(spark):
    said = [c[0] for c in CASES] + ["PIT", "26B19072", "P1T-9062", "26-KA-9O1", "HOUSE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    for tolerant in (False, True):
        rows = {r.i: r.m for r in df.select("i", X.one_line(F.col("t"), tolerant).alias("m")).collect()}
        for i, t in enumerate(said):
            kind, text, attributes, _, _ = rules().read([t], tolerant)[0]
            assert (rows[i].type, rows[i].text, rows[i].attributes) == (kind, text, attributes), t
            if i < len(CASES) and not tolerant:
                assert kind == CASES[i][1], t


def test_reader_uses_up_lines():
    read = rules().read(["PIT", "9062", "26", "7.", "first", "PIT", "NOTES:", "LO", "PI", "26"])
    assert [(k, t) for k, t, *_ in read] == [("instrument_loop", "PIT-9062"), ("note", "7. first PIT"), ("text_block", "NOTES:"), ("text_block", "LO"), ("text_block", "PI"), ("text_block", "26")]


def test_stacks_stop_at_the_first_gap():
    assert ocr.stack_order([(0, 0, 10, 10), (1, 12, 9, 22), (0, 60, 10, 70)]) == [[0, 1], [2]]
    assert ocr.stack_order([]) == []


def test_scanned_page(spark):
    words = [("d", 0, i, t, c, 1, 1, n, x, y, 40, 12) for i, (t, c, n, x, y) in enumerate([("PIT", 90.0, 1, 100, 100), ("\\", 20.0, 1, 150, 100), ("9062", 80.0, 2, 100, 114), (" ", 90.0, 3, 0, 0), ("gone", -1.0, 4, 0, 0)])]
    from plumbline.schemas import OCR_WORD

    pages = spark.createDataFrame([("d", 0, 600.0, 800.0)], "pid string, page int, page_width double, page_height double")
    rows = ocr.scanned_elements(spark.createDataFrame(words, OCR_WORD), pages).collect()
    assert [(r.type, r.text) for r in rows] == [("instrument_loop", "PIT-9062")] and rows[0].extraction_confidence == pytest.approx(0.55) and rows[0].bbox.x0 == pytest.approx(24.0)


DRAWING = """0
SECTION
2
BLOCKS
0
BLOCK
2
VALVE
10
0.0
20
0.0
0
LINE
10
0.0
20
0.0
11
4.0
21
3.0
0
ENDBLK
0
ENDSEC
0
SECTION
2
ENTITIES
0
TEXT
8
TEXT
10
5.0
20
5.0
40
2.0
1
26BL9072
0
INSERT
8
PIPING
2
VALVE
10
10.0
20
10.0
0
DIMENSION
8
DIMS
1
<>
42
12.34
10
0.0
20
0.0
11
1.0
21
1.0
0
ENDSEC
0
EOF
"""


def test_drawing(spark, tmp_path):
    (tmp_path / "one.dxf").write_text(DRAWING)
    rows = dxf.load(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.type, r.text) for r in rows] == [("valve", "26BL9072"), ("geometry", "VALVE"), ("dimension", "12.3")]
    assert rows[1].attributes["block_name"] == "VALVE" and rows[0].id == "one:dwg:00000"
    assert (rows[1].bbox.x0, rows[1].bbox.x1) == (10.0, 14.0) and rows[1].bbox.page_width == 14.6 and rows[1].bbox.y1 - rows[1].bbox.y0 == 3.0


def test_trace_lines_are_read_one_by_one(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"name": "a", "duration_ms": 1.5, "status": "ok", "attributes": {"n": 3}}\n\nnot json\n{"name": "b", "duration_ms": 2.0, "status": "error", "attributes": {}}\n')
    good, bad = tables.spans(spark, str(tmp_path))
    assert {r.name for r in good.collect()} == {"a", "b"} and [r.value for r in bad.collect()] == ["not json"]
    assert tables.spans(spark, str(tmp_path / "none"))[0].count() == 0


def test_fuzzy_ratio_is_the_librarys(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("Same", "same"), ("", "x"), ("", ""), (None, None), (None, "x"), ("abcdefghij", "abcdefghix")]
    ratio = evaluation.similarity(spark)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ratio(F.col("a"), F.col("b")).alias("r"), evaluation.texts_match(ratio, F.col("a"), F.col("b")).alias("m")).collect()
    for r in rows:
        want = None if r.a is None or r.b is None else SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio()
        assert r.r == want
        assert r.m == ((r.a is None and r.b is None) if r.a is None or r.b is None else r.a == r.b or bool(r.a and r.b and want >= 0.85))


def test_no_predictions_and_none_expected_is_right(spark):
    r = spark.range(1).select(evaluation.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0)).alias("r")).first().r
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)


def test_answers_without_context_are_refused(spark):
    said = spark.createDataFrame([("q1", "yes [x1] [x9] [x1]"), ("q2", "sure [x1]"), ("q3", "NOT_GROUNDED:")], "query_id string, reply string")
    known = spark.createDataFrame([("q1", "x1"), ("q3", "x1")], "query_id string, id string")
    rows = {r.query_id: r for r in retrieval.answers(said, known).collect()}
    assert rows["q1"].cited == ["x1"] and rows["q1"].invalid == ["x9"] and not rows["q1"].refused
    assert rows["q2"].refused and rows["q3"].reason == X.NO_REASON


def test_stream_of_spans(spark, tmp_path):
    from plumbline.streaming import spans

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("".join(f'{{"name": "n{i % 2}", "start_time": {i * 60}, "duration_ms": {i}, "status": "ok"}}\n' for i in range(120)))
    q = spans.by_stage(spans.read(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["name"]: r["n"] for r in spark.table("stages").collect()} == {"n0": 60, "n1": 60}
