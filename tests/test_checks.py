"""Queries that SQL can't express, against plain Python over the same rows."""

import collections
import difflib
import math
import random
import zlib

import duckdb
import pytest

from plumbline.operators import ocr
from plumbline.plans import catalogue


@pytest.fixture(scope="module")
def table(sf_dir):
    con = duckdb.connect()
    return lambda sql: con.execute(sql.replace("@", f"'{sf_dir}/").replace("#", ".parquet'")).fetchall()


def plain_stacks(boxes):
    """By the definition: links from each box down to its first box too far below, then what links join."""
    near = {i: {i} for i in range(len(boxes))}
    ranked = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    for n, i in enumerate(ranked):
        height = boxes[i][3] - boxes[i][1]
        gaps = [(j, boxes[j][1] - boxes[i][3], max(height, boxes[j][3] - boxes[j][1])) for j in ranked[n + 1 :]]
        cut = next((k for k, (_, gap, tall) in enumerate(gaps) if gap > 0.9 * tall), len(gaps))
        for j, gap, tall in gaps[:cut]:
            narrow = min(boxes[i][2] - boxes[i][0], boxes[j][2] - boxes[j][0])
            if gap >= -0.5 * tall and narrow > 0 and min(boxes[i][2], boxes[j][2]) - max(boxes[i][0], boxes[j][0]) >= 0.4 * narrow:
                whole = near[i] | near[j]
                for k in whole:
                    near[k] = whole
    stacks = {frozenset(x) for x in near.values()}
    listed = [[i for i in ranked if i in s] for s in stacks]
    return sorted(listed, key=lambda s: (min(boxes[i][1] for i in s), min(boxes[i][0] for i in s), min(s)))


def test_stacks_equal_the_definition():
    r = random.Random(4)
    for n in [0, 1, 2, 5, 30, 80] * 12:
        boxes = []
        for _ in range(n):
            x, y = r.choice([0, 5, 20, 40]) + r.randint(0, 3), r.randint(0, 60)
            boxes.append((x, y, x + r.choice([0, 4, 9, 30]), y + r.choice([1, 3, 8, 20])))
        assert ocr.stack_order(boxes) == plain_stacks(boxes)


def test_ocr_clusters(spark, sf_dir):
    from plumbline.plans import pieces

    lines = ocr.lines(pieces.words(spark, sf_dir)).collect()
    pages = collections.defaultdict(list)
    for x in sorted(lines, key=lambda x: (x.block_num, x.par_num, x.line_num)):
        pages[x.pid, x.page].append((x.x0, x.y0, x.x1, x.y1))
    want = collections.Counter((pid, b, len(s)) for (pid, _), boxes in pages.items() for b, s in enumerate(plain_stacks(boxes)))
    assert collections.Counter(map(tuple, catalogue.queries()["ocr_clusters"](spark, sf_dir).select("pid", "block", "n_lines").collect())) == want


def test_fuzzy_match(spark, sf_dir, table):
    swap = str.maketrans("aeiou", "eioua")
    want = {}
    for key, name in table("select p_partkey, p_name from @part#"):
        other = name.translate(swap)
        ratio = difflib.SequenceMatcher(None, name.lower(), other.lower()).ratio()
        want[key] = (pytest.approx(ratio), name.strip() == other.strip() or ratio >= 0.85)
    assert {r.p_partkey: (r.ratio, r.matches) for r in catalogue.queries()["fuzzy_match"](spark, sf_dir).collect()} == want


def test_default_embeddings(spark, sf_dir, table):
    names = dict(table("select p_partkey, p_name from @part#"))
    for r in catalogue.queries()["default_embeddings"](spark, sf_dir).collect():
        grams = f" {' '.join(names[r.p_partkey].lower().split())} "
        want = [0.0] * 256
        for i in range(len(grams) - 2):
            h = zlib.crc32(grams[i : i + 3].encode())
            want[h % 256] += 1 if h >> 31 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1
        assert r.embedding == pytest.approx([x / size for x in want], abs=1e-6)


def test_ground_truth_quality(spark, sf_dir):
    """Each expected change is a change of the feed, so all are found, and what was left out is found in vain."""
    from plumbline.plans.changes import part_delta

    feed = part_delta(spark, sf_dir)[0].selectExpr("pair_id", "concat_ws('/', change_type, old_element_id, new_element_id) as id", "coalesce(new_text, old_text) as t").selectExpr("*", "pmod(xxhash64(id), 10) <> 0 as wanted").collect()
    for r in catalogue.queries()["ground_truth_quality"](spark, sf_dir).collect():
        mine = [x for x in feed if x.pair_id == r.pair_id]
        tp, fp = sum(x.wanted for x in mine), sum(not x.wanted for x in mine)
        precision = tp / (tp + fp)
        assert (r.tp, r.fp, r.fn, r.recall) == (tp, fp, 0, 1.0)
        assert (r.precision, r.f1) == (pytest.approx(round(precision, 4)), pytest.approx(round(2 * precision / (precision + 1), 4)))
        assert r.noise == sum(not x.wanted and x.t != "" and len(x.t.strip()) < 2 for x in mine)


def test_passages_by_hash_or_sent(spark, sf_dir):
    from pyspark.sql import functions as F

    from plumbline.operators import retrieval

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("passage"))
    pairs = lambda **kw: sorted(map(tuple, retrieval.holding(docs, passages, **kw).select("doc_id", "item_id").collect()))
    assert pairs() == pairs(sent_bytes=0) != []


def test_a_cluster_has_to_name_its_folder(monkeypatch):
    from plumbline import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
