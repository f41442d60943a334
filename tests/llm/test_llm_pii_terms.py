"""Terms that reveal a value, against plain Python; texts full of values; clashing names."""

import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii
from tests.llm.test_llm_operators import PERSONAL, plain_spans

EDGE = re.compile(r"^[^\w]*|[^\w]*$")


def plain_values(text):
    found = [(m.start(), m.end(), k, m[0]) for k, p, ok in PERSONAL for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return sorted(found)


def plain_beside(text):
    """(entity, context, term, start, end)"""
    spans, out, cover = plain_values(text), [], 0
    for n, (a, b, kind, value) in enumerate(spans):
        after = spans[n + 1][0] if n + 1 < len(spans) else len(text)
        left = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text[cover:a])][-pii.BESIDE :] if cover <= a else []
        right = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text[b:after])][: pii.BESIDE] if b >= cover and after > b else []
        words = [(cover + m.start(), m[0]) for m in left] + [(b + m.start(), m[0]) for m in right]
        context = " ".join(w for _, w in words)
        for at, w in words:
            bare = EDGE.sub("", w)
            if len(bare) >= pii.LEAST_TERM:
                head = w.index(bare)
                out.append((f"{kind}:{value.lower()}", context, bare.lower(), at + head, at + head + len(bare)))
        cover = max(cover, b)
    return out


def plain_terms(texts):
    beside = [plain_beside(t) for t in texts]
    held, contexts, joint = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for t in texts:
        held.update({EDGE.sub("", w).lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)})
    entities = collections.Counter(e for t in texts for e in {f"{k}:{v.lower()}" for _, _, k, v in plain_values(t)})
    for row, found in enumerate(beside):
        for e, c, t, _, _ in found:
            contexts[e, t].add(c)
            joint[e, t].add(row)
    shares = {}
    for (e, t), seen in contexts.items():
        if len(seen) >= pii.LEAST_CONTEXTS:
            content = math.log2(len(texts) / entities[e])
            share = min(math.log2(len(texts) * len(joint[e, t]) / (held[t] * entities[e])) / content, 1.0) if content > 0 else 0.0
            if round(share, 9) >= pii.GENERALISE:
                shares[e, t] = round(share, 9)
    out = []
    for found in beside:
        best = {}
        for e, _, t, a, b in found:
            if (e, t) in shares:
                best[a, b] = max(best.get((a, b), 0), shares[e, t])
        out.append([(a, b, "removed" if s >= 1 else "generalised") for (a, b), s in sorted(best.items())])
    return out


def corpus():
    r = random.Random(11)
    values = ["jo.doe@example.org", "ann@x.io", "10.0.0.7", "4111 1111 1111 1111", "+49 (30) 1234-5678"]
    names = ["Quillfeather", "Zanzibarine,", "agent-77", "(Ostrow)", "blue42"]
    common = "the a of and some more text here with words that are plain".split()
    texts = []
    for i in range(160):
        w = [r.choice(common) for _ in range(r.randint(0, 14))]
        for _ in range(r.choice((0, 0, 1, 2))):
            k = r.randrange(5)
            at = r.randint(0, len(w))
            w[at:at] = [names[k], values[k]] if r.random() < 0.6 else [values[k], r.choice(common)]
        if r.random() < 0.1:
            w.insert(r.randint(0, len(w)), "x" * 300)
        texts.append(" ".join(w))
    return texts + ["", "Quillfeather alone", texts[3], texts[3]]


def test_terms_equal_brute_force(spark):
    texts = corpus()
    rows = pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), "doc_id").collect()
    want = plain_terms(texts)
    assert {"removed", "generalised"} <= {k for x in want for _, _, k in x}
    assert {r.doc_id: [(s.start, s.end, s.value) for s in r.terms] for r in rows} == dict(enumerate(want))


def test_removed_and_generalised(spark):
    texts = corpus()
    found = pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    said = {r.doc_id: r.t for r in found.select("doc_id", pii.sanitise(F.col("text")).alias("t")).collect()}
    for i, (t, terms) in enumerate(zip(texts, plain_terms(texts), strict=True)):
        spans = sorted([(a, b, f"[{k.upper()}]") for a, b, k, _ in plain_values(t)] + [(a, b, "" if v == "removed" else "[NUMBER]" if re.search("[0-9]", t[a:b]) else "[NAME]" if t[a].isupper() else "[WORD]") for a, b, v in terms])
        out, at = "", 0
        for a, b, word in spans:
            if a >= at:
                out += t[at:a] + word
            at = max(at, b)
        assert said[i] == out + t[at:]


@pytest.mark.parametrize("value", ["1.2.3.4 ", "jo@x.org, ", "a 1.2.3.4 long word here "])
def test_a_text_full_of_values(spark, value):
    text = value * 20_000
    began = time.time()
    row = pii.find_personal(spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string"), "doc_id", "text").select(F.size("base").alias("n"), "doc_id", F.length(pii.sanitise(F.col("text"))).alias("m")).filter("doc_id = 1").first()
    assert row.n == 20_000 and row.m < len(text) and time.time() - began < 60


def test_clashing_names(spark):
    names = ["row", "base", "terms", "beside", "kept", "body", "_", "entity", "term", "n", "start"]
    docs = spark.createDataFrame([(1, "mail a.b@x.org now"), (None, None)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    found = pii.find_personal(docs, *docs.columns)
    assert sorted(found.columns) == sorted(docs.columns) and pii.find_personal(docs).columns == ["base", "terms"]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[1].row == "row" and [s.kind for s in rows[1].base] == ["email"] and rows[None].terms == []
    assert plain_spans("mail a.b@x.org now", PERSONAL, False)[0] == ["email"]
