"""Terms count wherever they stand in a text, not beside its values only."""

import collections
import math
import random
import re

import pytest

import corpus_pipeline
from plumbline.llm import pii
from tests.llm.test_llm_pii_terms import EDGE, plain_terms, plain_values

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pii_words(text):
    return list(re.finditer(pii.WORD_PATTERN, text))


def far_rows():
    """Zanzibarine stands far from the one value of its texts, Ostrow far from it and past another value; copies have both."""
    rows = [(i, f"plain text number {i} of many others {'and on ' * (i % 4)}") for i in range(60)]
    rows += [(100 + i, f"{w} Zanzibarine {w} so they wrote to us quite soon at jo@x.org, or 10.{i}.{i}.7 for what more was said by {w} Ostrow {w}.") for i, w in enumerate(("one", "two", "ten"))]
    return rows + [(200 + i, "the copy Quillfeather of it is told in many words at ann@y.org now") for i in range(3)]


@pytest.mark.parametrize("stage", ["op6_pii", "personal_data"])
def test_terms_far_from_their_value(spark, tmp_path, stage):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in far_rows()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(far_rows())
    if stage == "personal_data":
        said = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, str(tmp_path)).collect()}
        assert all("Zanzibarine" not in said[i] and "Ostrow" not in said[i] for i in (100, 101, 102))
        assert all("Quillfeather" in said[i] for i in (200, 201, 202)) and said[7] == texts[7]
    else:
        for r in pii.op6_pii(spark, str(tmp_path)).collect():
            terms = {texts[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
            assert {"Zanzibarine", "Ostrow"} <= terms if 100 <= r.doc_id < 200 else not terms


def plain_anywhere(texts):
    """(term, start, end, neighbours) of each text; and of each term: the text and value pairs that it gives away."""

    def words(text):
        out, at = [], 0
        for a, b in [(a, b) for a, b, _, _ in plain_values(text)] + [(len(text), len(text))]:
            gap = [(at + m.start(), m[0]) for m in pii_words(text[at:a])] if a > at else []
            for i, (p, w) in enumerate(gap):
                bare = EDGE.sub("", w)
                if len(bare) >= pii.LEAST_TERM:
                    near = " ".join(x for _, x in gap[max(i - pii.BESIDE, 0) : i + pii.BESIDE + 1])
                    out.append((bare.lower(), p + w.index(bare), p + w.index(bare) + len(bare), near))
            at = max(at, b)
        return out

    total, all_words = len(texts), [words(t) for t in texts]
    held = collections.Counter(w for t in texts for w in {EDGE.sub("", m[0]).lower() for m in pii_words(t)})
    rows = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for _, _, k, v in plain_values(t):
            rows[f"{k}:{v.lower()}"].add(i)
    found = collections.defaultdict(set)
    for e, at in rows.items():
        joint = collections.defaultdict(set)
        for i in at:
            for w, _, _, _ in all_words[i]:
                joint[w].add(i)
        for w, both in joint.items():
            share = math.log2(total * len(both) / (held[w] * len(at))) / math.log2(total / len(at)) if held[w] else 0
            if len(both) > 1 and round(share, 9) >= pii.GENERALISE:
                found[w] |= {(i, e) for i in both}
    return all_words, found


def test_terms_anywhere_against_plain_python(spark):
    """What plain Python finds over whole texts, all places of it; and all that stands beside values."""
    r = random.Random(5)
    common = "the a of and some more text here with words that are plain".split()
    texts = [" ".join(r.choice(common) for _ in range(r.randint(5, 30))) for _ in range(150)]
    for i in range(40):
        w, k = texts[i].split(), r.randrange(8)
        w.insert(r.randint(0, len(w)), f"user{k}@mail.org")
        for _ in range(r.randint(0, 2)):
            w.insert(r.randint(0, len(w)), f"Name{k if r.random() < 0.9 else 9}x,")
        texts[i] = " ".join(w)
    got = {x.doc_id: {(s.start, s.end) for s in x.terms} for x in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), "doc_id", anywhere=True).collect()}
    all_words, found = plain_anywhere(texts)
    far = {i: {(a, b) for w, a, b, _ in all_words[i] if any(i == j for j, _ in found.get(w, ()))} for i in range(len(texts))}
    near = plain_terms(texts)
    revealed = {(i, texts[i][a:b].lower()) for i, x in enumerate(near) for a, b, _ in x}
    assert sum(map(len, far.values())) > 20
    for i in range(len(texts)):
        beside = {(a, b) for a, b, _ in near[i]}
        assert far[i] | beside <= got[i]
        assert all(p in far[i] or any(t == texts[i][p[0] : p[1]].lower() for _, t in revealed) for p in got[i])
