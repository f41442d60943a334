"""Main text against labelled pages that the classifier hasn't seen, and what the cut changes."""

import itertools
import time

import pytest

from plumbline.llm import html_extract as H
from plumbline.llm import page_samples


@pytest.fixture(scope="module")
def held_out():
    out = []
    for page, labels in page_samples.samples(150, seed=9):
        out.append((page, [(labels[t], score, stays) for t, score, stays in H.labelled(page) if t in labels]))
    return out


def test_accuracy_on_held_out_pages(held_out):
    rows = [x for _, found in held_out for x in found]
    right = lambda stays: sum(label and s for label, s in stays)
    cut, alone = [(l, s) for l, _, s in rows], [(l, x > 0) for l, x, _ in rows]
    precision, recall = (right(cut) / max(1, n) for n in (sum(s for _, s in cut), sum(l for l, _ in cut)))
    changed = sum(a != b for a, b in zip(cut, alone, strict=True))
    print(f"blocks {len(rows)}, precision {precision:.3f}, recall {recall:.3f}, changed by the cut {changed}")
    assert precision >= 0.97 and recall >= 0.99 and changed > 0
    assert sum(l != s for l, s in cut) <= sum(l != s for l, s in alone)


def test_the_cut_decides(held_out):
    """On pages of up to 14 blocks the text is that of the cheapest of all labellings."""
    weights, seen = H.fitted(), 0
    for page, _ in held_out:
        blocks = H.blocks_of(page)
        if len(blocks) > 14:
            continue
        scores, edges = H.scores_of(blocks, weights), H.edges_of(blocks)
        cost = lambda on: sum(abs(x) for x, l in zip(scores, on, strict=True) if (x > 0) != l) + sum(w for a, b, w in edges if on[a] != on[b])  # noqa: B023, E731
        best = min(itertools.product((False, True), repeat=len(blocks)), key=cost)
        assert H.main_text(page) == "\n\n".join(b.text for b, l in zip(blocks, best, strict=True) if l)
        seen += 1
    assert seen >= 5


def test_nothing_of_an_article_is_dropped():
    inside = "Energy is <math><mi>E</mi></math> here, <button>press</button> <svg><text>drawn</text></svg> <canvas>seen</canvas> <x-note>noted</x-note> and <object>held</object>."
    assert H.main_text(f"<nav><a href=/>Home</a></nav><article><p>{inside}<script>no()</script></p></article>") == "Energy is E here, press drawn seen noted and held."


def test_pages_without_landmarks():
    body = "<div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div><div><h1>A head line here</h1><p>This is a long sentence that says a number of things in words.</p><p>Short one.</p><p>And again a sentence that has a good number of words in it.</p></div><div><p>Copyright 2020 by us. All rights reserved.</p></div>"
    assert H.main_text(body) == "A head line here\n\nThis is a long sentence that says a number of things in words.\n\nShort one.\n\nAnd again a sentence that has a good number of words in it."


def test_long_and_repeated_pages(spark):
    one = "<p>This is a sentence that stands in a very long article, {}.</p>"
    page = "<nav><a href=/>Home</a></nav><article>" + "".join(one.format(i) for i in range(20_000)) + "</article>"
    began = time.time()
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, "<" * 100_000), (3, "w", "<div>" * 5_000 + "Some words that stand here by themselves, deep down.")], "page_id long, url string, html string")
    found = H.extract_text(pages.selectExpr("*", "'x' as text", "1 as n_chars"))
    assert sorted((r.page_id, r.text.count("\n\n")) for r in found.collect() if r.page_id < 2) == [(1, 19_999)] * 2
    assert time.time() - began < 60 and H.extract_text(pages.limit(0)).count() == 0
