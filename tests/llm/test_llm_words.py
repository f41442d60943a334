"""Words that fool polynomial hashes, and words without end."""

import hashlib
import random
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, packing, substring_dedup


def thue_morse(n, swapped=False):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", "ba")) if swapped else s


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(1)
    texts = [thue_morse(n, x) for n in (16, 1024, 2048) for x in (False, True)] + ["a" * 3000, " " * 5000 + "x", "=" * 2000, "the" * 900, ""]
    return texts + ["".join(r.choice("abcdeé漢") for _ in range(30000))] + ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 40))) for _ in range(200)]


def test_words_are_told_apart(spark, library, awkward):
    docs = spark.createDataFrame(list(enumerate(awkward)), "doc_id long, text string").coalesce(1)
    want = {}
    for i, t in enumerate(awkward):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()} == want
    totals = {r.doc_id: r.n for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert totals == {i: n + 1 for i, (n, _, _) in want.items()}


@pytest.mark.parametrize("n", [1024, 2048])
def test_passages_of_such_words(spark, n):
    words = lambda x: " ".join(f"{thue_morse(n, x)}" if i % 2 else f"{thue_morse(64, x)}{i}" for i in range(13))
    docs = spark.createDataFrame([(1, words(False)), (2, words(True)), (3, words(False))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs, digest=True).collect()} == {1: 0, 2: 0, 3: 13}


def test_a_word_without_end(library):
    machine, r = bpe.automaton(bpe.default_vocabulary()), random.Random(2)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    began = time.time()
    ids, _ = machine.encode_texts(pa.array([word]))
    assert time.time() - began < 20 and ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_groups_read_in_slices(spark, monkeypatch):
    """Long documents are groups of their own; a slice may end anywhere in a group."""
    monkeypatch.setattr(substring_dedup, "LONG_TEXT", 300)
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"d{i}w{r.randrange(9999)}" for _ in range(r.choice((5, 60)))) + " " + passage * (i % 3 > 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {x.doc_id: x.n_removed for x in substring_dedup.dedup_substrings(docs, digest=True).collect()}
    assert found == {i: 0 if i < 2 or not i % 3 else 40 for i, _ in rows}


def test_doubling_reads_survivors_only(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{passage} a"), (2, f"b {passage}"), (2, f"b {passage}"), (3, None), (None, passage), (4, "")], "doc_id long, text string")
    assert [(r.length, r.n_windows) for r in substring_dedup.repeated_lengths(df).collect()] == [(13, 48), (26, 35), (52, 9), (104, 0)]
    assert [(r.length, r.n_windows) for r in substring_dedup.repeated_lengths(df.limit(0)).collect()] == [(13, 0)]
