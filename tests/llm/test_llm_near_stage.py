"""Similar texts, the near-duplicate stage of the pipeline, against brute force over all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import simhash


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))}


def components(texts, linked):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def edited():
    """Groups of an original and copies of it with up to eight words changed, the original not always first."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = []
    for copies in (600, 60, 30):
        base = [word() for _ in range(300)]
        group = [" ".join(base)]
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(300), rng.randint(2, 8)):
                words[at] = word()
            group.append(" ".join(words))
        rng.shuffle(group)
        texts += group
    return dict(enumerate(texts + [" ".join(word() for _ in range(300)) for _ in range(40)]))


@pytest.fixture(scope="module")
def brute(edited):
    sets = {i: shingles(t) for i, t in edited.items()}
    return components(edited, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("bucket, group", [(2048, 512), (40, 24)])
def test_recall_and_no_false_link(spark, edited, brute, bucket, group):
    """However buckets and groups are cut."""
    docs = spark.createDataFrame(list(edited.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, bucket=bucket, group=group).collect()}
    gone = lambda groups: sum(i != c for i, c in groups.items())
    print(f"removed {gone(found)} of {gone(brute)}")
    assert all(brute[i] == brute[c] for i, c in found.items())
    assert gone(found) >= 0.98 * gone(brute)


@pytest.mark.parametrize("words, radius", [(1, 2), (2, 9), (16, 187)])
def test_bit_slices_count_bits(words, radius):
    r = np.random.default_rng(1)
    rows = r.integers(0, 256, (5, words * 8), dtype=np.uint8)[r.integers(0, 5, 300)]
    bits = np.unpackbits(rows, axis=1)
    for i in range(300):
        bits[i, r.integers(0, words * 64, int(r.integers(0, radius + 2)))] ^= 1
    rows = np.packbits(bits, axis=1)
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= radius
    assert (simhash.within(simhash.planes_of(rows), radius, rows)[:, :300] == near).all()
    i, j = np.triu_indices(300, 1)
    assert (simhash.within(simhash.planes_of(rows[i] ^ rows[j]), radius)[: len(i)] == near[i, j]).all()
    nodes = r.permutation(1000)[:300].astype(np.int64)
    pairs = np.stack((nodes[i], nodes[j]), axis=1)[near[i, j]]
    assert dict(simhash.link_bucket(rows, nodes, radius)) == dict(simhash._forest(pairs)) == dict(simhash._link_small(rows, nodes, np.array([0]), radius))


def test_awkward_tables(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (7, long), (7, long), (3, long.upper()), (5, None), (6, ""), (8, " \t "), (9, "one two"), (10, "One two"), (2**40, long + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as keys", "2 as node", "3 as text_id", "4 as component_id")
    found = simhash.similar_texts(docs)
    assert found.columns == ["doc_id", "component_id"]
    assert sorted(map(tuple, found.filter("doc_id is not null").collect())) == [(3, 3), (5, 5), (6, 5), (7, 3), (7, 3), (8, 5), (9, 9), (10, 9), (2**40, 3)]
    assert [r.component_id for r in found.filter("doc_id is null").collect()] == [3]
    assert simhash.similar_texts(docs.limit(0)).count() == 0
