"""The pipeline's stages, each on what the one before it left."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import pii, quality, simhash, substring_dedup


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    assert all(after.columns == P.COLUMNS for _, _, after in stages[:-1])


def test_decisions_take_effect(stages):
    _, docs, kept = stages[0]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.measure(docs).filter("kept").collect()}
    _, docs, kept = stages[1]
    groups = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in groups.items() if i == c}
    _, docs, cut = stages[2]
    texts = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == texts
    _, docs, masked = stages[3]
    assert masked.count() == docs.count()
    left = masked.select(F.size(pii.find_values(F.col("text"))).alias("n")).filter("n > 0").count()
    assert left == 0
    _, docs, pieces = stages[4]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert all(r.n_chars == len(r.text) for r in masked.collect())


LINE = "Some words that make a line of more than ten words, to be kept whole. "


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated rows, columns named like results."""
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(4000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, LINE, None, "s", None), (3, LINE, None, "s", None), (4, long, "en", "s", 1), (5, LINE + "mail a.b@x.org now.", "en", "s", 1), (6, LINE, "de", "s", 1), (None, LINE, "en", "s", 2), (2**40, long + " end.", "en", None, 3)]
    names = ["row", "base", "terms", "kept", "fp", "node", "grp", "key", "component_id", "n_words", "n_removed", "token_ids", "sequence_id", "unfilled", "is_doc"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(n).alias(n) for n in names]).repartition(3)


@pytest.mark.parametrize(("name", "ids"), [("quality_rules", [None, 3, 3, 4, 5, 6, 2**40]), ("near_duplicates", [1, 3, 3, 4, 5]), ("repeated_passages", [None, None, 1, 2, 3, 3, 4, 5, 6, 2**40]), ("personal_data", [None, None, 1, 2, 3, 3, 4, 5, 6, 2**40]), ("packing", [None, None, 1, 2, 3, 3, 4, 5, 6, 2**40])])
def test_awkward_tables(spark, sf_dir, awkward, name, ids):
    stage = dict(P.STAGES)[name]
    found = stage(spark, awkward, sf_dir)
    got = [r.doc_id for r in (found.filter("start = 0") if name == "packing" else found).collect()]
    assert sorted(got, key=lambda i: -1 if i is None else i) == ids
    assert stage(spark, awkward.limit(0), sf_dir).count() == 0
    if name != "packing":
        assert found.columns == P.COLUMNS
        texts = {r.doc_id: r.text for r in found.collect()}
        assert texts[4].startswith("w0x0 w0x1") and texts[3] == LINE
    if name == "personal_data":
        assert texts[5].endswith("mail [EMAIL] now.")
    if name == "repeated_passages":
        assert texts[6].strip() == "" and texts[1] is None
