"""Terms beside a value count however long the words next to it are, and beside each of values that overlap."""

from plumbline.llm import pii


def test_terms_beyond_a_long_word(spark):
    rows = [(i, f"plain text number {i} of many others") for i in range(60)]
    rows += [(100 + i, f"one Zanzibarine {'x' * 300}{i} jo.doe@example.org {'y' * 250}{i} Quillfeather end") for i in range(3)]
    found = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for i, text in rows[60:]:
        terms = [text[t.start : t.end] for t in found[i].terms]
        assert "Zanzibarine" in terms and "Quillfeather" in terms


def test_terms_beside_values_that_overlap(spark):
    """The address in a mail address, and one that a mail address begins in: words on both sides are beside either of them."""
    text = "far one two Zanzibarine jo@10.0.0.7 Quillfeather three four off"
    row = spark.createDataFrame([(1, text), (2, "ann@10.0.0.7.x@y.org, next"), (3, "nothing")], "row long, body string")
    found = {r.row: r.beside for r in pii._located(row.selectExpr("row", "body", "struct(0 as nothing) as kept")).collect()}
    beside = {}
    for b in found[1]:
        assert text[b.start : b.end].lower() == b.term
        beside.setdefault(b.entity, []).append(b.term)
    assert beside == dict.fromkeys(["email:jo@10.0.0.7", "ip:10.0.0.7"], ["one", "two", "zanzibarine", "quillfeather", "three", "four"])
    assert {b.entity for b in found[2] if b.term == "next"} == {b.entity for b in found[2]} and found[3] == []

    rows = [(i, f"plain text number {i} of many others") for i in range(60)]
    rows += [(100 + i, f"note {i} Zanzibarine jo@10.0.0.7 Quillfeather end {i}") for i in range(3)]
    rows += [(200 + i, f"host {i} 10.0.0.7 up {i}") for i in range(9)]
    terms = {r.doc_id: r.terms for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    for i, text in rows[60:63]:
        assert {"Zanzibarine", "Quillfeather"} <= {text[t.start : t.end] for t in terms[i]}
