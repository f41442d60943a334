"""The report of a pair leaves no change out."""

import json

from plumbline.operators import report as R


def test_report_has_all_changes(spark, tmp_path):
    box = "struct<page:int>"
    shape = f"pair_id string, change_type string, element_type string, old_element_id string, new_element_id string, old_text string, new_text string, confidence double, old_bbox {box}, new_bbox {box}"
    added = [("p", "added", "tag", None, f"n{i:05}", None, f"a|{i}", 1.0, None, (0,)) for i in range(2100)]
    removed = [("p", "removed", "tag", f"o{i}", None, f"<{i}>", None, 1.0, (0,), None) for i in range(5)]
    deltas = spark.createDataFrame([*removed, *added, ("q", "added", "tag", None, "x", None, "x", 1.0, None, (0,))], shape)
    stats = spark.createDataFrame([("p", 2105)], "pair_id string, n long")
    texts = R.report(deltas, stats, "p", folder=str(tmp_path / "out"))
    lines = {k: "".join(f.read_text() for f in sorted((tmp_path / "out" / k).glob("part-*"))).splitlines() for k in texts}
    assert [json.loads(x)["new_element_id"] or json.loads(x)["old_element_id"] for x in lines["json"]] == [r[4] or r[3] for r in [*added, *removed]]
    assert len(lines["md"]) == len(lines["html"]) == 2105
    assert lines["md"][0] == "| added | tag | — | a\\|0 | 1.0 |" and "&lt;4&gt;" in lines["html"][-1]
    assert all("2000 of 2105 changes are listed here" in t for t in texts.values())
    assert len(json.loads(texts["json"])["deltas"]) == 2000


def feed(spark, rows):
    box = "struct<page:int>"
    return spark.createDataFrame(rows, f"pair_id string, change_type string, element_type string, old_element_id string, new_element_id string, old_text string, new_text string, confidence double, old_bbox {box}, new_bbox {box}")


def test_written_report_is_whole(spark, tmp_path):
    rows = [("p", "added", "tag", None, f"n{i:04}", None, f"a|{i}", 1.0, None, (i % 3,)) for i in range(300)]
    rows += [("p", "removed", "note", f"o{i}", None, f"<{i}>", None, 1.0, (0,), None) for i in range(5)]
    rows += [("p", "modified", "tag", "o9", "m9", "x", "y", 0.5, (7,), (7,)), ("q", "added", "tag", None, "x", None, "other pair", 1.0, None, (0,))]
    stats = spark.createDataFrame([("p", 306, [("low", "Only 3 % & fewer")])], "pair_id string, matched long, warnings array<struct<kind:string,message:string>>")
    docs = spark.createDataFrame([("p", "a", "P<A>", "dwg", None, 3, 9), ("p", "b", "PB", "dwg", "C", 3, 8)], "pair_id string, side string, pid string, format string, revision_label string, page_count int, n_elements int")
    paths = R.write_report(feed(spark, rows), stats, "p", str(tmp_path / "out"), docs)
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["report.html", "report.json", "report.md"]
    text = {k: open(v, encoding="utf-8").read() for k, v in paths.items()}
    told = json.loads(text["json"])
    assert [d["new_element_id"] or d["old_element_id"] for d in told["deltas"]] == [f"n{i:04}" for i in range(300)] + ["m9"] + [f"o{i}" for i in range(5)]
    assert told["counts"] == {"added": 300, "modified": 1, "removed": 5} and told["documents"][0] == "P<A> (dwg, (no revision label)): 3 pages, 9 elements"
    md = text["md"].splitlines()
    assert [x for x in md if x.startswith("#")] == ["# Changes of p", "## Summary", "## Added (300)", "## Modified (1)", "## Removed (5)"]
    assert md.index("## Modified (1)") > md.index("| added | tag | — | a\\|299 | 1.0 |") and "> **Warning:** Only 3 % & fewer" in md
    page = text["html"]
    assert page.count("<h2>") == 5 and "other pair" not in page and "P&lt;A&gt; (dwg" in page and 'role="alert">Only 3 % &amp; fewer' in page
    # the one-letter change is in the tables, not in the charts
    assert "<b>Page 7</b>" not in page and "1 changes of very short texts" in page and "<td>y</td>" in page and 'title="Added: 300"' in page
    assert page.count("<table>") == page.count("</table>")


def test_report_of_nothing(spark, tmp_path):
    stats = spark.createDataFrame([], "pair_id string, matched long")
    paths = R.write_report(feed(spark, []), stats, "p", str(tmp_path / "out"))
    told = json.loads(open(paths["json"], encoding="utf-8").read())
    assert told["deltas"] == [] and told["stats"] == {} and set(told["counts"].values()) == {0}
