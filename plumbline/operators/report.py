"""Report tables and sentences of a change feed; small results are rendered on the driver."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.schemas import CHANGES
from plumbline.session import reachable


def page() -> Column:
    return F.coalesce(F.col("new_bbox.page"), F.col("old_bbox.page"))


def shown_text() -> Column:
    return F.coalesce("new_text", "old_text")


def by_change(deltas: DataFrame) -> DataFrame:
    """pair_id, and a count for each of the three changes, zero where none."""
    return deltas.groupBy("pair_id").pivot("change_type", CHANGES).count().fillna(0, CHANGES)


def by_page(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn("page", page()).filter("page is not null").groupBy("pair_id", "page").pivot("change_type", CHANGES).count().fillna(0, CHANGES)


def by_element_type(deltas: DataFrame) -> DataFrame:
    counts = deltas.groupBy("pair_id", "element_type").pivot("change_type", CHANGES).count().fillna(0, CHANGES)
    return counts.withColumn("total", F.col("added") + F.col("removed") + F.col("modified"))


def worth_charting(deltas: DataFrame, least: int = 2) -> DataFrame:
    return deltas.filter(F.length(X.strip(F.coalesce(shown_text(), F.lit("")))) >= least)


def noise(deltas: DataFrame, least: int = 2) -> DataFrame:
    """Changes of very short texts; an empty text is none of them."""
    t = F.coalesce(shown_text(), F.lit(""))
    return deltas.filter((t != "") & (F.length(X.strip(t)) < least))


def text_bearing(deltas: DataFrame) -> DataFrame:
    return deltas.filter(~X.blank(F.col("old_text")) | ~X.blank(F.col("new_text")))


def sentence(pid_a: Column | None = None, pid_b: Column | None = None) -> Column:
    """A change in words; it names both documents (default: columns pid_a and pid_b)."""
    a, b = pid_a if pid_a is not None else F.col("pid_a"), pid_b if pid_b is not None else F.col("pid_b")
    old, new = F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))
    said = {
        "modified": ("CHANGED (%s) from %s to %s: '%s' -> '%s'", F.col("element_type"), a, b, old, new),
        "added": ("ADDED in %s, not present in %s (%s): '%s'", b, a, F.col("element_type"), new),
        "removed": ("REMOVED from %s, not present in %s (%s): '%s'", a, b, F.col("element_type"), old),
    }
    return F.coalesce(*[F.when(F.col("change_type") == kind, F.format_string(*words)) for kind, words in said.items()])


def label() -> Column:
    old, new = F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))
    head = F.concat(F.col("change_type"), F.lit(" "), F.col("element_type"), F.lit(": "))
    return F.concat(head, F.when(F.col("change_type") == "modified", F.concat(old, F.lit(" -> "), new)).when(F.col("change_type") == "added", new).otherwise(old))


def chunk_id() -> Column:
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    return F.concat_ws(":", F.lit("delta"), F.col("change_type"), part("old_element_id"), part("new_element_id"))


def boxes(deltas: DataFrame, side: str) -> DataFrame:
    """Boxes to draw on revision ``side`` ('a' or 'b'), with their change and label; null boxes are left out."""
    box, changes = ("old_bbox", ["removed", "modified"]) if side == "a" else ("new_bbox", ["added", "modified"])
    return deltas.filter(F.col("change_type").isin(changes) & F.col(box).isNotNull()).select("pair_id", "change_type", "element_type", F.col(box).alias("bbox"), label().alias("label"))


def document_line() -> Column:
    """One line about a row of the documents table."""
    revision = F.coalesce(F.nullif(F.col("revision_label"), F.lit("")), F.lit("(no revision label)"))
    return F.format_string("%s (%s, %s): %d pages, %d elements", F.col("pid"), F.col("format"), revision, F.col("page_count"), F.col("n_elements"))


def _cell(x: str | None) -> str:
    return (x or "").replace("|", "\\|") or "—"


def _line(change: str, kind: str) -> str:
    """One change, given as JSON, in one of the three forms."""
    r = json.loads(change)
    if kind == "md":
        return f"| {r['change_type']} | {r['element_type']} | {_cell(r['old_text'])} | {_cell(r['new_text'])} | {r['confidence']} |"
    if kind == "html":
        return f"<tr><td>{html.escape(r['change_type'])}</td><td>{html.escape(r['element_type'])}</td><td>{html.escape(r['old_text'] or '')}</td><td>{html.escape(r['new_text'] or '')}</td><td>{r['confidence']}</td></tr>"
    return change


def _ordered(deltas: DataFrame, pair_id: str) -> DataFrame:
    """change: one pair's changes as JSON, in the order of the report."""
    mine = deltas.filter(F.col("pair_id") == pair_id).orderBy("change_type", F.coalesce("old_element_id", F.lit("")), F.coalesce("new_element_id", F.lit("")))
    return mine.select(F.to_json(F.struct(*deltas.columns), {"ignoreNullFields": "false"}).alias("change"))


def write_changes(deltas: DataFrame, pair_id: str, folder: str) -> None:
    """All changes of one pair, written by the executors as lines of JSON, Markdown and HTML; part files are in order."""
    reachable(deltas.sparkSession)
    rows = _ordered(deltas, pair_id)
    for kind in ("json", "md", "html"):
        rendered = lambda batches, kind=kind: (pd.DataFrame({"value": [_line(x, kind) for x in b["change"]]}) for b in batches)
        rows.mapInPandas(rendered, "value string").write.text(f"{folder}/{kind}")


def report(deltas: DataFrame, stats: DataFrame, pair_id: str, most: int = 2000, *, folder: str) -> dict[str, str]:
    """JSON, Markdown and HTML of one pair: counts of all changes and the first ``most``; all are written to ``folder``.

    Each text says how many it lists of how many, and where all are.
    """
    write_changes(deltas, pair_id, folder)
    mine = deltas.filter(F.col("pair_id") == pair_id)
    counts = {c: {r[c]: [r[x] for x in CHANGES] for r in t.filter(F.col("pair_id") == pair_id).drop("pair_id").orderBy(c).collect()} for c, t in (("element_type", by_element_type(mine)), ("page", by_page(mine)))}
    found = [r[0] for r in _ordered(deltas, pair_id).limit(most).collect()]
    total = sum(map(sum, counts["element_type"].values()))
    note = lambda kind: f"{len(found)} of {total} changes are listed here; all are in {folder}/{kind}"
    stat = [json.loads(r[0]) for r in stats.filter(F.col("pair_id") == pair_id).select(F.to_json(F.struct(*stats.columns))).limit(1).collect()]
    head = stat[0] if stat else {}
    lines = [f"# Changes of {pair_id}", "", *[f"- {k}: {v}" for k, v in head.items() if k not in ("pair_id", "warnings")]]
    lines += [f"- warning: {w['message']}" for w in head.get("warnings", [])]
    for name, table in counts.items():
        lines += ["", f"| {name} | {' | '.join(CHANGES)} |", "|" + "---|" * 4, *[f"| {k} | {' | '.join(map(str, v))} |" for k, v in table.items()]]
    lines += ["", note("md"), "", "| change | type | old | new | confidence |", "|---|---|---|---|---|", *[_line(x, "md") for x in found]]
    summary = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in head.items() if k != "pair_id")
    return {
        "json": json.dumps({"pair_id": pair_id, "stats": head, "counts": counts, "note": note("json"), "deltas": [json.loads(x) for x in found]}, ensure_ascii=False),
        "md": "\n".join(lines) + "\n",
        "html": f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(pair_id)}</title><ul>{summary}</ul><p>{html.escape(note('html'))}</p><table>{''.join(_line(x, 'html') for x in found)}</table>",
    }


#: Headings of a report's sections, its order being that of the changes.
_NAMES = {"added": "Added", "modified": "Modified", "removed": "Removed"}
_COLUMNS = ["change", "type", "old", "new", "confidence"]
_STYLE = (
    "body{font:14px sans-serif;max-width:70em;margin:auto}td,th{padding:2px 8px;text-align:left;border-bottom:1px solid #ccc}"
    ".warning{background:#fff3cd;border:1px solid #b58900;padding:8px}.row{display:flex;align-items:center;margin:3px 0}.row b{width:11em;font-weight:normal}"
    ".bar{display:flex;width:32em;gap:2px}.bar i{height:1.3em;font:11px sans-serif;color:#fff;text-align:center;overflow:hidden}"
    ".added{background:#2a7d3f}.modified{background:#9a6700}.removed{background:#b3261e}"
)


def _bars(title: str, rows: list[tuple[str, dict[str, int]]]) -> str:
    """A chart of stacked bars, one a row, their lengths in proportion to the longest; nothing for no rows."""
    if not rows:
        return ""
    longest = max(sum(n.values()) for _, n in rows) or 1
    parts = lambda n: "".join(f'<i class="{c}" style="width:{100 * n[c] / longest:.2f}%" title="{_NAMES[c]}: {n[c]}">{n[c]}</i>' for c in _NAMES if n[c])
    bars = "".join(f'<div class="row"><b>{html.escape(name)}</b><div class="bar">{parts(n)}</div>&nbsp;{sum(n.values())}</div>' for name, n in rows)
    return f"<h2>{html.escape(title)}</h2>{bars}"


def _known(deltas: DataFrame, stats: DataFrame, documents: DataFrame | None, pair_id: str) -> dict:
    """What a report says besides its changes: statistics, counts and the documents' lines; one pair's, so small."""
    mine = deltas.filter(F.col("pair_id") == pair_id)
    counted = lambda t, by: [(str(r[by]), {c: r[c] for c in CHANGES}) for r in t.collect()]
    shown = worth_charting(mine)
    stat = stats.filter(F.col("pair_id") == pair_id).select(F.to_json(F.struct(*stats.columns)).alias("s")).limit(1).collect()
    total = by_change(mine).collect()
    of = {c: total[0][c] if total else 0 for c in _NAMES}
    kinds = counted(by_element_type(shown).orderBy(F.col("total").desc(), "element_type"), "element_type")
    lines = documents.filter(F.col("pair_id") == pair_id).orderBy("side").select(document_line().alias("l")).collect() if documents is not None else []
    return {
        "stats": json.loads(stat[0].s) if stat else {}, "of": of, "pages": counted(by_page(shown).orderBy("page"), "page"), "types": kinds,
        "uncharted": sum(of.values()) - sum(sum(n.values()) for _, n in kinds), "documents": [r.l for r in lines],
    }


def _frame(kind: str, pair_id: str, known: dict) -> tuple[str, str]:
    """What stands before and behind the changes."""
    stats = {k: v for k, v in known["stats"].items() if k not in ("pair_id", "warnings")}
    warnings = [w["message"] for w in known["stats"].get("warnings", [])]
    if kind == "json":
        head = json.dumps({"pair_id": pair_id, "documents": known["documents"], "stats": known["stats"], "counts": known["of"]}, ensure_ascii=False)
        return head[:-1] + ', "deltas": [\n', "]}\n"
    if kind == "md":
        lines = [f"# Changes of {pair_id}", "", *[f"- {x}" for x in known["documents"]], "", *[f"> **Warning:** {w}\n" for w in warnings], "## Summary", "", "| | |", "|---|---|", *[f"| {k} | {_cell(str(v))} |" for k, v in stats.items()]]
        return "\n".join(lines) + "\n", ""
    e = html.escape
    note = f"<p>{known['uncharted']} changes of very short texts are left out of the charts, not of the tables.</p>" if known["uncharted"] else ""
    told = "".join(f"<p>{e(x)}</p>" for x in known["documents"]) + "".join(f'<p class="warning" role="alert">{e(w)}</p>' for w in warnings)
    tiles = "".join(f"<tr><th>{e(k)}</th><td>{e(str(v))}</td></tr>" for k, v in stats.items())
    charts = _bars("Changes by page", [(f"Page {p}", n) for p, n in known["pages"]]) + _bars("Changes by element type", known["types"])
    head = f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Changes of {e(pair_id)}</title><style>{_STYLE}</style></head><body><h1>Changes of {e(pair_id)}</h1>{told}<table>{tiles}</table>{charts}{note}<table>\n"
    return head, "</table></body></html>\n"


def _section(kind: str, change: str, n: int) -> str:
    """What stands before the first change of a section."""
    if kind == "md":
        return f"\n## {_NAMES[change]} ({n})\n\n| {' | '.join(_COLUMNS)} |\n|{'---|' * len(_COLUMNS)}\n"
    if kind == "html":
        return f"</table><h2>{_NAMES[change]} ({n})</h2><table><tr>{''.join(f'<th>{c}</th>' for c in _COLUMNS)}</tr>\n"
    return ""


def write_report(deltas: DataFrame, stats: DataFrame, pair_id: str, folder: str, documents: DataFrame | None = None) -> dict[str, str]:
    """One pair's whole report as report.json, report.md and report.html in ``folder``; returns their paths.

    documents (pair_id, side, and the columns of ``document_line``) gives a line about each side. Executors render all
    changes in the report's order; the driver puts their part files together as streams and holds no change itself. A
    pair without changes or statistics gets a report without them.
    """
    spark = reachable(deltas.sparkSession)
    known = _known(deltas, stats, documents, pair_id)
    rows = _ordered(deltas, pair_id)
    ids = F.struct(F.coalesce("old_element_id", F.lit("")).alias("o"), F.coalesce("new_element_id", F.lit("")).alias("n"))
    firsts = {r.change_type: tuple(r.first) for r in deltas.filter(F.col("pair_id") == pair_id).groupBy("change_type").agg(F.min(ids).alias("first")).collect()}
    very_first = min(firsts, default=None)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(conf)
    paths = {}
    for kind in ("json", "md", "html"):

        def rendered(batches, kind=kind):
            for b in batches:
                out = []
                for x in b["change"]:
                    r = json.loads(x)
                    begins = firsts[r["change_type"]] == (r["old_element_id"] or "", r["new_element_id"] or "")
                    head = _section(kind, r["change_type"], known["of"][r["change_type"]]) if begins else ""
                    comma = "," if kind == "json" and not (begins and r["change_type"] == very_first) else ""
                    out.append(head + comma + _line(x, kind))
                yield pd.DataFrame({"value": out}, dtype="object")

        parts, paths[kind] = f"{folder}/_parts_{kind}", f"{folder}/report.{kind}"
        rows.mapInPandas(rendered, "value string").write.mode("overwrite").text(parts)
        head, tail = _frame(kind, pair_id, known)
        found = [f.getPath() for f in fs.listStatus(at(parts)) if f.getPath().getName().startswith("part-")]
        out = fs.create(at(paths[kind]), True)
        try:
            out.write(bytearray(head, "utf-8"))
            for part in sorted(found, key=lambda f: int(f.getName().split("-")[1])):
                held = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
                finally:
                    held.close()
            out.write(bytearray(tail, "utf-8"))
        finally:
            out.close()
        fs.delete(at(parts), True)
    return paths
