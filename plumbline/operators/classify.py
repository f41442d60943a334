"""Typing the lines of text blocks.

Blocks of one line take the column rules. In longer blocks a line may use up those behind it (notes, instrument
bubbles), so their lines are read in order, as sorted streams.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.groups import sorted_groups

#: One line of a block. ``box`` is x0, y0, x1, y1 in the page's own unit.
LINE = "pid string, page int, block long, line long, text string, x0 double, y0 double, x1 double, y1 double"
DRAFT = "pid string, page int, block long, line long, type string, text string, x0 double, y0 double, x1 double, y1 double, attributes map<string,string>"
_PLACE = ["pid", "page", "block", "line"]
_BOX = ["x0", "y0", "x1", "y1"]


class Rules:
    """The same label shapes for the sequential reader."""

    def __init__(self) -> None:
        c = re.compile
        self.mark, self.note, self.section, self.reference = c(X.NOTE_MARK), c(X.NOTE_LINE), c(X.NOTE_SECTION), c(X.NOTE_REFERENCE)
        self.loop, self.unit, self.letter = c(X.LOOP_NUMBER), c(X.UNIT_NUMBER), c(X.ONE_LETTER)
        self.plain = [(c(X.LINE_NUMBER), "line_number", None), (c(X.INSTRUMENT), "instrument_loop", self._loop), (c(X.VALVE), "valve", None), (c(X.TAG), "tag", None)]
        self.values = [
            (c(X.SETPOINT), "setpoint", lambda m: {"setpoint_type": "SP", "value": m[2], "unit": m[3].strip()}),
            (c(X.LIMIT), "setpoint", lambda m: {"setpoint_type": m[1], "value": m[2]}),
            (c(X.SIZE_CHANGE), "dimension", lambda m: {"kind": "size_transition"}),
        ]
        self.misread = [(c(X._tolerant(p)), kind, make) for p, kind, make in ((X.LINE_NUMBER, "line_number", None), (X.INSTRUMENT, "instrument_loop", self._meant), (X.VALVE, "valve", None), (X.TAG, "tag", None))]
        self.letters = str.maketrans(X.MISREAD, X.MEANT)

    @staticmethod
    def _loop(m):
        return {"function": m[1], "loop_number": m[2]} if m[1] in X.INSTRUMENTS else None

    def _meant(self, m):
        code = m[1].translate(self.letters)
        return {"function": code, "loop_number": m[2]} if code in X.INSTRUMENTS else None

    def first(self, rules, t: str):
        for shape, kind, make in rules:
            if (m := shape.match(t)) and (found := make(m) if make else {}) is not None:
                return kind, found
        return None

    def starts_note(self, t: str) -> bool:
        return bool(self.mark.match(t) or self.note.match(t))

    def read(self, lines: list[str], tolerant: bool = False):
        """(type, text, attributes, first line, lines used) of a block's elements, in order."""
        lines = [x.strip() for x in lines]
        out = []
        at = 0
        while at < len(lines):
            t, used = lines[at], 1
            if self.starts_note(t):
                m = self.note.match(t)
                number, body = (m[1], [m[2]]) if m and not self.mark.match(t) else (t.rstrip("."), [])
                while at + used < len(lines) and not self.starts_note(lines[at + used]) and not self.section.match(lines[at + used]):
                    body.append(lines[at + used])
                    used += 1
                made = "note", f"{number}. {' '.join(body).strip()}".strip(), {"kind": "definition", "note_number": number}
            elif self.reference.match(t):
                made = "note", t, {"kind": "reference", "refs": ",".join(re.findall(r"\d+", t))}
            elif single := self.first(self.plain + self.values, t):
                made = single[0], t, single[1]
            elif t in X.INSTRUMENTS and at + 1 < len(lines) and self.loop.match(lines[at + 1]):
                used, parts = 2, {"function": t, "loop_number": lines[at + 1]}
                if at + 2 < len(lines) and self.unit.match(lines[at + 2]):
                    used, parts["unit"] = 3, lines[at + 2]
                made = "instrument_loop", f"{t}-{lines[at + 1]}", parts
            elif t in X.FLAGS:
                made = "text_block", t, {"kind": "valve_status_flag"}
            elif self.letter.match(t):
                made = "text_block", t, {"kind": "flag"}
            elif tolerant and (again := self.first(self.misread, t)):
                made = again[0], t, again[1] | {"ocr_reclassified": "true"}
            else:
                made = "text_block", t, {}
            out.append((*made, at, used))
            at += used
        return out


_rules: Rules | None = None


def rules() -> Rules:
    global _rules
    _rules = _rules or Rules()
    return _rules


def classify(lines: DataFrame, ocr_tolerant: bool = False) -> DataFrame:
    """Elements of all blocks (columns: see DRAFT); ``line`` is an element's first line, its box is around all it used.

    Blank lines are kept as the caller gives them; a null text is blank; lines repeat as often as they come.
    """
    block = ["pid", "page", "block"]
    sized = lines.select(*_PLACE, F.coalesce("text", F.lit("")).alias("text"), *_BOX).withColumn("n", F.count("*").over(Window.partitionBy(*block)))
    one = sized.filter("n = 1").withColumn("made", X.one_line(F.col("text"), ocr_tolerant))
    one = one.select(*_PLACE, "made.type", "made.text", *_BOX, "made.attributes")

    def read(rows):
        out = []
        first = tuple(rows[c][0] for c in block)
        for kind, text, attributes, at, used in rules().read(rows["text"], ocr_tolerant):
            box = [f(rows[c][at : at + used]) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))]
            out.append((*first, rows["line"][at], kind, text, *box, attributes))
        return out

    several = sorted_groups(sized.filter("n > 1").drop("n"), block, ["line"], read, DRAFT)
    return one.unionByName(several)


def elements(drafts: DataFrame, pages: DataFrame, adapter: str, unit: str, confidence=None) -> DataFrame:
    """Drafts as element rows, numbered per document in reading order. ``pages``: pid, page, page_width, page_height."""
    order = Window.partitionBy("pid").orderBy("page", "block", "line")
    seq = F.row_number().over(order) - 1
    box = F.struct("page", "x0", "y0", "x1", "y1", "page_width", "page_height", F.lit(unit).alias("unit"))
    rows = drafts.join(pages, ["pid", "page"]).withColumn("seq", seq.cast("long"))
    return rows.select(
        "pid", F.format_string("%s:%s:%05d", F.col("pid"), F.lit(adapter), F.col("seq")).alias("id"), "seq", "type", "text", box.alias("bbox"), "attributes",
        F.lit(adapter).alias("source_adapter"), (confidence if confidence is not None else F.lit(1.0)).alias("extraction_confidence"),
    )


def note_sessions(lines: DataFrame) -> DataFrame:
    """Lines with the number of the note that they belong to (0 before the first): window functions only.

    For tables of plain note columns, where no line is used up by anything else.
    """
    t = X.strip(F.col("text"))
    starts = (t.rlike(X.NOTE_MARK) | t.rlike(X.NOTE_LINE)).cast("long")
    order = Window.partitionBy("pid", "page", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("note", F.sum(starts).over(order))


def bubbles(lines: DataFrame) -> DataFrame:
    """Instrument bubbles by look-ahead: a code, a loop number on the next line, perhaps a unit on the one after."""
    order = Window.partitionBy("pid", "page", "block").orderBy("line")
    t = X.strip(F.col("text"))
    ahead = lines.select(*_PLACE, t.alias("code"), F.lead(t, 1).over(order).alias("loop_number"), F.lead(t, 2).over(order).alias("after"))
    found = ahead.filter(F.col("code").isin(X.INSTRUMENTS) & F.col("loop_number").rlike(X.LOOP_NUMBER))
    return found.select(*_PLACE, F.concat_ws("-", "code", "loop_number").alias("text"), "code", "loop_number", F.when(F.col("after").rlike(X.UNIT_NUMBER), F.col("after")).alias("unit"))
