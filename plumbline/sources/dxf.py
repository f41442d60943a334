"""ASCII DXF drawings as element rows.

A file is a list of (group code, value) lines. Sections give block definitions and the model space; both are lists of
entities. Extents: lines and curves by their points (arcs by the angles that they pass), text by its height and an
average letter width, inserted blocks by their definition's extents, scaled, turned and moved.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.classify import rules
from plumbline.schemas import ELEMENT
from plumbline.session import reachable
from plumbline.settings import DEFAULT

ADAPTER = "dwg"
GEOMETRY = frozenset(("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "SPLINE", "ELLIPSE"))
LETTER_WIDTH = 0.6  # of the text's height
_DETAIL = {"ATTRIB", "VERTEX", "SEQEND"}


def groups(text: str) -> Iterator[tuple[int, str]]:
    lines = text.splitlines()
    for k in range(0, len(lines) - 1, 2):
        try:
            yield int(lines[k]), lines[k + 1].rstrip("\r")
        except ValueError:
            return


class Entity:
    """One drawing object: its type, its values by group code, and the attributes or vertices that follow it."""

    def __init__(self, kind: str):
        self.kind, self.values, self.parts = kind, {}, []

    def text(self, code: int, default: str = "") -> str:
        return self.values.get(code, [default])[0]

    def number(self, code: int, default: float = 0.0) -> float:
        try:
            return float(self.values.get(code, [default])[0])
        except ValueError:
            return default

    def points(self, x: int = 10) -> list[tuple[float, float]]:
        xs, ys = self.values.get(x, []), self.values.get(x + 10, [])
        return [(float(a), float(b)) for a, b in zip(xs, ys, strict=False)]


def read(text: str) -> tuple[list[Entity], dict[str, tuple[tuple[float, float], list[Entity]]]]:
    """(model space, blocks by name: base point and entities)."""
    model: list[Entity] = []
    blocks: dict[str, tuple[tuple[float, float], list[Entity]]] = {}
    section, into, block, current = "", None, None, None
    named = False
    for code, value in groups(text):
        if code == 0:
            current = None
            if value == "SECTION":
                named = True
            elif value == "ENDSEC":
                section, into = "", None
            elif section == "BLOCKS" and value == "BLOCK":
                block = current = Entity("BLOCK")
                into = block.parts
            elif section == "BLOCKS" and value == "ENDBLK":
                if block:
                    blocks[block.text(2)] = ((block.number(10), block.number(20)), block.parts)
                into = None
            elif into is not None:
                current = Entity(value)
                if value in _DETAIL and into and into[-1].kind in ("INSERT", "POLYLINE"):
                    into[-1].parts.append(current)
                else:
                    into.append(current)
        elif named and code == 2:
            section, named = value, False
            into = model if value == "ENTITIES" else None
        elif current is not None:
            current.values.setdefault(code, []).append(value.strip() if code not in (1, 3) else value)
    return [e for e in model if e.number(67) == 0], blocks


def _around(points) -> tuple[float, float, float, float] | None:
    points = list(points)
    if not points:
        return None
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _turned(x: float, y: float, degrees: float) -> tuple[float, float]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def _lettered(e: Entity, lines: list[str], height: float, down: bool) -> tuple[float, float, float, float] | None:
    x, y = (e.points() or [(0.0, 0.0)])[0]
    width = max(map(len, lines), default=0) * height * LETTER_WIDTH
    tall = height * (1 + 5 / 3 * (len(lines) - 1))
    corners = [(0, 0), (width, 0), (0, -tall if down else tall), (width, -tall if down else tall)]
    return _around((x + a, y + b) for a, b in (_turned(*c, e.number(50)) for c in corners)) if width else None


def extent(e: Entity, blocks, depth: int = 0) -> tuple[float, float, float, float] | None:
    """Box of an entity; null where it has nothing to show."""
    kind = e.kind
    if kind == "LINE":
        return _around(e.points() + e.points(11))
    if kind == "LWPOLYLINE":
        return _around(e.points())
    if kind == "POLYLINE":
        return _around(p for v in e.parts if v.kind == "VERTEX" for p in v.points())
    if kind == "SPLINE":
        return _around(e.points(11) or e.points())
    if kind in ("CIRCLE", "ARC"):
        (x, y), r = (e.points() or [(0.0, 0.0)])[0], e.number(40)
        if kind == "CIRCLE":
            return x - r, y - r, x + r, y + r
        a, b = e.number(50) % 360, e.number(51) % 360
        b += 360 if b <= a else 0
        turns = [a, b, *(q for q in range(0, 721, 90) if a <= q <= b)]
        return _around((x + r * math.cos(math.radians(t)), y + r * math.sin(math.radians(t))) for t in turns)
    if kind == "ELLIPSE":
        (x, y), (mx, my), share = (e.points() or [(0.0, 0.0)])[0], (e.points(11) or [(0.0, 0.0)])[0], e.number(40, 1.0)
        a, b = e.number(41), e.number(42, 2 * math.pi)
        steps = [a + (b - a) * i / 72 for i in range(73)]
        return _around((x + mx * math.cos(t) - my * share * math.sin(t), y + my * math.cos(t) + mx * share * math.sin(t)) for t in steps)
    if kind in ("TEXT", "ATTRIB", "ATTDEF"):
        return _lettered(e, [e.text(1).strip()], e.number(40, 1.0), False)
    if kind == "MTEXT":
        return _lettered(e, plain(e).split("\n"), e.number(40, 1.0), True)
    if kind == "DIMENSION":
        return _around(e.points() + e.points(11) + e.points(13) + e.points(14))
    if kind == "INSERT" and depth < 16:
        base, inside = blocks.get(e.text(2), ((0.0, 0.0), []))
        boxes = [b for p in inside if p.kind != "ATTDEF" and (b := extent(p, blocks, depth + 1))]
        boxes += [b for p in e.parts if p.kind == "ATTRIB" and (b := extent(p, blocks, depth + 1))] if not boxes else []
        x, y = (e.points() or [(0.0, 0.0)])[0]
        sx, sy = e.number(41, 1.0), e.number(42, 1.0)
        corners = [((cx - base[0]) * sx, (cy - base[1]) * sy) for b in boxes for cx in (b[0], b[2]) for cy in (b[1], b[3])]
        return _around((x + a, y + b) for a, b in (_turned(*c, e.number(50)) for c in corners))
    return None


def plain(e: Entity) -> str:
    """Text of an MTEXT without its formatting."""
    t = "".join([*e.values.get(3, []), *e.values.get(1, [])])
    t = re.sub(r"\\P|\^J", "\n", t)
    t = re.sub(r"\\[ACFHQTWfpc][^;]*;|\\[LlOoKkN]", "", t)
    t = re.sub(r"\\S([^;]*);", lambda m: re.sub(r"[#^]", "/", m[1]), t)
    return re.sub(r"(?<!\\)[{}]", "", t).replace("\\~", " ").replace("\\{", "{").replace("\\}", "}").replace("\\\\", "\\")


def _typed(text: str) -> tuple[str, dict[str, str]]:
    kind, _, attributes, _, _ = rules().read([text])[0]
    return kind, dict(attributes)


def drafts(text: str, decimals: int = DEFAULT.dimension_decimals) -> list[tuple[str, str, tuple, dict[str, str]]]:
    """(type, text, box, attributes) of a drawing's model space, in file order."""
    model, blocks = read(text)
    out = []
    for e in model:
        box = extent(e, blocks)
        if box is None:
            continue
        own = {"layer": e.text(8, "0"), "entity_type": e.kind}
        if e.kind == "TEXT" and (t := e.text(1).strip()):
            kind, attributes = _typed(t)
            out.append((kind, t, box, attributes | own))
        elif e.kind == "MTEXT":
            lines = [x for x in plain(e).strip().splitlines() if x.strip()]
            out += [(kind, t, box, attributes | own) for kind, t, attributes, _, _ in rules().read(lines)]
        elif e.kind == "INSERT":
            name = e.text(2)
            out.append(("geometry", name, box, own | {"block_name": name}))
            for part in e.parts:
                if part.kind == "ATTRIB" and (t := part.text(1).strip()):
                    kind, attributes = _typed(t)
                    out.append((kind, t, extent(part, blocks) or box, attributes | {"layer": own["layer"], "entity_type": "ATTRIB", "attrib_tag": part.text(2), "parent_block": name}))
        elif e.kind == "DIMENSION":
            t = e.text(1).strip()
            if not t or t == "<>":
                t = f"{e.number(42):.{decimals}f}" if 42 in e.values else _measured(e, decimals)
            out.append(("dimension", t, box, own | {"kind": "dimension"}))
        elif e.kind in GEOMETRY:
            out.append(("geometry", "", box, own))
    return out


def _measured(e: Entity, decimals: int) -> str:
    ends = (e.points(13) or [None])[0], (e.points(14) or [None])[0]
    if None in ends:
        return ""
    (ax, ay), (bx, by) = ends
    if int(e.number(70)) & 7 == 0:  # a rotated dimension measures along its own direction
        dx, dy = _turned(bx - ax, by - ay, -e.number(50))
        return f"{abs(dx):.{decimals}f}"
    return f"{math.hypot(bx - ax, by - ay):.{decimals}f}"


def elements(pid: str, text: str) -> list[tuple]:
    """Element rows of one drawing, its lower left corner at (0, 0). A drawing without any is an error."""
    found = drafts(text)
    if not found:
        raise ValueError(f"{pid}: no supported entities")
    x, y, right, top = (f(d[2][i] for d in found) for i, f in enumerate((min, min, max, max)))
    w, h = right - x or 1.0, top - y or 1.0
    return [(pid, f"{pid}:{ADAPTER}:{n:05d}", n, kind, t, {"page": 0, "x0": b[0] - x, "y0": b[1] - y, "x1": b[2] - x, "y1": b[3] - y, "page_width": w, "page_height": h, "unit": "dxf_units"}, attributes, ADAPTER, 1.0) for n, (kind, t, b, attributes) in enumerate(found)]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all drawings under ``path``; a file's name without ending is its pid."""
    reachable(spark)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("pid"), "content")

    def parse(parts):
        import pandas as pd

        for pdf in parts:
            for pid, content in zip(pdf["pid"], pdf["content"], strict=True):
                yield pd.DataFrame(elements(pid, bytes(content).decode("utf-8", "replace")), columns=ELEMENT.names)

    return files.mapInPandas(parse, ELEMENT)
