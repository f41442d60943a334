"""Boxes and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent(size: Column) -> Column:
    return F.when(size == 0, F.lit(1.0)).otherwise(size)


def normalised(box: Column) -> Column:
    """Corner coordinates as shares of the page; a page side of zero counts as one."""
    w, h = extent(box["page_width"]), extent(box["page_height"])
    return F.struct((box["x0"] / w).alias("x0"), (box["y0"] / h).alias("y0"), (box["x1"] / w).alias("x1"), (box["y1"] / h).alias("y1"))


def centre(box: Column) -> tuple[Column, Column]:
    """Centre of the normalised box."""
    n = normalised(box)
    return (n["x0"] + n["x1"]) / 2, (n["y0"] + n["y1"]) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def union(boxes: Column) -> Column:
    """The box around an array of boxes."""
    pick = lambda name: F.transform(boxes, lambda b: b[name])
    return F.struct(F.array_min(pick("x0")).alias("x0"), F.array_min(pick("y0")).alias("y0"), F.array_max(pick("x1")).alias("x1"), F.array_max(pick("y1")).alias("y1"))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area; touching edges don't."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def points(pixels: Column, dpi: Column | float) -> Column:
    return pixels * 72.0 / dpi


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cells(x: Column, y: Column, size: float, around: bool) -> Column:
    """The grid cell of a point as struct<cx,cy>; with ``around`` the array of its 3 x 3 neighbourhood."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    if not around:
        return F.struct(cx.alias("cx"), cy.alias("cy"))
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
