"""Where regular expressions match, by column expressions only: positions in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.llm.quality import let

_STEP = 64
#: Code points of a piece of text. Positions are found by piece, as a substring is counted from its string's start.
_PIECE = 512


def _running(values: Column, start, step) -> Column:
    """``step`` over all values before each, as an array. Two levels, so that many values don't cost their square."""
    zero = F.lit(start).cast("long")

    def inner(part: Column, base: Column) -> Column:
        first = F.struct(base.cast("long").alias("now"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct(step(a["now"], x).alias("now"), F.array_append(a["out"], a["now"]).alias("out")))["out"]

    def outer(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, step))
        return let(inner(totals, zero), lambda b: F.flatten(F.transform(parts, lambda p, i: inner(p, F.get(b, i)))))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_STEP)), lambda i: F.slice(v, i, _STEP))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(let(cut(v), outer)))


def running(lengths: Column) -> Column:
    """Sums of all values before each."""
    return _running(lengths, 0, lambda a, x: a + x)


def covered(ends: Column) -> Column:
    """The largest of all values before each, 0 for the first."""
    return _running(ends, 0, lambda a, x: F.greatest(a, x))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in pieces; none where end is not behind start."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(held, (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def matches(text: Column, pattern: str, kind: str, keep=None, group: int | None = None) -> Column:
    """array<struct<kind,start,end,value>> of the leftmost non-overlapping matches that ``keep(value, group)`` lets stay."""

    def placed(hits: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        sizes = F.transform(hits, lambda x: F.length(x).cast("long"))
        both = F.struct(running(pieces).alias("p"), pieces.alias("n"), running(sizes).alias("h"), sizes.alias("s"))
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else hits
        filled = let(
            F.struct(both.alias("b"), inner.alias("g")),
            lambda x: F.transform(
                hits,
                lambda v, i: let(
                    F.get(x["b"]["p"], i) + F.get(x["b"]["n"], i) + F.get(x["b"]["h"], i),
                    lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.get(x["b"]["s"], i)).alias("end"), v.alias("value"), F.get(x["g"], i).alias("g")),
                ),
            ),
        )
        stay = F.filter(filled, lambda x: keep(x["value"], x["g"])) if keep else filled
        return F.transform(stay, lambda x: F.struct(x["kind"], x["start"], x["end"], x["value"]))

    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], by_start: bool) -> Column:
    """Spans by kind as listed, then start, or the other way round."""
    rank = lambda x: F.array_position(F.lit(kinds), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x).cast("long").alias("b"), x["end"].alias("c"), x.alias("x")) if by_start else F.struct(rank(x).cast("long").alias("a"), x["start"].alias("b"), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def masked(text: Column, spans: Column, put) -> Column:
    """``text`` with every span, sorted by start, put as ``put(span, what it covers)``; what starts inside an earlier one goes with it."""

    def told(x: Column) -> Column:
        kept = F.transform(x["s"], lambda s, i: F.when(s["start"] >= F.get(x["c"], i), F.concat(between(x["p"], F.get(x["c"], i), s["start"]), put(s, between(x["p"], s["start"], s["end"])))).otherwise(""))
        return F.concat(F.array_join(kept, ""), between(x["p"], F.array_max(F.transform(x["s"], lambda s: s["end"])), x["n"]))

    parts = F.struct(spans.alias("s"), covered(F.transform(spans, lambda s: s["end"])).alias("c"), pieces(text).alias("p"), F.length(text).cast("long").alias("n"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, told))
