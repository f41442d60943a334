"""Removing passages that repeat across documents, by level-wise doubling.

Level one looks at windows of half the length (7 words for 13). Every full window is represented by the smallest hash
among the half windows inside it, so equal full windows have equal representatives, and only about a quarter of the
half windows are ever shuffled. Representatives seen in one document only are dropped; where one survives, its two
half windows are put together to the window of the full length, and counted in the same way. Windows repeated at that
level are removed from all documents but the first. ``repeated_lengths`` carries the places that survive on to twice
the length, and so on, until none does.

Both levels send, for each group of neighbouring documents, one row per distinct window, and get back one row per
window of that group that matters. So a passage that a third of all documents share makes as many rows as there are
document groups, not as there are documents or pairs of them. Groups come to Python as a sorted stream, their windows
before their documents: a task holds one group's surviving windows and one slice of texts, and a long document is a
group of its own.

A word of up to 15 bytes is its own number, a longer one its XXH3-128; windows are 128 bits of finalised mixes of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm._common import PACKED, attach, documents, materialize, mixed, packed, slices, spread, utf8

WINDOW = 13
#: Documents of one group: doc_ids that agree above this many low bits.
GROUP_BITS = 9
#: Bytes from which a document is a group of its own.
LONG_TEXT = 1 << 18
SLICE_BYTES = 4 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of many texts: where they stand, and two hashes of each."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        inside = ~_SPACE[raw]
        begin = inside.copy()
        end = np.zeros(n + 1, bool)
        if n:
            begin[1:] &= ~inside[:-1]
            cut = offsets[(offsets > 0) & (offsets < n)]
            begin[cut] |= inside[cut]
            end[1:n] = inside[:-1] & ~inside[1:]
            end[cut] |= inside[cut - 1]
            end[n] = inside[-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.raw, self.data = raw, data

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word."""
        import xxhash

        lengths = self.ends - self.starts
        a, b = packed(self.raw, self.starts, lengths)
        for i in np.flatnonzero(lengths > PACKED).tolist():
            digest = xxhash.xxh3_128_intdigest(self.data[self.starts[i] : self.ends[i]], 1)
            a[i], b[i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
        return tuple(mixed((a ^ mixed(b ^ seed)) * m + b) for m, seed in zip((_M1, _M2), _SEEDS, strict=True))


def _joined(a: np.ndarray, b: np.ndarray, step: int, mul: np.uint64) -> np.ndarray:
    """Hashes of windows from those of their first and their last part, ``step`` words apart."""
    return mixed(a * mul + b + np.uint64(step))


def _doubled(h: np.ndarray, have: int, want: int, mul: np.uint64) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have`` words, doubling; the last step may overlap."""
    while have < want:
        step = min(have, want - have)
        if len(h) <= step:
            return h[:0]
        h = _joined(h[:-step], h[step:], step, mul)
        have += step
    return h


def _windows(words: Words, length: int):
    """(start index, half-window representative) of all windows of ``length`` words that lie in one text, and the half windows' hashes."""
    half = (length + 1) // 2
    low = [_doubled(h, 1, half, m) for h, m in zip(words.hashes(), (_M1, _M2), strict=True)]
    n = len(words.starts) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), low
    least = low[0][:n].copy()
    for o in range(1, length - half + 1):
        np.minimum(least, low[0][o : o + n], out=least)
    start = np.flatnonzero(words.text[:n] == words.text[length - 1 :])
    return start, least[start], low


def _full(low, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows at ``starts``, each put together from the half window it begins with and the one it ends with."""
    step = length - (length + 1) // 2
    return tuple(_joined(h[starts], h[starts + step], step, m).view(np.int64) for h, m in zip(low, (_M1, _M2), strict=True))


def _ranges(keys: list[np.ndarray], docs: np.ndarray):
    """Distinct keys, and the smallest and largest document of each."""
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    fresh = np.ones(len(docs), bool)
    if len(docs):
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(docs))[: len(first)] - 1
    return [k[first] for k in keys], docs[first], docs[last]


def _half_level(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, groups = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "grp"))
            words = Words(*utf8(part.column("text")))
            start, least, _ = _windows(words, length)
            text = words.text[start]
            fresh = np.ones(len(start), bool)
            if len(start):
                fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            text = text[fresh]
            (group, key), lo, hi = _ranges([groups[text], least[fresh].view(np.int64)], ids[text])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, group, lo, hi)], names=["key", "grp", "lo", "hi"])


def _known(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _told(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """From a stream of windows and documents sorted by group, windows first: (group, its windows' columns, slice of documents)."""
    group, held, table = None, [], None
    for batch in batches:
        groups = batch.column("grp").to_numpy()
        is_doc = batch.column("is_doc").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1 if batch.num_rows else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            if groups[a] != group:
                group, held, table = groups[a], [], None
            if not is_doc[a]:
                held.append([batch.column(c).slice(a, b - a).to_numpy() for c in names])
                continue
            if table is None:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64) for _ in names]
                order = np.lexsort(columns[::-1])
                table, held = [c[order] for c in columns], []
            docs = pa.RecordBatch.from_struct_array(batch.column("doc").slice(a, b - a))
            for part in slices(docs, "text", SLICE_BYTES):
                yield int(group), table, part


def _full_level(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "check", "grp", "lo", "hi"]
    for group, (alive,), part in _told(batches, ("key",)):
        if not len(alive):
            continue
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        words = Words(*utf8(part.column("text")))
        start, least, low = _windows(words, length)
        start = start[_known(alive, least.view(np.int64))]
        keys, lo, hi = _ranges([*_full(low, start, length)], ids[words.text[start]])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*keys, np.full(len(lo), group, np.int64), lo, hi)], names=names)


def _at(key, check, table) -> np.ndarray:
    """Where in a table sorted by key and check each window stands; -1 where it doesn't."""
    keys, checks, _ = table
    out = np.full(len(key), -1, np.int64)
    at = np.searchsorted(keys, key)
    todo = np.arange(len(key))
    while len(todo):  # more than once only where windows share the first hash
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] == key[todo]]
        hit = checks[at[todo]] == check[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
    return out


def _earlier(key, check, docs, table) -> np.ndarray:
    """Whether each window also starts in a smaller document, from sorted (key, check, smallest document)."""
    at = _at(key, check, table)
    return (at >= 0) & (table[2][at] < docs) if len(table[2]) else np.zeros(len(key), bool)


def _covered(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(part: pa.RecordBatch, length: int, table, digest: bool):
    ids = part.column("doc_id").to_numpy(zero_copy_only=False) if table is not None else None
    data, offsets = utf8(part.column("text"))
    words = Words(data, offsets)
    gone = np.zeros(len(words.starts), bool)
    if table is not None and len(table[0]):
        start, _, low = _windows(words, length)
        key, check = _full(low, start, length)
        gone = _covered(words, start[_earlier(key, check, ids[words.text[start]], table)], length)
    counts = np.diff(words.first)
    run = np.concatenate(([0], np.cumsum(gone)))
    removed = run[words.first[1:]] - run[words.first[:-1]]
    if digest:  # kept words, one space after each, cut where texts end
        kept = np.flatnonzero(~gone)
        sizes = words.ends[kept] - words.starts[kept] + 1
        padded = np.append(words.raw, np.uint8(32))
        spelled = padded[np.minimum(spread(words.starts[kept], sizes), len(words.raw))]
        ends = np.cumsum(sizes)
        spelled[ends - 1] = 32
        joined = spelled.tobytes()
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts - removed)))]
        value = [hashlib.sha256(joined[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    else:
        value = part.column("text").to_pylist()
        for i in np.flatnonzero(removed).tolist():  # a removed word goes with the white space behind it
            a, b = words.first[i], words.first[i + 1]
            until = np.append(words.starts[a + 1 : b], offsets[i + 1])
            stay = [data[offsets[i] : words.starts[a]], *(data[words.starts[a + k] : until[k]] for k in np.flatnonzero(~gone[a:b]).tolist())]
            value[i] = b"".join(stay).decode("utf-8")
    return counts, removed, value


def _last(batches: Iterator[pa.RecordBatch], length: int, digest: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for _, table, part in _told(batches, ("key", "check", "lo")):
        yield from _answer([part], length, table, digest, columns)


def _shape(schema: pa.Schema, digest: bool, columns: list[str]) -> pa.Schema:
    kept = [schema.field(c) for c in columns]
    return pa.schema([*kept, pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), *([pa.field("kept_sha256", pa.string())] if digest else [])])


def _answer(parts, length, table, digest, columns):
    for part in parts:
        counts, removed, value = _cut(part, length, table, digest)
        text = pa.array(value, part.schema.field("text").type if not digest else pa.string())
        kept = [text if c == "text" else part.column(c) for c in columns]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), *([text] if digest else [])], schema=_shape(part.schema, digest, columns))


def _unnumbered(batches, length, digest, columns):
    for batch in batches:
        yield from _answer(slices(batch, "text", SLICE_BYTES), length, None, digest, columns)


def _group() -> F.Column:
    """The group that a document's windows are counted in."""
    own = F.shiftleft(F.col("doc_id").cast("long"), 1)
    return F.when(F.octet_length("text") >= LONG_TEXT, own.bitwiseOR(F.lit(1).cast("long"))).otherwise(F.shiftleft(F.shiftright(F.col("doc_id").cast("long"), GROUP_BITS), 1))


def _streamed(docs: DataFrame, windows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Documents (columns grp, doc) and windows (grp, names) of each group as one sorted stream, see ``_told``."""
    rows = docs.select("grp", F.lit(True).alias("is_doc"), *[F.lit(None).cast("long").alias(n) for n in names], "doc")
    keys = windows.select("grp", F.lit(False).alias("is_doc"), *names, F.lit(None).cast(docs.schema["doc"].dataType).alias("doc"))
    return keys.unionByName(rows).repartition("grp").sortWithinPartitions("grp", "is_doc")


def repeated_windows(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """Windows of ``length`` words that start in more than one document: grp, key, check, lo (the smallest such doc_id).

    One row per window and group of neighbouring documents that has a later document with it (more, where a group is
    read in several slices).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    rows = rows.select(_group().alias("grp"), "doc_id", "text")
    same = Window.partitionBy("key")
    half = rows.mapInArrow(partial(_half_level, length=length), "key long, grp long, lo long, hi long")
    half = half.withColumns({"lo": F.min("lo").over(same), "hi": F.max("hi").over(same)}).filter("lo < hi").select("grp", "key")
    half = materialize(half, "half-windows")
    stream = _streamed(rows.select("grp", F.struct("doc_id", "text").alias("doc")), half, ("key",))
    full = stream.mapInArrow(partial(_full_level, length=length), "key long, check long, grp long, lo long, hi long")
    same = Window.partitionBy("key", "check")
    full = full.withColumns({"lo": F.min("lo").over(same), "hi": F.max("hi").over(same)}).filter("lo < hi").select("grp", "key", "check", "lo")
    return materialize(full, "windows")


def dedup_substrings(docs: DataFrame, length: int = WINDOW, digest: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts in a document with a smaller doc_id.

    Returns the columns of ``docs`` with the text cut, n_words and n_removed; with ``digest``, doc_id, both counts and
    kept_sha256 (kept words joined by one space) in place of the columns. Windows are judged on the input.

    A null text has no words and stays null; a null doc_id is never smaller than another, and its document stays
    whole; rows that repeat a doc_id count as one document's, and are one task's work; an empty table stays empty.
    Columns named like the results are replaced.
    """
    attach(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    columns = ["doc_id"] if digest else docs.columns
    docs = docs.select("doc_id", "text") if digest else docs
    kept = docs.select(*columns).schema.add("n_words", "long").add("n_removed", "long")
    if digest:
        kept = kept.add("kept_sha256", "string")
    found = repeated_windows(docs, length)
    numbered = docs.filter("doc_id is not null")
    stream = _streamed(numbered.select(_group().alias("grp"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), found, ("key", "check", "lo"))
    cut = stream.mapInArrow(partial(_last, length=length, digest=digest, columns=columns), kept)
    plain = docs.filter("doc_id is null").mapInArrow(partial(_unnumbered, length=length, digest=digest, columns=columns), kept)
    return cut.unionByName(plain)


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for _, table, part in _told(batches, ("key", "check", "lo")):
        if not len(table[0]):
            continue
        ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        words = Words(*utf8(part.column("text")))
        start, _, low = _windows(words, length)
        key, check = _full(low, start, length)
        text = words.text[start]
        at = _at(key, check, table) >= 0
        place = start - words.first[text]
        yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (rows[text], ids[text], place, key, check)], names=["row", "doc_id", "at", "key", "check"])


def repeated_places(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """Where windows of ``length`` words stand that start in more than one document: row, doc_id, at (word), key, check."""
    found = repeated_windows(docs, length)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    rows = rows.select(_group().alias("grp"), F.struct("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).alias("doc"))
    return _streamed(rows, found, ("key", "check", "lo")).mapInArrow(partial(_places, length=length), "row long, doc_id long, at long, key long, check long").distinct()


def extended(places: DataFrame, length: int) -> DataFrame:
    """Of surviving places of windows of ``length`` words, those whose window of twice that length repeats too.

    Only the survivors are looked at: a place goes on if the place ``length`` words behind it survived as well.
    """
    behind = places.select("row", (F.col("at") - length).alias("at"), F.col("key").alias("k2"), F.col("check").alias("c2"))
    both = places.join(behind, ["row", "at"]).select("row", "doc_id", "at", F.xxhash64("key", "k2").alias("key"), F.xxhash64("check", "c2", "key").alias("check"))
    both = materialize(both, "longer")
    again = both.groupBy("key", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key", "check")
    return materialize(both.join(again.hint("merge"), ["key", "check"]).select("row", "doc_id", "at", "key", "check"), "places")


def repeated_lengths(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """How many windows repeat at each length, doubling from ``length`` until none does: length, n_windows.

    Null texts and null doc_ids take no part; rows that repeat a doc_id and a text count once; an empty table gives
    one row with no windows. The texts are read for the first length only.
    """
    spark = docs.sparkSession
    attach(spark)
    places, out = materialize(repeated_places(docs, length), "places"), []
    while True:
        n = places.select("key", "check").distinct().count()
        out.append((length, n))
        if not n:
            return spark.createDataFrame(out, "length int, n_windows long")
        places, length = extended(places, length), 2 * length


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words that an earlier document has."""
    return dedup_substrings(documents(spark, sf_dir, "doc_id", "text"), digest=True)
