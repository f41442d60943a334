"""Packing token sequences: bounded-space online best-fit, leftovers merged at the end.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; its rest goes into the
open window that it fills best. When none fits, the fullest window is topped up with a cut of the rest, where both
parts are long enough to be worth it, and emitted; a new window opens for what is left. Windows still open at a
partition's end are poured together there, and the one that stays partly filled is merged with those of neighbouring
partitions, again by best fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import attach, documents, materialize, slices, text_or_empty
from plumbline.llm.bpe import SLICE_BYTES, automaton, default_vocabulary

WINDOW = 1024
OPEN_WINDOWS = 64
#: Shortest part that a cut may leave.
LEAST_CUT = 32
#: Partitions whose last windows are merged together.
MERGED_PARTITIONS = 64
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """The open windows of one partition. Pieces: (document, start, ids as bytes, document's length)."""

    def __init__(self, first_id: int, window: int, open_windows: int, least_cut: int):
        self.next_id, self.window, self.open_windows, self.least_cut = first_id, window, open_windows, least_cut
        self.free: list[tuple[int, int]] = []  # (room, window's id), by room
        self.held: dict[int, list] = {}
        self.out: list[list] = [[] for _ in _NAMES]

    def _emit(self, pieces: list) -> None:
        offset, sequence = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            for column, value in zip(self.out, (doc, start, n, zlib.crc32(ids), total, sequence, offset), strict=True):
                column.append(value)
            offset += n

    def add(self, doc, ids: memoryview) -> None:
        total, step = len(ids) // 4, self.window * 4
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self._emit([(doc, at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            self._place((doc, whole // 4, bytes(ids[whole:]), total))

    def _place(self, piece) -> None:
        doc, start, ids, total = piece
        n = len(ids) // 4
        at = bisect_left(self.free, (n, -1))
        if at < len(self.free):
            room, key = self.free.pop(at)
            self.held[key].append(piece)
            if room == n:
                self._emit(self.held.pop(key))
            else:
                insort(self.free, (room - n, key))
            return
        if len(self.free) >= self.open_windows:
            room, key = self.free.pop(0)
            pieces = self.held.pop(key)
            if room >= self.least_cut and n - room >= self.least_cut:
                pieces.append((doc, start, ids[: room * 4], total))
                start, ids = start + room, ids[room * 4 :]
                self._emit(pieces)
                self._place((doc, start, ids, total))
                return
            self._emit(pieces)
        key = self.next_id
        self.next_id += 1
        self.held[key] = [(doc, start, ids, total)]
        insort(self.free, (self.window - n, key))

    def finish(self) -> list:
        """Pour the open windows together; the pieces of the one that isn't full."""
        rest, filled = [], 0
        for piece in [p for key in sorted(self.held) for p in self.held[key]]:
            doc, start, ids, total = piece
            while filled + len(ids) // 4 >= self.window:
                take = (self.window - filled) * 4
                self._emit([*rest, (doc, start, ids[:take], total)])
                start, ids, rest, filled = start + take // 4, ids[take:], [], 0
            if ids:
                rest.append((doc, start, ids, total))
                filled += len(ids) // 4
        self.held, self.free = {}, []
        return rest

    def flush(self, open_: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * len(_NAMES)
        arrays = [pa.array(c, k) for c, k in zip(self.out, kinds, strict=True)]
        n = len(self.out[0])
        self.out = [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([open_] * n, pa.bool_())], names=[*_NAMES, "unfilled"])


def _with_end(ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """All documents' ids, each followed by the end id, as bytes; the documents' byte offsets."""
    n = len(ends) - 1
    out = np.full(len(ids) + n, END_ID, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
    return memoryview(out.tobytes()), (ends + np.arange(n + 1)) * 4


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, open_windows: int, least_cut: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    machine = automaton(vocabulary)
    packer = Packer(TaskContext.get().partitionId() << 36, window, open_windows, least_cut)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, at = _with_end(*machine.encode_texts(part.column("text")))
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                packer.add(doc, data[at[i] : at[i + 1]])
            yield packer.flush(False)
    rest = packer.finish()
    yield packer.flush(False)
    if rest:
        packer._emit(rest)
        yield packer.flush(True)


def _merge(pdf, window: int):
    """Best fit, largest first, of partly filled sequences; pieces keep their order within one."""
    import pandas as pd

    fills = pdf.groupby("sequence_id")["length"].sum().sort_index().sort_values(ascending=False, kind="stable")
    room: list[tuple[int, int]] = []
    moved: dict[int, tuple[int, int]] = {}
    for sequence, n in fills.items():
        at = bisect_left(room, (int(n), -1))
        if at < len(room):
            free, into = room.pop(at)
        else:
            free, into = window, int(sequence)
        moved[int(sequence)] = (into, window - free)
        insort(room, (free - int(n), into))
    into = pdf["sequence_id"].map(lambda s: moved[s][0])
    offset = pdf["offset"] + pdf["sequence_id"].map(lambda s: moved[s][1])
    return pd.DataFrame({**{c: pdf[c] for c in _NAMES}, "sequence_id": into, "offset": offset})[_NAMES]


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids (columns: see PIECES).

    A null text is empty and still gives its end id; a null doc_id stays null; repeated rows are packed as often as
    they come; an empty table gives no pieces; further columns are ignored. Sequence ids are unique in one run and
    depend on how the input is partitioned.
    """
    attach(docs.sparkSession)
    pieces = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        partial(_pack, vocabulary=vocabulary or default_vocabulary(), window=window, open_windows=open_windows, least_cut=least_cut), f"{PIECES}, unfilled boolean"
    )
    pieces = materialize(pieces, "pieces")
    group = F.shiftright("sequence_id", 36 + MERGED_PARTITIONS.bit_length() - 1)
    merged = pieces.filter("unfilled").groupBy(group.alias("partitions")).applyInPandas(lambda pdf: _merge(pdf, window), PIECES)
    return pieces.filter("not unfilled").drop("unfilled").unionByName(merged)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return pack(documents(spark, sf_dir, "doc_id", "text"))
