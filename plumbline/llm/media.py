"""Media columns: payloads stored as samples, types told by signature, embedded media carved.

Stored bytes are looked through by one Aho-Corasick automaton of magic bytes. A hit is only a candidate: a validator
of that format walks its structure and confirms its length. The type confirmed at the start corrects the declared one;
confirmed hits further in, outside of one another, are carved. What a walk has learnt about a place is kept for the hits
behind it, and compressed data is inflated a piece at a time and thrown away, so that a value's cost and memory stay in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import attach, documents, slices, text_or_empty

FRAME = 576
FILL = 255
RATE = 8000
SLICE_BYTES = 4 << 20

#: Magic bytes, where in the file they stand, and the type they suggest.
SIGNATURES = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit samples, one channel."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


def from_wav(stored: bytes) -> bytes:
    at = 12
    while stored[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", stored, at + 4)[0]
    return stored[at + 8 : at + 8 + struct.unpack_from("<I", stored, at + 4)[0]]


def framed(data: bytes) -> bytes:
    """Filled up to a positive multiple of FRAME bytes."""
    return data + bytes([FILL]) * ((-len(data)) % FRAME if data else FRAME)


# Validators: the type and length of a medium that starts at ``at``, or None. ``known`` is what earlier ones found in the value.


def _chain(known: dict, name: str, at: int, step) -> int | None:
    """Where a chain of parts ends. ``step(pos)``: the next part's place, or (None, the end or None) where there is none."""
    ends = known.setdefault(name, {})
    passed, pos = [], at
    while pos not in ends:
        passed.append(pos)
        following = step(pos)
        if isinstance(following, tuple):
            ends[pos] = following[1]
            break
        pos = following
    end = ends[pos]
    for p in passed:
        ends[p] = end
    return end


def _riff(b, at, known):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, kind = at + 8 + size, {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(bytes(form))
    if not kind or end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, pos)
        seen.add(name)
        pos += 8 + n + n % 2
    need = {"audio/wav": {b"fmt ", b"data"}}.get(kind, set())
    return (kind, end - at) if pos == end and seen and need <= seen else None


def _png(b, at, known):
    pos = at + 8
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if pos == at + 8 and name != b"IHDR" or pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos += 12 + n
        if name == b"IEND":
            return "image/png", pos - at
    return None


def _jpeg(b, at, known):
    pos, frame = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if mark == 0xDA:
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0xD9:
                    return ("image/jpeg", pos + 2 - at) if frame else None
                if b[pos + 1] != 0 and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
    return None


def _gif(b, at, known):
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    image = False
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return ("image/gif", pos + 1 - at) if image else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
            image = True
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _bmp(b, at, known):
    if at + 30 > len(b):
        return None
    size, zero, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = zero == 0 and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and header in (40, 52, 56, 108, 124) and width > 0 and height
    return ("image/bmp", size) if ok and 14 + header <= start <= size and at + size <= len(b) and start + (width * depth + 31) // 32 * 4 * abs(height) <= size else None


def _ogg(b, at, known):
    def step(pos):
        if b[pos : pos + 4] != b"OggS" or pos + 27 > len(b) or b[pos + 4]:
            return None, None
        end = pos + 27 + b[pos + 26] + sum(b[pos + 27 : pos + 27 + b[pos + 26]])
        return (None, None) if end > len(b) else (None, end) if b[pos + 5] & 4 else end

    end = _chain(known, "ogg", at, step)
    return ("audio/ogg", end - at) if end else None


def _flac(b, at, known):
    pos = at + 4
    while pos + 4 <= len(b):
        head, n = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if pos == at + 4 and (head & 0x7F or n != 34):
            return None
        pos += 4 + n
        if head & 0x80:
            return ("audio/flac", len(b) - at) if pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] >> 2 == 0x3E else None
    return None


def _mp4(b, at, known):
    boxes, told = known.setdefault("moov", {}), known.setdefault("told", set())  # where a box starts: whether a moov is at it or behind it

    def step(pos):
        if pos + 8 > len(b):
            return None, pos
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n < 8 or pos + n > len(b) or not kind.isalnum():
            return None, pos
        boxes[pos] = kind == b"moov"
        return pos + n

    first = at not in boxes
    end = _chain(known, "mp4", at, step)
    if first and end > at:
        places, pos = [], at
        while pos < end and pos not in told:
            places.append(pos)
            pos += struct.unpack_from(">I", b, pos)[0]
        behind = pos < end and boxes[pos]
        for p in reversed(places):
            behind = boxes[p] = boxes[p] or behind
        told.update(places)
    return ("video/mp4", end - at) if end > at and b[at + 4 : at + 8] == b"ftyp" and boxes.get(at) else None


def _pdf(b, at, known):
    end = known.get("eof", at - 1)  # -1: none behind what was looked through
    if end < at and "eof" not in known or 0 <= end < at:
        end = known["eof"] = b.find(b"%%EOF", at)
        known["xref"] = b.rfind(b"startxref", at, end) if end >= 0 else -1
    return ("application/pdf", end + 5 - at) if end >= 0 and known["xref"] >= at else None


def _zip(b, at, known):
    def described(data):
        """The end of an entry whose sizes stand behind its data."""
        found = b.find(b"PK\x07\x08", data)
        while 0 <= found <= len(b) - 16:
            if struct.unpack_from("<I", b, found + 8)[0] == found - data:
                return found + 16
            found = b.find(b"PK\x07\x08", found + 4)
        return None, None

    def step(pos):
        name = b[pos : pos + 4]
        if name == b"PK\x03\x04" and pos + 30 <= len(b):
            flags, size, names = struct.unpack_from("<H", b, pos + 6)[0], struct.unpack_from("<I", b, pos + 18)[0], sum(struct.unpack_from("<HH", b, pos + 26))
            return described(pos + 30 + names) if flags & 8 and not size else pos + 30 + names + size
        if name == b"PK\x01\x02" and pos + 46 <= len(b):
            return pos + 46 + sum(struct.unpack_from("<HHH", b, pos + 28))
        if name != b"PK\x05\x06" or pos + 22 > len(b):
            return None, None
        return None, pos + 22 + struct.unpack_from("<H", b, pos + 20)[0]

    end = _chain(known, "zip", at, step)
    return ("application/zip", end - at) if end and end <= len(b) else None


PIECE = 1 << 16


def _past_nul(b, at, known):
    """Behind the first zero byte from ``at``; None where there is none."""
    start, nul = known.get("nul", (at, at - 1))  # the first zero byte from ``start``; -1: none
    if at < start and (sooner := b.find(b"\0", at, start)) >= 0:
        return sooner + 1
    if "nul" not in known or 0 <= nul < at:
        nul = b.find(b"\0", at)
        known["nul"] = at, nul
    return nul + 1 if nul >= 0 else None


def _gzip(b, at, known):
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        pos += 2 + struct.unpack_from("<H", b, pos)[0]
    for flag in (8, 16):
        pos = _past_nul(b, pos, known) if pos and flags & flag else pos
    if pos is None:
        return None
    pos += flags & 2
    machine, view, step, crc, size = zlib.decompressobj(-15), memoryview(b), 256, 0, 0
    try:
        while not machine.eof:
            fed = machine.unconsumed_tail or view[pos : pos + step]
            if not machine.unconsumed_tail:
                pos, step = min(pos + step, len(b)), min(step * 4, PIECE)
            out = machine.decompress(fed, PIECE)
            crc, size = zlib.crc32(out, crc), size + len(out)
            if not out and not len(fed):
                return None
    except zlib.error:
        return None
    end = pos - len(machine.unused_data) + 8
    return ("application/gzip", end - at) if end <= len(b) and struct.unpack_from("<II", b, end - 8) == (crc, size & 0xFFFFFFFF) else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}

_machine = None


def _automaton():
    global _machine
    if _machine is None:
        import ahocorasick

        _machine = ahocorasick.Automaton()
        for magic, at, kind in SIGNATURES:
            _machine.add_word(magic.decode("latin-1"), (len(magic) - 1 + at, kind))
        _machine.make_automaton()
    return _machine


def sniff(stored: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type confirmed at the start (None if none), and (type, offset, length) of media carved further in."""
    declared, whole, carved, until, known = None, 0, [], 0, {}
    for end, (back, guess) in _automaton().iter(stored.decode("latin-1")):
        at = end - back
        if at < 0 or at and at < until:
            continue
        if found := VALIDATORS[guess](stored, at, known):
            if at == 0:
                declared, whole = found
            elif found[0] != declared or at + found[1] != whole:  # a part of the medium itself is nothing carved
                carved.append((found[0], at, found[1]))
                until = at + found[1]
    return declared, carved


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = [x.encode() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(framed(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "carved"]
    for batch in batches:
        for part in slices(batch, "media", SLICE_BYTES):
            out: list[list] = [[] for _ in names[2:]]
            for stored in part.column("media").to_pylist():
                payload = from_wav(stored)
                kind, carved = sniff(stored)
                samples = np.frombuffer(payload, np.uint8)
                high = samples > 127
                crossings = int(np.count_nonzero(high[1:] != high[:-1]))
                loud = int(np.abs(samples.astype(np.int16) - 128).sum(dtype=np.int64))
                feature = f"{kind};samples={len(samples)};sum={int(samples.sum(dtype=np.int64))};loud={loud};crossings={crossings};carved={len(carved)}"
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, kind, [{"type": t, "offset": a, "length": n} for t, a, n in carved])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's framed UTF-8 bytes as the samples of a WAV file. A null text is empty."""
    attach(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, read back from their bytes, the confirmed type, and what was carved.

    Works on what ``store_payloads`` gives. A null doc_id stays null; repeated rows give repeated results; an empty
    table gives none; further columns are ignored.
    """
    attach(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, carved array<struct<type:string,offset:long,length:long>>",
    )


def sniff_types(df: DataFrame, column: str, declared: str | None = None, out: str = "media") -> DataFrame:
    """``df`` with a struct ``out``: type (confirmed, else declared), corrected (whether that differs), carved media.

    Null bytes have no type of their own and nothing to carve; empty ones neither; repeated rows give repeated results; an
    empty table gives none; a column named ``out`` is replaced.
    """
    attach(df.sparkSession)
    kind = "type string, corrected boolean, carved array<struct<type:string,offset:long,length:long>>"

    @F.pandas_udf(kind)
    def told(data, given):
        import pandas as pd

        rows = []
        for b, d in zip(data, given, strict=True):
            found, carved = sniff(bytes(b)) if b is not None else (None, [])
            rows.append((found or d, found is not None and found != d, [{"type": t, "offset": a, "length": n} for t, a, n in carved]))
        return pd.DataFrame(rows, columns=["type", "corrected", "carved"])

    return df.withColumn(out, told(F.col(column), F.col(declared) if declared else F.lit(None).cast("string")))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents as media and compute features of what was stored."""
    return media_features(store_payloads(documents(spark, sf_dir, "doc_id", "text")))
