"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints are made distinct first, so copies cost one row. Tables of keys bring those together that may be near:
``near_duplicates`` has 64 bits and a small radius r, cut into r + 2 blocks of which near fingerprints share two, so its
tables keyed by two blocks find every link. ``similar_texts`` has 1024 bits of five-word shingles, whose differing bits
tell the shingles' similarity, and finds partners by keys of 28 bits picked from a fingerprint of two-word shingles; an
exact comparison of the shingles inside each group found follows.

Within a bucket fingerprints are compared bit-sliced: one plane per bit position holds that bit of all members (or of
all pairs, for small buckets), differences go into carry-save counters that hold all distances at once, and a block is
abandoned as soon as all in it are too far. Every bucket is compared this way, whatever its size: beyond ``BUCKET``
members it is cut into parts, and each pair of parts is compared by itself. A bucket answers with a forest of its links,
not with pairs. Components come from alternating large-star and small-star steps on tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import attach, documents, materialize, mixed, slices, text_or_empty, utf8
from plumbline.llm.substring_dedup import Words, _doubled, _M1

SHINGLE = 3
RADIUS = 2
#: Members of a bucket, or of a pair of its parts, that one task compares.
BUCKET = 2048
#: Buckets of fewer members are compared pair by pair, many buckets at once.
SMALL = 33
#: Distances that are counted at once.
LANES = 1 << 13
SLICE_BYTES = 3 << 20
BITS = 64

#: Similar texts: bits of the fingerprint, of the one that keys are picked from, bits of a key, keys, keys of one round.
WIDE_BITS = 1024
KEYED_BITS, KEY_BITS, KEYS, ROUND = 256, 28, 96, 48
KEYED_SHINGLE = 2
#: Standard errors by which the estimated similarity may fall short, before shingles are compared.
MARGIN = 3.0
#: Texts, and shingles of theirs, that are compared exactly at once; larger groups are cut into pairs of parts.
GROUP, GROUP_SHINGLES = 512, 1 << 20
#: Shingles counted at once.
COLUMNS = 4096


def fingerprint(data: bytes, shingle: int, seed: int = 42) -> int:
    """Of one text in UTF-8, as an unsigned number."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter([digest(text[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, at = utf8(part.column("text"))
            at = at.tolist()
            found = [fingerprint(data[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*kept, "fp"])


def wide_bits(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprint of distinct shingle hashes, as 0 and 1: a bit is set if it is in over half of their mixes."""
    ones = np.zeros(bits, np.int64)
    turns = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):
        part = mixed(shingles[at : at + 255, None] + turns)
        each = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        ones += each.view(np.uint64).sum(axis=0).view(np.uint8)  # at most 255 to a byte
    return (ones * 2 > len(shingles)).astype(np.uint8)


@lru_cache
def key_bits() -> np.ndarray:
    """The bits that each key is picked from."""
    rng = np.random.default_rng(7)
    return np.stack([np.sort(rng.choice(KEYED_BITS, KEY_BITS, replace=False)) for _ in range(KEYS)])


def _wide_fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    powers = np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, at = utf8(part.column("text"))
            words = Words(data.lower(), at)  # bytes: A-Z only
            h = words.hashes()[0]
            n = part.num_rows
            kept = [c for c in part.schema.names if c != "text"]
            found, keyed = np.zeros((n, WIDE_BITS), np.uint8), np.zeros((n, KEYED_BITS), np.uint8)
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if a < b:
                    for out, k, bits in ((found, shingle, WIDE_BITS), (keyed, KEYED_SHINGLE, KEYED_BITS)):
                        out[i] = wide_bits(np.unique(_doubled(h[a:b], 1, min(k, b - a), _M1)), bits)
            fps = np.packbits(found, axis=1, bitorder="little")
            keys = (keyed[:, key_bits()].astype(np.int64) * powers).sum(axis=2)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * KEYS)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array([x.tobytes() for x in fps], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel(), pa.int64()))], names=[*kept, "fp", "keys"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, at = utf8(part.column("text"))
            words = Words(data.lower(), at)
            h = words.hashes()[0]
            sets = [np.unique(_doubled(h[a:b], 1, min(shingle, b - a), _M1)) if a < b else h[:0] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], names=["node", "s"])


def radius_of(similarity: float, bits: int = WIDE_BITS, margin: float = MARGIN) -> int:
    """Differing bits up to which two sets count as that similar (Jaccard), with ``margin`` standard errors of the estimate."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def planes_of(rows: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows of bytes): bit i of plane b is bit b of row i."""
    each = np.unpackbits(rows, axis=1, bitorder="little")
    filled = np.zeros((-(-len(rows) // 64) * 64, each.shape[1]), np.uint8)
    filled[: len(rows)] = each
    return np.ascontiguousarray(np.packbits(filled, axis=0, bitorder="little").T).view(np.uint64)


def _three(a, b, c):
    """A carry-save adder: three planes of one weight as one of that weight and one of twice it."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _above(count: list, limit: int):
    """Lanes whose counter is above ``limit``."""
    more, same = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(len(count) - 1, -1, -1):
        if limit >> i & 1:
            same = same & count[i]
        else:
            more = more | same & count[i]
            same = same & ~count[i]
    return more


def within(planes: np.ndarray, radius: int, pivots: np.ndarray | None = None) -> np.ndarray:
    """For each lane of ``planes`` (differences of pairs), or for each pivot (bytes) and lane, whether at most ``radius`` bits are set."""
    bits, width = planes.shape
    if pivots is not None:
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        flips = np.unpackbits(pivots, axis=1, bitorder="little").T[:, :, None] * full
        plane = lambda b: planes[b] ^ flips[b]
        shape = (len(pivots), width)
    else:
        plane = lambda b: planes[b]
        shape = (width,)
    levels = max(bits.bit_length(), 4)
    count = [np.zeros(shape, np.uint64) for _ in range(levels)]
    for at in range(0, bits, 8):
        p = [plane(b) for b in range(at, at + 8)]
        count[0], two_a = _three(count[0], p[0], p[1])
        count[0], two_b = _three(count[0], p[2], p[3])
        count[0], two_c = _three(count[0], p[4], p[5])
        count[0], two_d = _three(count[0], p[6], p[7])
        count[1], four_a = _three(count[1], two_a, two_b)
        count[1], four_b = _three(count[1], two_c, two_d)
        count[2], carry = _three(count[2], four_a, four_b)
        for i in range(3, levels):
            count[i], carry = count[i] ^ carry, count[i] & carry
            if not carry.any():
                break
        if at % 32 == 24 and at >= radius and _above(count, radius).min() == 0xFFFFFFFFFFFFFFFF:
            return np.zeros((*shape[:-1], width * 64), bool)
    near = ~_above(count, radius)
    return np.unpackbits(near.view(np.uint8), axis=-1, bitorder="little").astype(bool)


def _root(parent: dict[int, int], i: int) -> int:
    while (up := parent.setdefault(i, i)) != i:
        parent[i] = i = parent.setdefault(up, up)
    return i


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for pairs of nodes."""
    parent: dict[int, int] = {}
    for a, b in np.unique(pairs, axis=0).tolist():
        x, y = _root(parent, a), _root(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := _root(parent, x)) != x]


def link_bucket(rows: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node of its component inside the bucket) over all links; rows of one node are linked already.

    The members nearest to the bucket's majority are held against all first; those linked with the first of them need
    no turn of their own, as all others have one.
    """
    labels = nodes.copy()
    each = np.unpackbits(rows, axis=1, bitorder="little")
    middle = np.packbits(each.sum(axis=0, dtype=np.int64) * 2 > len(rows), bitorder="little")
    order = np.lexsort((nodes, np.bitwise_count(rows ^ middle).sum(axis=1, dtype=np.int64)))
    planes = planes_of(rows)
    turns = max(1, LANES // len(rows))
    todo = order
    while len(todo):
        now, todo = todo[:turns], todo[turns:]
        for i, hit in zip(now.tolist(), within(planes, radius, rows[now])[:, : len(rows)], strict=True):
            met = np.unique(labels[hit])
            if len(met) > 1:
                labels[np.isin(labels, met)] = met[0]
        todo = todo[labels[todo] != labels[order[0]]]
    return [(int(a), int(b)) for a, b in np.unique(np.stack((nodes, labels), axis=1), axis=0).tolist() if a != b]


@lru_cache(maxsize=64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _link_small(rows: np.ndarray, nodes: np.ndarray, starts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for many small buckets, whose first rows are at ``starts``: all pairs of each are lanes of one comparison."""
    sizes = np.diff(np.append(starts, len(nodes)))
    left, right = [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        a, b = _pairs(n)
        base = starts[sizes == n][:, None]
        left.append((base + a).ravel())
        right.append((base + b).ravel())
    if not left:
        return []
    left, right = np.concatenate(left), np.concatenate(right)
    other = nodes[left] != nodes[right]
    left, right = left[other], right[other]
    met = []
    for at in range(0, len(left), LANES):
        a, b = left[at : at + LANES], right[at : at + LANES]
        hit = within(planes_of(rows[a] ^ rows[b]), radius)[: len(a)]
        met.append(np.stack((nodes[a[hit]], nodes[b[hit]]), axis=1))
    return _forest(np.concatenate(met)) if met else []


def _blocks(radius: int) -> list[range]:
    """Bits in radius + 2 blocks: texts within the radius agree in two of them at least."""
    n = radius + 2
    return [range(i * BITS // n, (i + 1) * BITS // n) for i in range(n)]


def _tables(radius: int) -> list[tuple[range, range]]:
    blocks = _blocks(radius)
    return [(a, b) for i, a in enumerate(blocks) for b in blocks[i + 1 :]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Buckets come one after the other; the last of a batch may go on in the next."""
    names = ("tab", "bucket", "part", "node")
    held: list[np.ndarray] | None = None
    out: list[tuple[int, int]] = []

    def told(columns, fps, whole: bool):
        """Links of all buckets that have ended; the rows of the one that hasn't."""
        fresh = np.ones(len(fps), bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
        starts = np.flatnonzero(fresh)
        end = len(fps) if whole else int(starts[-1])
        starts = starts[starts < end]
        sizes = np.diff(np.append(starts, end))
        for a, n in zip(starts[sizes >= SMALL].tolist(), sizes[sizes >= SMALL].tolist(), strict=True):
            out.extend(link_bucket(fps[a : a + n], columns[3][a : a + n], radius))
        few = np.repeat(sizes < SMALL, sizes)
        lengths = sizes[sizes < SMALL]
        out.extend(_link_small(fps[:end][few], columns[3][:end][few], np.cumsum(lengths) - lengths, radius))
        return [c[end:] for c in (*columns, fps)]

    for batch in batches:
        if not batch.num_rows:
            continue
        fps = batch.column("fp")
        fps = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None and len(held[4]):
            *columns, fps = (np.concatenate(x) for x in zip(held, (*columns, fps), strict=True))
        held = told(columns, fps, False)
        if out:
            yield _edges(out)
            out = []
    if held is not None and len(held[4]):
        told(held[:4], held[4], True)
    yield _edges(out)


def _edges(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _links(reps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Edges (a, b), a > b, that join all fingerprints of one bucket at most ``radius`` bits apart.

    reps: fp (binary), own (its number), node (the smallest of those already joined), at: array of (tab, bucket). Only
    rows of buckets that hold several nodes fetch their fingerprint.
    """
    rows = reps.select("own", "node", F.explode("at").alias("at")).select("at.tab", "at.bucket", "own", "node")
    sizes = rows.groupBy("tab", "bucket").agg(F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most"))
    rows = rows.join(sizes.filter("least < most").select("tab", "bucket", "members").hint("merge"), ["tab", "bucket"])
    rows = rows.join(reps.select("own", "fp").hint("merge"), "own").drop("own")
    small = rows.filter(F.col("members") <= bucket).withColumn("part", F.lit(0).cast("long"))
    large = rows.filter(F.col("members") > bucket).withColumn("n", F.ceil(F.col("members") * 2 / F.lit(bucket)) + 1)
    dealt = small.unionByName(_in_parts(large, "fp"))
    dealt = dealt.select("tab", "bucket", "part", "fp", "node").repartition("tab", "bucket", "part").sortWithinPartitions("tab", "bucket", "part")
    return dealt.mapInArrow(partial(_compare, radius=radius), "a long, b long")


def _in_parts(large: DataFrame, by: str) -> DataFrame:
    """Large groups in pairs of their ``n`` parts, dealt by the column ``by``: every two members meet in one pair."""
    own = large.withColumn("own", F.pmod(F.xxhash64(by), F.col("n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return own.withColumn("other", other).withColumn("part", 1 + F.least("own", "other") * F.col("n") + F.greatest("own", "other")).drop("n", "own", "other")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b) other than the smallest ones.

    The joins are of written tables, with no aggregate in their stages, so that Spark can split a node of many edges.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = materialize(large.distinct(), "large-star")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable over links).

    A null text has no words and fingerprint zero; texts with fewer words than ``shingle`` are one shingle; a null
    doc_id keeps its row and joins its fingerprint's component (null if nothing else is in it); repeated rows stay, each
    with its own text's fingerprint and that one's component; an empty table gives no rows; further columns are ignored.
    """
    if not 0 <= radius <= 8:
        raise ValueError("the tables are for links of 0 to 8 bits")
    attach(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    found = materialize(rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long"), "fingerprints")
    reps = materialize(found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    links = _links(reps.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.col("node").alias("own"), "node", _places(radius).alias("at")), radius, bucket)
    named = _named(reps, "fp", components(links))
    return found.join(named.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _places(radius: int) -> F.Column:
    """The buckets of a 64-bit fingerprint: array of (tab, bucket)."""
    cut = lambda x: F.shiftrightunsigned("fp", x.start).bitwiseAND((1 << len(x)) - 1)
    return F.array(*[F.struct(F.lit(t).alias("tab"), (F.shiftleft(cut(x), len(y)) + cut(y)).alias("bucket")) for t, (x, y) in enumerate(_tables(radius))])


def _named(reps: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """The component of each distinct fingerprint, as a table."""
    return materialize(reps.join(labels.hint("merge"), "node", "left").select(key, F.coalesce("component", "node").alias("component_id")), "named")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    n = len(sets)
    values, rows = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(fresh)
    times = np.diff(np.append(starts, len(values)))
    rows = rows[np.repeat(times > 1, times)]
    times = times[times > 1]
    ends = np.cumsum(times)
    column = np.repeat(np.arange(len(times)), times)
    counts = np.zeros((n, n))
    for first in range(0, len(times), COLUMNS):
        last = min(first + COLUMNS, len(times))
        a, b = ends[first] - times[first], ends[last - 1]
        held = np.zeros((n, last - first), np.float32)
        held[rows[a:b], column[a:b] - first] = 1
        counts += held @ held.T
    return counts


def alike_in_group(nodes: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(node, smallest node of its component inside the group) over all pairs of sets that similar; two empty ones are alike."""
    size = np.array([len(x) for x in sets], np.float64)
    shared = _shared(sets)
    linked = shared >= least * (size[:, None] + size[None, :] - shared)
    labels, order = np.arange(len(nodes)), np.argsort(nodes)
    left = np.ones(len(nodes), bool)
    for i in order.tolist():
        todo = [i] if left[i] else []
        while todo:
            found = np.flatnonzero(linked[todo.pop()] & left)
            left[found] = False
            labels[found] = i
            todo.extend(found.tolist())
    return [(nodes[j], nodes[i]) for j, i in enumerate(labels.tolist()) if i != j]


def _hold_against(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Groups come one after the other; one is held at a time."""
    key, nodes, sets = None, [], []
    for batch in batches:
        values, ends = batch.column("s").values.to_numpy(), batch.column("s").offsets.to_numpy()
        rows = [batch.column(c).to_pylist() for c in ("component", "part", "node")]
        for i, (*place, node) in enumerate(zip(*rows, strict=True)):
            if place != key:
                if nodes:
                    yield _edges(alike_in_group(nodes, sets, least))
                key, nodes, sets = place, [], []
            nodes.append(node)
            sets.append(values[ends[i] : ends[i + 1]].copy())
    if nodes:
        yield _edges(alike_in_group(nodes, sets, least))


def _alike(reps: DataFrame, labels: DataFrame, docs: DataFrame, least: float, shingle: int, group: int) -> DataFrame:
    """Edges that join all texts of one component whose shingle sets have a Jaccard similarity of ``least`` or more.

    reps: node, text_id, one row for each distinct text. Every pair of a component is compared, in groups of up to
    about ``group`` texts and GROUP_SHINGLES shingles. A group answers with a forest, not with pairs.
    """
    named = reps.join(labels.hint("merge"), "node", "left").select("node", "text_id", F.coalesce("component", "node").alias("component"))
    several = materialize(named.groupBy("component").agg(F.count("*").alias("members")).filter("members > 1").select("component"), "several")
    members = materialize(named.join(several.hint("merge"), "component"), "members")
    held = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    held = held.join(members.select("node", "text_id").hint("shuffle_hash"), ["node", "text_id"], "left_semi").dropDuplicates(["node"])
    sets = materialize(held.select("node", "text").mapInArrow(partial(_shingle_sets, shingle=shingle), "node long, s array<long>"), "shingles")
    sized = members.select("node", "component").join(sets.select("node", F.size("s").alias("shingles")).hint("merge"), "node")
    sizes = sized.groupBy("component").agg(F.count("*").alias("members"), F.sum("shingles").alias("shingles"))
    times = F.greatest(F.col("members") / group, F.col("shingles") / GROUP_SHINGLES)
    sizes = materialize(sizes.select("component", F.when(times > 1, F.ceil(times * 2) + 1).otherwise(0).alias("n")), "sizes")
    placed = sized.select("node", "component").join(sizes.hint("merge"), "component")
    parts = placed.filter("n = 0").withColumn("part", F.lit(0).cast("long")).drop("n").unionByName(_in_parts(placed.filter("n > 0"), "node"))
    rows = materialize(parts, "parts").join(sets.hint("merge"), "node").select("component", "part", "node", "s")
    dealt = rows.repartition("component", "part").sortWithinPartitions("component", "part")
    return dealt.mapInArrow(partial(_hold_against, least=least), "a long, b long")


def candidates(reps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """node, component over links of fingerprints in one bucket; reps: fp, node, keys.

    Keys are looked at in rounds: what the rounds before have joined is one node, and buckets that hold one node only
    are left out. All links within a bucket count, however large it is.
    """
    labels = None
    for at in range(0, KEYS, ROUND):
        joined = reps.withColumn("own", F.col("node"))
        if labels is not None:
            joined = joined.join(labels.hint("merge"), "node", "left").withColumn("node", F.coalesce("component", "node"))
        places = F.transform(F.slice("keys", at + 1, ROUND), lambda k, i: F.struct((i + at).alias("tab"), k.alias("bucket")))
        links = materialize(_links(joined.select("fp", "own", "node", places.alias("at")), radius, bucket), "links")
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            labels = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return labels


def similar_texts(docs: DataFrame, least_similarity: float = 0.8, shingle: int = 5, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links of similar texts).

    Two texts are linked if their sets of ``shingle`` lower-cased words have a Jaccard similarity of
    ``least_similarity`` or more and fingerprints lead from one to the other: those that share a key and differ in no
    more bits than that similarity makes likely (``radius_of``). Of what fingerprints join, every pair is compared.

    A null text has no words; all texts without words are alike; texts of fewer words than ``shingle`` are one shingle;
    a null doc_id keeps its row and joins the component of its text's copies (null if there are none); repeated rows
    stay; an empty table gives no rows; further columns are ignored.
    """
    attach(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_id", F.xxhash64("text"))
    found = rows.select("doc_id", "text_id", "text").mapInArrow(partial(_wide_fingerprints, shingle=shingle), "doc_id long, text_id long, fp binary, keys array<long>")
    found = materialize(found, "fingerprints")
    first = found.filter("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "text_id", "keys")).alias("x"))
    reps = materialize(first.select("fp", F.col("x.doc_id").alias("node"), "x.text_id", "x.keys"), "distinct")
    near = candidates(reps.select("fp", "node", "keys"), radius_of(least_similarity), bucket)
    links = _alike(reps.select("node", "text_id"), near, docs, least_similarity, shingle, group)
    named = _named(reps, "fp", components(links))
    return found.select("doc_id", "fp").join(named.hint("merge"), "fp", "left").select("doc_id", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
