"""Byte-level BPE by a deterministic automaton over tokens.

Each merge rule ``(u, v) -> w`` adds one gadget to the automaton: in the state entered by ``u`` the arc ``v``
is removed, and an arc ``w`` is added from every state that had the path ``u v``; it enters the state that ``v``
enters at that time. After all rules exactly one path spells a word, and its arcs are the word's tokens.

States are kept copy-on-write, as that is what a gadget makes: the state of ``w`` is the state of ``v`` as of the
rule's time less later removals, and arc ``w`` leaves the states that arc ``u`` leaves as of then. So the tables hold
one removal and one (left, right, time) entry per rule, and an arc test walks these entries: from pair (x, y) to the
pair it was copied from, until a removal that came in time (no arc) or two bytes (arc). Words are pre-split, made
distinct, and all distinct words of a slice step through the tables together. Words are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.llm._common import PACKED, attach, documents, mixed, packed, slices, spread, text_or_empty, utf8

#: Words that one worker keeps encoded; beyond it the cache starts anew. Speed only.
CACHE_WORDS = 800_000
#: Bytes of kept words of more than PACKED bytes.
CACHE_BYTES = 8 << 20
SLICE_BYTES = 3 << 20
#: Words of more bytes are walked one by one, each byte once.
LONG_WORD = 1024
#: Arc tests that a worker remembers for them.
ARCS = 200_000

_NEVER = np.int64(1) << 40
_P1 = 0x9E3779B97F4A7C15 | 1
_LONG = 255 << 56


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Table:
    """Integer keys to values by open addressing; lookups are vectorised."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            took, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[took], self.values[took] = keys[put], values[put]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(_P1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys):
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """Per code point: 0 letter, 1 number, 2 other, 3 white space."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            out[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    return out


class Automaton:
    """Compiled tables of one vocabulary file, its pre-splitter, and the encoder that uses them."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, letters = spec["model"], _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {k: v for k, v in vocab.items() if k not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        labels = [b""] * size
        for k, v in ids.items():
            labels[v] = bytes(letters[c] for c in k)
        for k, v in self.special.items():
            labels[v] = k.encode()
        self.label_length = np.array([len(x) for x in labels], np.int64)
        self.label_start = np.concatenate(([0], np.cumsum(self.label_length)[:-1]))
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        # one gadget per rule
        self.size = size
        self.time = np.full(size, -1, np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        removed, at = [], []
        for k, rule in enumerate(model["merges"]):
            u, v = rule if isinstance(rule, list) else rule.split(" ")
            w = ids[u + v]
            self.left[w], self.right[w], self.time[w] = ids[u], ids[v], k
            removed.append(ids[u] * size + ids[v])
            at.append(k)
        self.removed = _Table(removed, at)
        # labels as a trie, so that a word's bytes lead to the arcs that spell them
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for label, v in sorted((labels[v], v) for v in ids.values()):
            node = 0
            for b in label:
                nxt = nodes.get((node, b))
                if nxt is None:
                    nxt = nodes[node, b] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = v
        self.trie = _Table([a << 8 | b for a, b in nodes], list(nodes.values()))
        self.token_of = np.array(token, np.int64)
        self.kind = _classes()
        self.alone = None  # made when the first long word comes
        self._fresh()

    def _fresh(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and where their words stand
        self.pair = np.zeros((2, 0), np.uint64)  # the words themselves, as numbers
        self.long_words: dict[bytes, int] = {}
        self.long_bytes = 0
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def has_arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the state entered by token x has an arc y."""
        out = np.ones(len(x), bool)
        alive = np.arange(len(x))
        until = np.full(len(x), _NEVER, np.int64)
        x, y = x.copy(), y.copy()
        while len(alive):
            gone = self.removed.get(x * self.size + y)
            dead = (gone >= 0) & (gone < until)
            out[alive[dead]] = False
            tx, ty = self.time[x], self.time[y]
            more = ~dead & ((tx >= 0) | (ty >= 0))
            alive, x, y, tx, ty = alive[more], x[more], y[more], tx[more], ty[more]
            # the state of x was copied before its rule's removal, arc y was added after its rule's removal
            until = np.where(ty > tx, ty + 1, tx)
            x, y = np.where(tx >= ty, self.right[x], x), np.where(ty >= tx, self.left[y], y)
        return out

    def split(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions at which words start, and for each text the index of its first word."""
        raw = np.frombuffer(data, np.uint8)
        begins = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(chars)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.kind[chars]
        starts = np.empty(n, bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        first = np.searchsorted(begins, offsets)  # in characters
        unit = np.zeros(n + 1, bool)
        unit[first] = True
        starts |= unit[:n]
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~unit[1:n])  # white space before a word of its text
        starts[last] = True
        starts[last[chars[last] == 32] + 1] = False
        at = np.flatnonzero((chars == 39) & starts)
        if len(at):
            end = np.searchsorted(first, at, side="right")
            end = np.where(end < len(first), first[np.minimum(end, len(first) - 1)], n)
            padded = np.concatenate((chars, np.zeros(2, np.uint32)))
            a, b = padded[at + 1], padded[at + 2]
            one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)) & (at + 1 < end)
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (at + 2 < end)
            starts[at[one | two] + 1] = False
            nxt = np.concatenate((at[one] + 2, at[two] + 3))
            starts[nxt[nxt < n]] = True
        words = np.flatnonzero(starts)
        return begins[words], np.searchsorted(words, first)

    def _identity(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Two numbers of each word that no other word has: its bytes, or its place among the long words met so far."""
        a, b = packed(np.frombuffer(data, np.uint8), starts, lengths)
        for i in np.flatnonzero(lengths > PACKED).tolist():
            word = data[starts[i] : starts[i] + lengths[i]]
            place = self.long_words.get(word)
            if place is None:
                place = self.long_words[word] = len(self.long_words)
                self.long_bytes += len(word)
            a[i], b[i] = place, _LONG
        return np.stack((a, b))

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and each text's offset in them. Special tokens' strings are not treated here."""
        starts, first = self.split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        if len(self.known) > CACHE_WORDS or self.long_bytes > CACHE_BYTES:
            self._fresh()
        pair = self._identity(data, starts, lengths)
        h = mixed(pair[0] ^ mixed(pair[1]))
        distinct, index, which = _distinct(h)
        odd = np.flatnonzero((pair != pair[:, index][:, which]).any(axis=0))  # equal hash, other word: each such word on its own
        if len(odd):
            which[odd] = len(distinct) + np.arange(len(odd))
            index = np.concatenate((index, odd))
        rows = self._rows(data, h[index], pair[:, index], starts[index], lengths[index], len(distinct))
        per_word = rows[which]
        count = self.count[per_word]
        ids = self.flat[spread(self.start[per_word], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, ends[first]

    def _rows(self, data, h, pair, starts, lengths, plain: int) -> np.ndarray:
        """Where each distinct word's tokens stand in the cache; unknown words are encoded first."""
        rows = np.full(len(h), -1, np.int64)
        hit = np.zeros(len(h), bool)
        if len(self.known):
            slot = np.minimum(np.searchsorted(self.known, h[:plain]), len(self.known) - 1)
            rows[:plain] = self.row[slot]
            hit[:plain] = (self.known[slot] == h[:plain]) & (self.pair[:, rows[:plain]] == pair[:, :plain]).all(axis=0)
        new = np.flatnonzero(~hit)
        if len(new):
            flat, count = self._encode_words(np.frombuffer(data, np.uint8), starts[new], lengths[new])
            base = len(self.count)
            rows[new] = base + np.arange(len(new))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
            self.pair = np.concatenate((self.pair, pair[:, new]), axis=1)
            add = new[new < plain]
            slot = np.searchsorted(self.known, h[add])
            self.known, self.row = np.insert(self.known, slot, h[add]), np.insert(self.row, slot, rows[add])
        return rows

    def _encode_words(self, raw, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Walk all words through the automaton in lockstep; long ones by themselves, as lockstep pays for many words only."""
        order = np.argsort(lengths, kind="stable")
        outs, at = [], 0
        counts = np.zeros(len(starts), np.int64)
        short = int(np.searchsorted(lengths[order], LONG_WORD, side="right"))
        for i in order[short:].tolist():
            tokens = self._walk_alone(raw[starts[i] : starts[i] + lengths[i]].tobytes())
            counts[i] = len(tokens)
            outs.append(tokens)
        longs, outs = outs, []
        while at < short:
            total = np.cumsum(lengths[order[at:short]])
            to = at + max(1, int(np.searchsorted(total, 1 << 20)))
            part = order[at:to]
            flat, count = self._walk(raw, starts[part], lengths[part])
            counts[part] = count
            outs.append(flat)
            at = to
        flat = np.concatenate([*outs, *longs])
        begin = np.zeros(len(starts), np.int64)
        sorted_counts = counts[order]
        begin[order] = np.cumsum(sorted_counts) - sorted_counts
        return flat[spread(begin, counts)], counts

    def _arc_test(self):
        """``has_arc`` of one pair, with what was asked before."""
        keys = self.removed.keys >= 0
        removed = dict(zip(self.removed.keys[keys].tolist(), self.removed.values[keys].tolist(), strict=True))
        time, left, right, size, seen = self.time.tolist(), self.left.tolist(), self.right.tolist(), self.size, {}

        def test(x: int, y: int) -> bool:
            asked = x * size + y
            found = seen.get(asked)
            if found is None:
                if len(seen) > ARCS:
                    seen.clear()
                until = _NEVER
                while found is None:
                    gone = removed.get(x * size + y, -1)
                    tx, ty = time[x], time[y]
                    if 0 <= gone < until:
                        found = False
                    elif tx < 0 and ty < 0:
                        found = True
                    else:
                        until = ty + 1 if ty > tx else tx
                        x, y = right[x] if tx >= ty else x, left[y] if ty >= tx else y
                seen[asked] = found
            return found

        return test

    def _walk_alone(self, word: bytes) -> np.ndarray:
        """The tokens of one long word, byte by byte, in time and memory that grow with its length."""
        if self.alone is None:
            keys = self.trie.keys >= 0
            self.alone = dict(zip(self.trie.keys[keys].tolist(), self.trie.values[keys].tolist(), strict=True)), self.token_of.tolist(), self._arc_test()
        trie, token_of, has_arc = self.alone
        into = array("i", [-1]) * len(word)  # the token that ends the only path to here, kept at its last byte
        before = -1
        for p in range(len(word)):
            if p:
                before = into[p - 1]
                if before < 0:
                    continue
            node, q = 0, p
            while q < len(word) and (node := trie.get(node << 8 | word[q], -1)) >= 0:
                t = token_of[node]
                if t >= 0 and (before < 0 or has_arc(before, t)):
                    into[q] = t
                q += 1
        out, at = array("i"), len(word)
        lengths = self.label_length
        while at:
            out.append(into[at - 1])
            at -= int(lengths[into[at - 1]])
        return np.array(out, np.int64)[::-1]

    def _walk(self, raw, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        text = raw[spread(starts, lengths)].astype(np.int64)
        ends = np.cumsum(lengths)
        base = ends - lengths
        total = len(text)
        left = np.repeat(ends, lengths) - np.arange(total)  # bytes to the word's end
        # arcs (position, token) that spell the bytes from a position
        node = np.zeros(total, np.int64)
        live = np.arange(total)
        arcs_at, arcs_token = [], []
        step = 0
        while len(live):
            node = self.trie.get(node << 8 | text[live + step])
            ok = node >= 0
            live, node = live[ok], node[ok]
            t = self.token_of[node]
            arcs_at.append(live[t >= 0])
            arcs_token.append(t[t >= 0])
            step += 1
            more = left[live] > step
            live, node = live[more], node[more]
        at, token = np.concatenate(arcs_at), np.concatenate(arcs_token)
        place = at - np.repeat(base, lengths)[at]
        order = np.argsort(place, kind="stable")
        at, token, place = at[order], token[order], place[order]
        bounds = np.searchsorted(place, np.arange(int(lengths.max()) + 1))
        into = np.full(total + 1, -1, np.int64)  # the token that ends the only path to here, kept at its last byte
        for p in range(int(lengths.max())):
            a, t = at[bounds[p] : bounds[p + 1]], token[bounds[p] : bounds[p + 1]]
            if p:
                ok = into[a - 1] >= 0
                a, t = a[ok], t[ok]
                ok = self.has_arc(into[a - 1], t)
                a, t = a[ok], t[ok]
            into[a + self.label_length[t] - 1] = t
        # back along the path
        here, word = ends.copy(), np.arange(len(starts))
        got_word, got_token = [], []
        while len(word):
            t = into[here - 1]
            got_word.append(word)
            got_token.append(t)
            here = here - self.label_length[t]
            more = here > base[word]
            word, here = word[more], here[more]
        rounds = np.repeat(np.arange(len(got_word)), [len(x) for x in got_word])
        words, tokens = np.concatenate(got_word), np.concatenate(got_token)
        order = np.lexsort((-rounds, words))
        return tokens[order], np.bincount(words, minlength=len(starts)).astype(np.int64)

    def encode_texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column and each text's offset; special tokens' strings become their ids."""
        data, offsets = utf8(column)
        if not any(s.encode() in data for s in self.special):
            return self.encode(data, offsets)
        import re

        cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
        ids, ends = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text, at, n = data[a:b], 0, 0
            parts = []
            for m in cut.finditer(text):
                parts += [text[at : m.start()], self.special[m[0].decode()]]
                at = m.end()
            for part in [*parts, text[at:]]:
                got = np.array([part], np.int32) if isinstance(part, int) else self.encode(part, np.array([0, len(part)]))[0]
                ids.append(got)
                n += len(got)
            ends.append(ends[-1] + n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(ends, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        ids = np.asarray(ids, np.int64)
        return self.label_bytes[spread(self.label_start[ids], self.label_length[ids])].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", errors="replace")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, an index of each, and each key's place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.empty(len(keys), bool)
    fresh[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], which


_compiled: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The compiled vocabulary; once per Python worker."""
    if path not in _compiled:
        _compiled[path] = Automaton(path)
    return _compiled[path]


def encode_decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    machine = automaton(vocabulary)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, ends = machine.encode_texts(part.column("text"))
            wide = ids.astype("<u4")
            # labels of all documents at once, then cut where documents end
            spelled = machine.decode(ids)
            at = np.concatenate(([0], np.cumsum(machine.label_length[ids])))[ends]
            id_hash, text_hash = [], []
            for i in range(part.num_rows):
                id_hash.append(hashlib.sha256(wide[ends[i] : ends[i + 1]]).hexdigest())
                text_hash.append(hashlib.sha256(spelled[at[i] : at[i + 1]].decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_column(df: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array<int> column; a null text is the empty text (no ids)."""
    from functools import partial

    attach(df.sparkSession)
    schema = df.drop(out).schema.add(out, T.ArrayType(T.IntegerType()))
    return df.drop(out).mapInArrow(partial(_encode_batches, vocabulary=vocabulary or default_vocabulary(), text=text, out=out), schema)


def _encode_batches(batches, vocabulary, text, out):
    machine = automaton(vocabulary)
    for batch in batches:
        for part in slices(batch, text, SLICE_BYTES):
            ids, ends = machine.encode_texts(part.column(text))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])


def decode_column(df: DataFrame, vocabulary: str | None = None, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``df`` with the text that ``ids`` spell; null or no ids give the empty text, bytes that are no UTF-8 become U+FFFD."""
    from functools import partial

    attach(df.sparkSession)
    schema = df.drop(out).schema.add(out, "string")
    return df.drop(out).mapInArrow(partial(_decode_batches, vocabulary=vocabulary or default_vocabulary(), ids=ids, out=out), schema)


def _decode_batches(batches, vocabulary, ids, out):
    machine = automaton(vocabulary)
    for batch in batches:
        texts = [machine.decode_text(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digest of encoding and decoding every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (0 tokens, digests of nothing); a null doc_id stays null; repeated rows give
    repeated results; an empty table gives an empty result; further columns are ignored.
    """
    from functools import partial

    attach(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(encode_decode, vocabulary=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return round_trip(documents(spark, sf_dir, "doc_id", "text"))


def unpack_ids(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)
