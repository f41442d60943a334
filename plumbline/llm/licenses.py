"""Licence scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by shunting-yard.

A text becomes its words (ASCII lower-cased, cut at ASCII characters that are no letters or digits), one space between.
One automaton run over that finds every phrase at once. Where it finds the identifier tag, the expression behind it is
read from the original line, turned into postfix order by a shunting-yard parser, and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm._common import attach, documents, slices, text_or_empty, utf8

SLICE_BYTES = 4 << 20

#: Phrases of the contract, as words, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases beyond these.
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "free documentation license": "gfdl",
}
TAG = "spdx license identifier"
#: How freely a work may be used, from 0 (reserved) to 1; by label or identifier family.
FREEDOM = {"public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gfdl": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.0}
UNKNOWN_FREEDOM = 0.5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TAG_LINE = re.compile(r"SPDX-License-Identifier:?[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def words_of(data: bytes) -> bytes:
    """The words of a text in UTF-8, each with a space before and behind."""
    words = data.translate(_LOWER).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def postfix(line: str) -> list[str]:
    """A licence expression in postfix order; reading ends where the line stops being one. Empty if none starts it."""
    out: list[str] = []
    held: list[str] = []
    operand, depth = False, 0
    good: tuple[int, list[str]] = 0, []  # how much of ``out``, and the operators behind it, make a whole expression
    at = 0
    while True:
        while at < len(line) and line[at] in " \t":
            at += 1
        m = _TOKEN.match(line, at)
        if not m:
            break
        token = m[0]
        word = token.lower()
        if token == "(":
            if operand:
                break
            held.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif word in _PRECEDENCE:
            if not operand:
                break
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
            at = m.end()
            continue
        else:
            if operand:
                break
            out.append(token)
        operand = token != "("
        at = m.end()
        if operand and not depth:
            good = len(out), held[::-1]  # outside brackets three operators at most are held
    return out[: good[0]] + good[1]


def family(identifier: str) -> str:
    """The label of a licence identifier: its name without version."""
    name = re.sub(r"(-v?\d[\d.]*)?(-only|-or-later|\+|-clause.*)*$", "", identifier.lower())
    return re.sub(r"-\d.*$", "", name) or identifier.lower()


def evaluate(expression: list[str]) -> tuple[float, list[str]]:
    """Freedom of a postfix expression (or: the freer side, and: the stricter, with: half way up from its licence) and its licences."""
    stack: list[float] = []
    names: list[str] = []
    for token in expression:
        if token in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b) if token == "and" else (a + 1) / 2)
            if token == "with":
                names.pop()  # an exception's name is no licence
        else:
            name = family(token)
            names.append(name)
            stack.append(FREEDOM.get(name, UNKNOWN_FREEDOM))
    return stack[0], names


_machine = None


def _automaton():
    global _machine
    if _machine is None:
        import ahocorasick

        _machine = ahocorasick.Automaton()
        for phrase, label in NOTICE_PHRASES.items():
            _machine.add_word(f" {phrase} ", (phrase, label, False))
        for phrase, label in BASE_PHRASES.items():
            _machine.add_word(f" {phrase} ", (phrase, label, True))
        _machine.add_word(f" {TAG} ", (TAG, "", False))
        _machine.make_automaton()
    return _machine


def scan(data: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text in UTF-8."""
    words = words_of(data)
    base, labels, starts, tagged = set(), set(), [], False
    at = word = 0  # a place in ``words``, and how many words stand before it
    for end, (phrase, label, of_base) in _automaton().iter(words.decode("latin-1")):
        if not label:
            tagged = True
            continue
        labels.add(label)
        if of_base:
            base.add(label)
            start = end - len(phrase) - 1
            word += words.count(b" ", at, start) if start >= at else -words.count(b" ", start, at)
            at = start
            starts.append(word)
    free = [FREEDOM[x] for x in labels]
    if tagged:
        for m in _TAG_LINE.finditer(data.decode("utf-8", "replace")):
            if expression := postfix(m[1]):
                value, names = evaluate(expression)
                free.append(value)
                labels.update(names)
    n = words.count(b" ") - 1
    return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - min(free), 6) if free else 0.0


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            data, at = utf8(part.column("text"))
            at = at.tolist()
            rows = [scan(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *_NAMES])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence findings of every text (columns: see RESULT).

    score: 0 where nothing was found, else 1 less the freedom of the strictest notice or expression (see FREEDOM).
    A null text is empty (no words, no labels, score 0); a null doc_id stays null; repeated rows give repeated
    results; an empty table gives none; further columns are ignored.
    """
    attach(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_scan, RESULT)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
