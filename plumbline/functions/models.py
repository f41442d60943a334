"""Model-backed columns. Models are injected; each is made once per Python worker and fed Arrow batches.

``embedding(make)``: make() -> embed(list[str]) -> rows of floats; ``reranking(make)``: make() -> score(query, passages);
``reading(make)``: make() -> read(bytes, hint) -> str, or None where no reader is set up; ``replying(make)``: make() ->
complete(system, user) -> str. The default embedder hashes character n-grams: the same text always gives the same unit
vector, near spellings near ones; it is no language model, so similarity thresholds have to be set for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DIMENSIONS = 256
GRAM = 3


def hashed_ngrams(texts: list[str], dimensions: int = DIMENSIONS, n: int = GRAM) -> np.ndarray:
    """Unit vectors of hashed character n-grams; an empty text gives zeros."""
    import zlib
    from itertools import chain

    spaced = [f" {' '.join(t.lower().split())} " for t in texts]
    grams = [[t[i : i + n] for i in range(len(t) - n + 1)] for t in spaced]
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    numbers: dict[str, int] = {}
    found = np.fromiter((numbers.setdefault(g, len(numbers)) for g in chain.from_iterable(grams)), np.int64, int(sizes.sum()))
    hashes = np.fromiter((zlib.crc32(g.encode()) for g in numbers), np.int64, len(numbers))[found]
    cells = np.repeat(np.arange(len(grams)), sizes) * dimensions + hashes % dimensions
    signs = np.where(hashes & 0x80000000, 1.0, -1.0)
    out = np.bincount(cells, signs, len(grams) * dimensions).reshape(-1, dimensions)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms > 0, norms, 1.0)).astype(np.float32)


def embedding(make: Callable[[], Callable[[list[str]], np.ndarray]] | None = None):
    def run(batches):
        embed = make() if make else hashed_ngrams
        for texts in batches:
            yield pd.Series(list(map(list, np.asarray(embed([(x or "").strip() for x in texts]), np.float32))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def reranking(make: Callable[[], Callable[[str, list[str]], list[float]]]):
    def run(batches):
        score = make()
        for queries, passages in batches:
            out = pd.Series(np.nan, index=queries.index, dtype="float64")
            for q, at in queries.groupby(queries, sort=False).groups.items():
                out.loc[at] = list(map(float, score(q, passages.loc[at].fillna("").tolist())))
            yield out

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def _told(call, *args) -> tuple[str | None, str]:
    try:
        return call(*args), "ok"
    except Exception:  # noqa: BLE001  one failed call is that row's outcome
        return None, "error"


def reading(make: Callable[[], Callable[[bytes, str], str] | None]):
    """(image, hint) -> struct<reply,outcome>; outcome is ok, error or unavailable."""

    def run(batches):
        read = make()
        for images, hints in batches:
            rows = [_told(read, bytes(i), h) if read else (None, "unavailable") for i, h in zip(images, hints, strict=True)]
            yield pd.DataFrame(rows, columns=["reply", "outcome"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "reply string, outcome string")


def replying(make: Callable[[], Callable[[str, str], str]]):
    """(system, user) -> struct<reply,outcome>. For the edge of a job only: no computed change depends on it."""

    def run(batches):
        complete = make()
        for systems, users in batches:
            yield pd.DataFrame([_told(complete, s, u) for s, u in zip(systems, users, strict=True)], columns=["reply", "outcome"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "reply string, outcome string")


def patient(call: Callable, hint: Callable[[Exception], float | None], budget: float, sleep: Callable[[float], None] = time.sleep, usual: float = 15.0):
    """``call``, again after rate limits. ``hint`` gives the seconds that an error asks for (None: unknown), or raises it.

    A wait is the hint (or ``usual``) and a second more, at most what is left of ``budget``; a hint beyond that fails.
    """

    def run(*args):
        left = budget
        while True:
            try:
                return call(*args)
            except Exception as e:  # noqa: BLE001
                asked = hint(e)
                if left <= 0 or asked is not None and asked > left:
                    raise
                wait = min((asked if asked is not None else usual) + 1, left)
                sleep(wait)
                left -= wait

    return run
