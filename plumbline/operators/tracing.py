"""Timed spans of a driver's own steps, as rows of the span log.

A ``Recorder`` keeps the finished spans of one process; ``spans`` gives them as a table for ``telemetry`` or
``sources.tables.write_spans``. Spans nest by context, so threads and coroutines with their own context don't mix.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from plumbline.schemas import SPAN

#: (trace, innermost open span) of this context.
_open: ContextVar[tuple[str, str | None] | None] = ContextVar("open_span", default=None)


def _id() -> str:
    return uuid.uuid4().hex[:16]


def _shown(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, default=str)


class Recorder:
    """Collects spans: ``with recorder.trace("ingest"): with recorder.span("parse") as found: found["pages"] = 3``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """Time the block. What it puts into the given dict joins its attributes; outside any trace it has one of its own.

        An exception is recorded (status ``error``, its text and type) and goes on.
        """
        trace, parent = _open.get() or (_id(), None)
        mine, found, status = _id(), {}, "ok"
        before = _open.set((trace, mine))
        began, tick = time.time(), time.perf_counter()
        try:
            yield found
        except Exception as e:
            status = "error"
            found = {"error": str(e), "error_type": type(e).__name__} | found
            raise
        finally:
            took = time.perf_counter() - tick
            _open.reset(before)
            shown = {k: _shown(v) for k, v in (attributes | found).items()}
            self.rows.append((trace, mine, parent, name, began, began + took, took * 1000, status, shown))

    @contextmanager
    def trace(self, name: str, **attributes) -> Iterator[str]:
        """A trace of its own, whatever is open, with a first span; gives the trace's id."""
        trace = _id()
        before = _open.set((trace, None))
        try:
            with self.span(name, **attributes):
                yield trace
        finally:
            _open.reset(before)

    def spans(self, spark: SparkSession) -> DataFrame:
        """What has ended so far."""
        return spark.createDataFrame(self.rows, SPAN)
