"""Formats by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import classify as C
from plumbline.operators import ocr
from plumbline.sources import dxf, tables

#: name -> reader (spark, path, pages) -> element rows. ``pages`` (pid, page, page_width, page_height) serves the PDF forms.
_READERS: dict[str, Callable[[SparkSession, str, DataFrame | None], DataFrame]] = {}


def register(name: str):
    def put(f):
        _READERS[name] = f
        return f

    return put


@register("dwg")
def _dwg(spark, path, pages=None):
    return dxf.load(spark, path)


@register("pdf_native")
def _native(spark, path, pages=None):
    """Lines extracted from PDFs, as Parquet (columns: see classify.LINE)."""
    from pyspark.sql import functions as F

    from plumbline.functions import text as X

    lines = spark.read.schema(C.LINE).parquet(path).withColumn("text", X.collapse(F.col("text"))).filter("text <> ''")
    return C.elements(C.classify(lines), pages, "pdf_native", "pdf_points")


@register("pdf_scanned")
def _scanned(spark, path, pages=None):
    """Recognised words as tab-separated files (columns: see schemas.OCR_WORD)."""
    return ocr.scanned_elements(tables.ocr_words(spark, path), pages)


@register("canonical")
def _canonical(spark, path, pages=None):
    return tables.canonical(spark, path)[1]


def load(spark: SparkSession, name: str, path: str, pages: DataFrame | None = None) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(sorted(_READERS))}")
    return _READERS[name](spark, path, pages)
