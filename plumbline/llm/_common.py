"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts define it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where it is unset, one of this machine if Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_folders: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; the cluster's own clean-up has the folder
        pass


@contextmanager
def _freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that ends here are dropped at its end; its result is in a table by then."""
    before = spark.conf.get(_CLEANUP_CONF, "false")
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_CONF, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    attach(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch, text_column: str, max_bytes: int, max_rows: int = 4096):
    """Cut an Arrow batch into pieces of about ``max_bytes`` of text; one longer text is a piece of its own."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + max_bytes, side="right"))
        to = min(n, max(at + 1, to), at + max_rows)
        yield batch.slice(at, to - at)
        at = to


def utf8(column):
    """(bytes of all texts, offsets) of an Arrow string column; null is the empty text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return b"", np.zeros(len(column) + 1, np.int64)
    return data.to_pybytes()[offsets[0] : offsets[-1]] if data.size != offsets[-1] - offsets[0] else data.to_pybytes(), offsets - offsets[0]


def spread(starts, lengths):
    """Concatenated ranges: start, start+1, ... for each (start, length)."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(np.asarray(starts, np.int64), lengths)


_KEEP = [(1 << 8 * n) - 1 for n in range(9)]
#: Words up to this many bytes are their own number.
PACKED = 15


def packed(raw, starts, lengths):
    """Two unsigned numbers for each byte string raw[start : start + length]: its bytes and, in the top byte, its length.

    Different strings of up to PACKED bytes have different pairs. The pairs of longer ones are to be put by the caller.
    """
    import numpy as np

    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    at = np.ndarray(len(raw) + 9, np.dtype("<u8"), buffer=padded, strides=(1,))
    keep = np.array(_KEEP, np.uint64)
    a = at[starts] & keep[np.minimum(lengths, 8)]
    b = at[np.minimum(starts + 8, len(raw))] & keep[np.clip(lengths - 8, 0, 7)]
    return a, b | (np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56))


def mixed(h):
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
