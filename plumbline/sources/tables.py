"""Readers and writers of the engine's files. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import schemas as S
from plumbline.settings import DEFAULT


def canonical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, elements) of canonical JSON files, one document each."""
    docs = spark.read.schema(S.DOCUMENT_JSON).option("multiLine", True).json(path)
    e = docs.select("pid", F.posexplode("elements").alias("seq", "e"))
    rows = e.select("pid", "e.id", F.col("seq").cast("long").alias("seq"), "e.type", "e.text", "e.bbox", "e.attributes", "e.source_adapter", "e.extraction_confidence")
    return docs.withColumn("n_elements", F.size("elements")).drop("elements"), rows


def write_canonical(documents: DataFrame, elements: DataFrame, path: str) -> None:
    """One JSON object per document and line. A document's elements are one row: keep this for exchange, not for bulk."""
    cols = ["id", "type", "text", "bbox", "attributes", "source_adapter", "extraction_confidence"]
    held = elements.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *[c for c in cols if c != "attributes"], F.to_json("attributes").alias("attributes")))), lambda x: F.struct(*[F.from_json(x[c], "map<string,string>").alias(c) if c == "attributes" else x[c].alias(c) for c in cols])).alias("elements"))
    documents.join(held, "pid", "left").write.mode("overwrite").json(path)


def multiline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests, ground truth, questions and labels: a JSON object or array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, expected changes)."""
    rows = multiline(spark, path, S.GROUND_TRUTH_JSON)
    expected = rows.select("pair_id", F.explode("expected_deltas").alias("e")).select("pair_id", "e.*")
    return rows.select("pair_id", "negative_control", "notes"), expected


def spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spans, rejected lines) of trace files with one JSON object per line.

    Blank lines are skipped. A line that can't be read is rejected by itself; the lines behind it stay. A folder
    without files gives no rows.
    """
    try:
        lines = spark.read.text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    kind = S.SPAN.replace("attributes map<string,string>", "attributes map<string,string>, _bad string")
    read = lines.filter(F.trim("value") != "").select("value", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("s"))
    bad = F.col("s").isNull() | F.col("s._bad").isNotNull() | F.col("s.name").isNull()
    return read.filter(~bad).select("s.*").drop("_bad"), read.filter(bad).select("value")


def write_spans(rows: DataFrame, path: str) -> None:
    """Append spans as JSON lines. A trace's spans stand together, in order of their start, in one file of many traces."""
    rows.repartition("trace_id").sortWithinPartitions("trace_id", "start_time", "span_id").write.mode("append").json(path)


SCORECARD = "label string, value double, higher_is_better boolean"


def scorecard(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of a run, one JSON object per line: what ``evaluation.scorecard_diff`` compares."""
    return spark.read.schema(SCORECARD).json(path)


def write_scorecard(metrics: DataFrame, path: str) -> None:
    metrics.select("label", F.col("value").cast("double").alias("value"), "higher_is_better").coalesce(1).write.mode("overwrite").json(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, side, path, pid, format, revision_label: two rows per manifest file."""
    rows = multiline(spark, path, S.MANIFEST_JSON)
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("doc_a").alias("d")), F.struct(F.lit("b").alias("side"), F.col("doc_b").alias("d")))
    return rows.select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.side", "s.d.*")


def ocr_words(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(S.OCR_WORD).option("sep", sep).option("header", True).option("quote", "").csv(path)


def uploads(spark: SparkSession, path: str, cap: int = DEFAULT.upload_cap) -> DataFrame:
    """Files within the cap, with their bytes; larger ones are not read at all."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= cap)


def text_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Line tables for classification: one page and block per document, lines in order."""
    return docs.select(F.col(id_).cast("string").alias("pid"), F.lit(0).alias("page"), F.lit(0).cast("long").alias("block"), F.posexplode(F.split(text, "\n", -1)).alias("n", "text")).select("pid", "page", "block", F.col("n").cast("long").alias("line"), "text")


HTML_BLOCK = r"(?is)<(?:p|h[1-6])(?:\s[^>]*)?>((?:[^<]|</?(?:a|b|code|em|i|small|span|strong|u)(?:\s[^>]*)?>)*)"
#: The same without giving back what it matched, so that long blocks need no stack.
_HTML_BLOCK = HTML_BLOCK.replace("[^<]|", "[^<]++|").replace(")*)", ")*+)")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Text of <p> and heading elements in page order: page_id, block, text."""
    found = F.regexp_extract_all("html", F.lit(_HTML_BLOCK), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("block", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", F.col("block").cast("long").alias("block"), text.alias("text")).filter("text <> ''")


def page_copies(elements: DataFrame, n: int, pages: int = 1) -> DataFrame:
    """``n`` copies of every element, each on pages of its own and with ids of its own: the scale generator."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = elements.withColumn("copy", copy)
    box = F.col("bbox").withField("page", F.col("bbox.page") + F.col("copy") * pages)
    return rows.withColumn("bbox", box).withColumn("id", F.format_string("%s#%d", F.col("id"), F.col("copy"))).drop("copy")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def newest_first(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, created_at) as they are listed; of those made at one time the smaller id comes first."""
    return sessions.orderBy(F.col("created_at").desc(), "session_id")
