"""Tables of the data model. ``pair_id`` leads every table about a pair, so that many pairs are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("page_width", T.DoubleType()),
        T.StructField("page_height", T.DoubleType()),
        T.StructField("unit", T.StringType()),
    ]
)
ELEMENT = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_adapter", T.StringType()),
        T.StructField("extraction_confidence", T.DoubleType()),
    ]
)
#: One drawing per file, as the canonical JSON has it.
DOCUMENT_JSON = "pid string, format string, revision_label string, page_count int, raw_source_path string, elements array<struct<id:string,type:string,text:string,bbox:struct<page:int,x0:double,y0:double,x1:double,y1:double,page_width:double,page_height:double,unit:string>,attributes:map<string,string>,source_adapter:string,extraction_confidence:double>>"
MATCH = "pair_id string, a_id string, b_id string, tier string, match_score double, bbox_distance double"
SPAN = "trace_id string, span_id string, parent_span_id string, name string, start_time double, end_time double, duration_ms double, status string, attributes map<string,string>"
OCR_WORD = "pid string, page int, seq long, text string, conf double, block_num int, par_num int, line_num int, left int, top int, width int, height int"
GROUND_TRUTH_JSON = "pair_id string, negative_control boolean, notes string, expected_deltas array<struct<gt_id:string,change_type:string,element_type:string,old_text:string,new_text:string,rationale:string,locator:struct<page:int,bbox:array<double>,near_text:string>>>"
QA_JSON = "qa_id string, pair_id string, question string, answerable boolean, expected_citation_texts array<string>, expected_answer_summary string, held_out boolean"
LABEL_JSON = "qa_id string, correctness int, groundedness int, notes string"
MANIFEST_JSON = "pair_id string, description string, doc_a struct<path:string,pid:string,format:string,revision_label:string>, doc_b struct<path:string,pid:string,format:string,revision_label:string>, ground_truth_path string, created_by string"

#: Fixed values of the closed columns.
TYPES = ["tag", "instrument_loop", "valve", "line_number", "note", "dimension", "setpoint", "table_cell", "text_block", "geometry"]
UNITS = ["pdf_points", "pixels", "dxf_units"]
CHANGES = ["added", "removed", "modified"]
TIERS = ["exact_key", "geometry", "embedding_proximity"]
FORMATS = ["pdf_native", "pdf_scanned", "dwg"]


def element_problems(e: DataFrame | None = None) -> Column:
    """Why an element row is invalid: an array of reasons, empty for a valid one."""
    b = F.col("bbox")
    checks = [
        (F.coalesce(F.col("type"), F.lit("")).isin(TYPES), "type"),
        (F.coalesce(b["unit"], F.lit("")).isin(UNITS), "unit"),
        (F.coalesce((b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"]), F.lit(False)), "bbox"),
        (F.coalesce(F.col("extraction_confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
    ]
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in checks]), lambda x: x.isNotNull())


def valid_elements(elements: DataFrame) -> DataFrame:
    """Rows that hold to the model; the others are found by ``element_problems``."""
    return elements.filter(F.size(element_problems()) == 0)
