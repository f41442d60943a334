"""Text rules as column expressions: normalising, typing of labels, citations, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of the labels, in the order in which they are tried, and the instrument and flag codes.
LINE_NUMBER = r'^\d+(\.\d+)?"-[A-Z]{2,4}-\d{2,4}-\d{3,6}-[A-Z0-9]+-\d{2}$'
INSTRUMENT = r"^([A-Z]{2,5})-(\d{3,6}[A-Z]?)$"
VALVE = r"^\d{2}[A-Z]{2,4}\d{3,5}[A-Z]?$"
TAG = r"^\d{2}-[A-Z]{1,3}-\d{3,4}[A-Z]?$"
SETPOINT = r"(?i)^(SP|SET\s*PRESSURE)\s*=\s*([\d.]+)\s*(.*)$"
LIMIT = r"^(HH|LL|H|L)\s*[:=]\s*([\d.]+)$"
SIZE_CHANGE = r'^\d+"?\s*[xX]\s*\d+"?$'
NOTE_MARK = r"^\d{1,3}(-\d{1,3})?\.$"
NOTE_LINE = r"^(\d{1,3}(?:-\d{1,3})?)\.\s+(\S.*)$"
NOTE_SECTION = r"^(NOTES|HOLDS|WORK PACKS?):$"
NOTE_REFERENCE = r"^NOTE\s+\d+(\s*,\s*\d+)*$"
LOOP_NUMBER = r"^\d{3,6}[A-Z]?$"
UNIT_NUMBER = r"^\d{1,3}$"
ONE_LETTER = r"^[A-Z]$"
FLAGS = ["LO", "LC", "CSO", "CSC", "ZSO", "ZSC", "NO", "NC"]
INSTRUMENTS = [
    "PIT", "PI", "PIC", "PDIT", "PDI", "PDT", "PDIC", "TIT", "TIC", "TI", "TE", "TT",
    "FIT", "FIC", "FI", "FE", "FT", "FQI", "LIT", "LIC", "LI", "LT", "LG",
    "PSV", "PSE", "PSI", "PSH", "PSL", "PSHH", "PSLL", "XV", "HV", "ESDV", "RS",
]
#: Digits and a letter that recognition reads for capital letters, and those letters.
MISREAD, MEANT = "01l5826", "OIISBZG"
KEYED_TYPES = ["tag", "instrument_loop", "valve", "line_number"]

_SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space at the edges, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Stripped, and inner runs of white space as one space."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _tolerant(pattern: str) -> str:
    return pattern.replace("[A-Z]{", f"[A-Z{MISREAD}]{{")


def _attributes(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.create_map(*pairs)


def _found(kind: str, attributes: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.lit(kind).alias("type"), (attributes if attributes is not None else empty).alias("attributes"))


def single_label(t: Column) -> Column:
    """struct<type,attributes> of a stripped one-line label, or null when no shape fits."""
    code = F.regexp_extract(t, INSTRUMENT, 1)
    return (
        F.when(t.rlike(LINE_NUMBER), _found("line_number"))
        .when(t.rlike(INSTRUMENT) & code.isin(INSTRUMENTS), _found("instrument_loop", _attributes(function=code, loop_number=F.regexp_extract(t, INSTRUMENT, 2))))
        .when(t.rlike(VALVE), _found("valve"))
        .when(t.rlike(TAG), _found("tag"))
        .when(t.rlike(SETPOINT), _found("setpoint", _attributes(setpoint_type=F.lit("SP"), value=F.regexp_extract(t, SETPOINT, 2), unit=strip(F.regexp_extract(t, SETPOINT, 3)))))
        .when(t.rlike(LIMIT), _found("setpoint", _attributes(setpoint_type=F.regexp_extract(t, LIMIT, 1), value=F.regexp_extract(t, LIMIT, 2))))
        .when(t.rlike(SIZE_CHANGE), _found("dimension", _attributes(kind=F.lit("size_transition"))))
    )


def meant_letters(t: Column) -> Column:
    return F.translate(t, MISREAD, MEANT)


def misread_label(t: Column) -> Column:
    """struct<type,attributes> of a label whose letters may be misread, or null. The text itself is never rewritten."""
    shape = _tolerant(INSTRUMENT)
    code = meant_letters(F.regexp_extract(t, shape, 1))
    again = F.lit("true")
    return (
        F.when(t.rlike(_tolerant(LINE_NUMBER)), _found("line_number", _attributes(ocr_reclassified=again)))
        .when(t.rlike(shape) & code.isin(INSTRUMENTS), _found("instrument_loop", _attributes(function=code, loop_number=F.regexp_extract(t, shape, 2), ocr_reclassified=again)))
        .when(t.rlike(_tolerant(VALVE)), _found("valve", _attributes(ocr_reclassified=again)))
        .when(t.rlike(_tolerant(TAG)), _found("tag", _attributes(ocr_reclassified=again)))
    )


def one_line(text: Column, ocr_tolerant: bool = False) -> Column:
    """struct<type,text,attributes> of a block of one line: every rule that needs no other line."""
    t = strip(text)
    number = F.when(t.rlike(NOTE_MARK), F.rtrim(t, F.lit("."))).otherwise(F.regexp_extract(t, NOTE_LINE, 1))
    note = F.when(t.rlike(NOTE_MARK), F.concat(number, F.lit("."))).otherwise(strip(F.concat(number, F.lit(". "), F.regexp_extract(t, NOTE_LINE, 2))))
    refs = F.array_join(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), ",")
    fallback = F.coalesce(misread_label(t), _found("text_block")) if ocr_tolerant else _found("text_block")
    made = (
        F.when(t.rlike(NOTE_MARK) | t.rlike(NOTE_LINE), _found("note", _attributes(kind=F.lit("definition"), note_number=number)))
        .when(t.rlike(NOTE_REFERENCE), _found("note", _attributes(kind=F.lit("reference"), refs=refs)))
        .otherwise(
            F.coalesce(
                single_label(t),
                F.when(t.isin(FLAGS), _found("text_block", _attributes(kind=F.lit("valve_status_flag"))))
                .when(t.rlike(ONE_LETTER), _found("text_block", _attributes(kind=F.lit("flag"))))
                .otherwise(fallback),
            )
        )
    )
    return F.struct(made["type"].alias("type"), F.when(t.rlike(NOTE_MARK) | t.rlike(NOTE_LINE), note).otherwise(t).alias("text"), made["attributes"].alias("attributes"))


def element_key(kind: Column, text: Column, attributes: Column) -> Column:
    """What identifies an element besides its place: its text, or a note definition's number; else null."""
    t = strip(text)
    number = attributes["note_number"]
    by_text = F.when(kind.isin(KEYED_TYPES) & (t != ""), t)
    by_note = F.when((kind == "note") & (attributes["kind"] == "definition") & (number != ""), F.concat(F.lit("note-def:"), number))
    return F.coalesce(by_text, by_note)


# retrieval

# How questions name labels and notes, how answers cite, and how models and providers say a few things.
LABEL_LIKE = r"([A-Za-z0-9][A-Za-z0-9\-/]{1,})"
NOTE_NAMED = r"(?i)\bnote\s*(?:number\s*)?#?\s*(\d{1,3})\b"
CITED = r"\[([^\[\]]+)\]"
THOUGHT = r"(?s)<think>.*?</think>"
NOTHING_READ = r"(?i)^\W*(empty|no text( visible| found)?|n/?a|none)\W*$"
WAIT_MINUTES = r"(?i)try again in\s+(\d+)m([\d.]+)s\b"
WAIT = r"(?i)try again in\s+([\d.]+)\s*(ms|s|m)\b"
REFUSAL = "NOT_GROUNDED:"
NO_REASON = "insufficient grounded context"


def tag_tokens(question: Column) -> Column:
    """Distinct words of a question that look like a label: three characters or more, with a digit."""
    found = F.regexp_extract_all(question, F.lit(LABEL_LIKE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & x.rlike(r"\d")))


def note_numbers(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(NOTE_NAMED), F.lit(1)))


def citations(answer: Column) -> Column:
    """Distinct bracketed ids of an answer, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)))


def refusal(reply: Column) -> Column:
    """struct<refused,reason> of a reply."""
    t = strip(reply)
    refused = F.startswith(t, F.lit(REFUSAL))
    reason = F.coalesce(F.nullif(strip(F.substring(t, len(REFUSAL) + 1, 2**31 - 1)), F.lit("")), F.lit(NO_REASON))
    return F.struct(refused.alias("refused"), F.when(refused, reason).alias("reason"))


def without_thinking(reply: Column) -> Column:
    """Without <think> parts; after an orphan end only what follows the last one."""
    cut = F.regexp_replace(reply, THOUGHT, "")
    return strip(F.substring_index(cut, "</think>", -1))


def empty_reply(reply: Column) -> Column:
    """Replies that say there is nothing become empty."""
    return F.when(reply.rlike(NOTHING_READ), F.lit("")).otherwise(reply)


def retry_seconds(message: Column) -> Column:
    """How long a provider's message says to wait; null if it doesn't."""
    number = F.regexp_extract(message, WAIT, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(message, WAIT, 2))
    each = F.when(unit == "ms", number / 1000.0).when(unit == "m", number * 60.0).otherwise(number)
    return F.when(message.rlike(WAIT_MINUTES), F.regexp_extract(message, WAIT_MINUTES, 1).try_cast("double") * 60.0 + F.regexp_extract(message, WAIT_MINUTES, 2).try_cast("double")).when(message.rlike(WAIT), each)


#: Fixed value: how a judge's reply names its scores.
JUDGED = r"(?is)correctness\**:?\**\s*(\d).*?groundedness\**:?\**\s*(\d)(?:.*?reason\**:?\**\s*(.+))?"


def verdict(reply: Column) -> Column:
    """struct<correctness,groundedness,reason> of a judge's reply, scores held to 1..5; null if it can't be read."""
    t = without_thinking(reply)
    score = lambda i: F.greatest(F.lit(1), F.least(F.lit(5), F.regexp_extract(t, JUDGED, i).try_cast("int")))
    reason = F.substring_index(strip(F.regexp_extract(t, JUDGED, 3)), "\n", 1)
    return F.when(t.rlike(JUDGED), F.struct(score(1).alias("correctness"), score(2).alias("groundedness"), reason.alias("reason")))


def edge_cleaned(text: Column) -> Column:
    """A recognised line without edge words that have no letter or digit, and without edge brackets and strokes."""
    inner = F.regexp_replace(F.regexp_replace(strip(text), r"(?U)^(?:[^\s\p{L}\p{N}]++(?:\s++|$))++", ""), r"(?U)(?:(?:^|\s++)[^\s\p{L}\p{N}]++)++$", "")
    return strip(F.regexp_replace(inner, r"^[\\/(){}\[\]|\s]+|[\\/(){}\[\]|\s]+$", ""))


def suspicious(text: Column) -> Column:
    """Whether a recognised text holds a character that drawings don't use."""
    return text.rlike("[^ -~°]")


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))


# names and rendering


def path_safe(name: Column, fallback: str = "document") -> Column:
    cut = F.substring(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-")), 1, 80)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def upload_suffix(name: Column, kind: Column) -> Column:
    return F.when(kind == "dwg", F.when(F.endswith(F.lower(name), F.lit(".dwg")), F.lit(".dwg")).otherwise(F.lit(".dxf"))).otherwise(F.lit(".pdf"))


def markdown_cell(text: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("—"))


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rgb(hexadecimal: Column) -> Column:
    """array of three shares from #rrggbb."""
    h = F.regexp_replace(hexadecimal, "^#", "")
    return F.array(*[F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255.0 for i in (1, 3, 5)])


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6
