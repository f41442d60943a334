"""Quality rules, line first: lines that fail punctuation, navigation or boilerplate rules go, then documents that lost
too much text are rejected. Column expressions only; no row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import ASCII_SPACE, WORD_PATTERN, documents, text_or_empty

#: Rules of the contract.
LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEATED_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"

#: Line rules.
FRAGMENT_WORDS = 4  # a shorter line has to end in punctuation
MOST_SEPARATORS = 0.34  # navigation: separators to words
MOST_SYMBOLS = 0.34  # noise: symbols to words
SEPARATORS = "[|»›·•]"
CLOSING = ".!?…。！？:;,\"'”’»)]"
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "subscribe to our newsletter",
    "click here to",
    "skip to content",
    "skip to main content",
    "lorem ipsum",
)
#: Document rule: the share of words that has to stay.
LEAST_KEPT = 0.5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of five words found twice or more in ``words``."""
    k = REPEAT_WINDOW

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(e: Column) -> Column:
            same = lambda j: (F.get(e, j)["h"] == F.get(e, j - 1)["h"]) | (F.get(e, j)["h"] == F.get(e, j + 1)["h"])
            found = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: F.coalesce(same(j), F.lit(False)) | F.coalesce(F.get(e, j)["h"] == F.get(e, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda j: F.get(e, j)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + k).alias("end"), (a["n"] + (p + k - F.greatest(a["end"], p))).alias("n"))
        return F.aggregate(let(ranked, positions), start, step)["n"]

    def of(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))
        hashes = let(each, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - k), lambda i: F.xxhash64(*[F.get(e, i + o) for o in range(k)])))
        return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        )

    return let(words, of)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, noisy: Column, separated: Column, stock: Column) -> Column:
    """Whether a line that has words fails a rule. The flags say whether the text has a sign of that rule at all."""
    words = _count(line, WORD_PATTERN)
    last = F.right(F.rtrim(line), F.lit(1))
    fragment = ~(F.instr(F.lit(CLOSING), last) > 0) & (words < FRAGMENT_WORDS)
    navigation = separated & (_count(line, SEPARATORS) > words * MOST_SEPARATORS)
    noise = noisy & (_count(line, SYMBOLS) > words * MOST_SYMBOLS)
    boilerplate = stock & (words <= BOILERPLATE_WORDS) & let(F.lower(line), _stock)
    return fragment | navigation | noise | boilerplate


def _stock(lowered: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


def clean_lines(text: Column) -> Column:
    """``text`` without the lines that fail; lines without words stay."""
    signs = F.struct(text.rlike(SYMBOLS).alias("noisy"), text.rlike(SEPARATORS).alias("separated"), let(F.lower(text), _stock).alias("stock"))
    stays = lambda f: lambda x: ~line_fails(x, f["noisy"], f["separated"], f["stock"]) | ~x.rlike(WORD_PATTERN)
    return let(signs, lambda f: F.array_join(F.filter(F.split(text, "\n", -1), stays(f)), "\n"))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def _without_space(text: Column) -> Column:
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned text and the measures: text_cleaned, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. Columns of these names are replaced.

    A null text has no words and fails; repeated rows are judged alike; an empty table stays empty.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    both = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    counted = docs.withColumns(
        {
            "text_cleaned": clean_lines(text),
            "_n": both,
            "word_chars": F.length(_without_space(text)).cast("long"),
            "n_symbols": _count(text, SYMBOLS).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    stays = (F.col("text_cleaned") == text) | (_count(F.col("text_cleaned"), WORD_PATTERN) >= F.col("n_words") * LEAST_KEPT)
    return counted.withColumns({"n_words": F.col("_n.n"), "n_repeat_words": F.col("_n.r")}).drop("_n").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & stays)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    return measure(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
