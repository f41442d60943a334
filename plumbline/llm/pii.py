"""Personal data: patterns, and terms that give a protected value away, by information content.

Patterns find the values to protect. For each value e and each term t beside it, the corpus tells how much t reveals:
the pointwise mutual information PMI(t; e) = log2(N n(t, e) / (n(t) n(e))) against the information content
IC(e) = log2(N / n(e)), with N documents of which n(t), n(e) and n(t, e) hold the term, the value, and the term beside the
value. A term that reveals all of a value's information (share 1) is removed from sanitised texts, one that reveals at
least GENERALISE of it is put as a general term: [NUMBER], [NAME] or [WORD]. A term has to stand beside its value in
LEAST_CONTEXTS distinct contexts, so that copies of one text prove nothing. Column expressions only.

Beside a value are up to BESIDE words on either side, as far as the next value or the text's end; of values that overlap,
the words on either side of them all. ``find_personal(..., anywhere=True)``, the form of the queries, also judges every other
word of a text against every value of it: n(t, e) is then how many documents hold both, in two documents at least, and the
context is the term's own neighbours (of several places in a document, one stands for all). A term that reveals a value by
either count goes wherever it stands in the value's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import WORD_PATTERN, documents, materialize, text_or_empty
from plumbline.llm._spans import between, covered, masked, matches, ordered, pieces, running, spelled
from plumbline.llm.quality import let, words_of

#: Patterns of the contract, written so that they need no backtracking into what they have matched.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

#: Words on either side of a value that count as beside it.
BESIDE = 3
#: Distinct contexts in which a term has to stand beside a value.
LEAST_CONTEXTS = 2
#: Share of a value's information from which a term is generalised; all of it: removed.
GENERALISE = 0.9
LEAST_TERM = 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""

    def total(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(digit(i))).otherwise(digit(i)))

    return let(digits, lambda d: total(d) % 10 == 0)


def _is_card(value: Column, _) -> Column:
    return let(_digits(value), lambda d: F.length(d).between(13, 19) & luhn(d))


def _is_ip(value: Column, _) -> Column:
    small = lambda y: (F.length(y) <= 3) & (F.coalesce(y.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(value, r"\."), lambda x: let(F.ltrim(x, F.lit("0")), small))


def _is_phone(value: Column, _) -> Column:
    return F.length(_digits(value)).between(9, 15)


def find_values(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of the patterns' matches, by kind as listed, then start."""
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email")).otherwise(none),
        matches(text, IP, "ip", _is_ip),
        matches(text, CARD, "card", _is_card),
        F.when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone", _is_phone)).otherwise(none),
    )


def _with_gaps(found: DataFrame) -> DataFrame:
    """``found`` (body, base, ...) with what lies between values, and the spans by start with the gaps they lie between.

    What lies between is read whole and once, step by step, so that what it costs grows with text and spans, not with
    their product.
    """
    some = lambda x: F.when(F.size("base") > 0, x)
    by_start = F.sort_array(F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    found = found.withColumns({"_pieces": some(pieces(F.col("body"))), "_spans": some(by_start), "_n": F.length("body").cast("long")})
    found = found.withColumn("_cover", some(covered(F.transform("_spans", lambda s: s["end"]))))
    # a value that starts before another's end is no first one: there is no gap before it
    found = found.withColumn("_first", F.transform("_spans", lambda s, i: (F.get("_cover", i) <= s["start"]).cast("long")))
    found = found.withColumn("_before", some(running(F.col("_first"))))

    before = F.filter(F.transform("_spans", lambda s, i: F.struct(F.get("_cover", i).alias("from"), s["start"].alias("to"))), lambda g: g["from"] <= g["to"])
    last = F.struct(F.array_max(F.transform("_spans", lambda s: s["end"])).alias("from"), F.col("_n").alias("to"))
    gaps = F.transform(F.concat(before, F.array(last)), lambda g: F.struct(g["from"], between(F.col("_pieces"), g["from"], g["to"]).alias("text")))
    return found.withColumn("_gaps", some(gaps)).drop("_cover", "_pieces", "_n")


def _with_beside(found: DataFrame) -> DataFrame:
    """``found`` (body, base, ...) with the terms beside each value: array<struct<entity, context, term, start, end>>.

    Values that overlap stand together: the words on either side of all of them are beside each of them.
    """
    found = _with_gaps(found)

    def edges(g: Column) -> Column:
        """The first and the last words of a gap."""
        placed = lambda m: F.transform(m, lambda x: F.struct((x["start"] + g["from"]).alias("start"), (x["end"] + g["from"]).alias("end"), x["value"].alias("word")))
        tail = lambda m: F.slice(m, F.greatest(F.size(m) - BESIDE + 1, F.lit(1)), BESIDE)
        return let(matches(g["text"], WORD_PATTERN, TERM), lambda m: F.struct(placed(F.slice(m, 1, BESIDE)).alias("first"), placed(tail(m)).alias("last")))

    found = found.withColumn("_words", F.transform("_gaps", edges)).drop("_gaps")

    def both(s: Column, i: Column) -> Column:
        entity = F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity")
        after = (F.get("_before", i) + F.get("_first", i)).cast("int")
        return F.struct(entity, F.concat(F.get("_words", after - 1)["last"], F.get("_words", after)["first"]).alias("words"))

    found = found.withColumn("_beside", F.transform("_spans", both)).drop("_words", "_spans", "_first", "_before")

    def terms(x: Column) -> Column:
        context = F.xxhash64(F.array_join(F.transform(x["words"], lambda w: w["word"]), " "))
        bare = F.filter(F.transform(x["words"], _bare), lambda w: F.length(w["term"]) >= LEAST_TERM)
        return let(context, lambda c: F.transform(bare, lambda w: F.struct(x["entity"], c.alias("context"), w["term"], w["start"], w["end"])))

    none = F.array().cast("array<struct<entity:string,context:long,term:string,start:long,end:long>>")
    return found.withColumn("beside", F.coalesce(F.flatten(F.transform("_beside", terms)), none)).drop("_beside")


def _all_terms(found: DataFrame) -> DataFrame:
    """``found`` (body, base, ...) with the terms of its whole texts but for the values: array<struct<term, start, end, context>>."""

    def told(g: Column) -> Column:
        near = lambda m, i: F.xxhash64(F.array_join(F.array(*[F.get(m, i + k)["value"] for k in range(-BESIDE, BESIDE + 1)]), " "))
        word = lambda x: _bare(F.struct((x["start"] + g["from"]).alias("start"), (x["end"] + g["from"]).alias("end"), x["value"].alias("word")))
        each = lambda m: F.transform(m, lambda x, i: let(word(x), lambda w: F.struct(w["term"], w["start"], w["end"], near(m, i).alias("context"))))
        return let(matches(g["text"], WORD_PATTERN, TERM), each)

    return _with_gaps(found).withColumn("all", F.filter(F.flatten(F.transform("_gaps", told)), lambda w: F.length(w["term"]) >= LEAST_TERM)).drop("_spans", "_first", "_before", "_gaps")


_EDGE = r"[\p{P}\p{S}]*"


def _bare(x: Column) -> Column:
    """A word without punctuation at its edges, and where that stands."""
    head = F.length(F.regexp_extract(x["word"], f"^{_EDGE}", 0))
    return let(
        F.struct(head.alias("h"), F.regexp_replace(x["word"], f"^{_EDGE}|{_EDGE}$", "").alias("w")),
        lambda y: F.struct(F.lower(y["w"]).alias("term"), (x["start"] + y["h"]).alias("start"), (x["start"] + y["h"] + F.length(y["w"])).alias("end")),
    )


def corpus_terms(docs: DataFrame) -> DataFrame:
    """term, n: how many documents hold each term, over all documents."""
    bare = F.transform(words_of(text_or_empty()), lambda w: F.lower(F.regexp_replace(w, f"^{_EDGE}|{_EDGE}$", "")))
    return docs.select(F.explode(F.array_distinct(bare)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _held(found: DataFrame) -> DataFrame:
    """row, entity: which rows hold a value."""
    return found.select("row", F.explode("base").alias("b")).select("row", F.concat_ws(":", "b.kind", F.lower("b.value")).alias("entity")).distinct()


def _shared(held: DataFrame) -> DataFrame:
    """row, entity: values that two rows or more hold. Those of the same rows are one, as what they tell is the same."""
    same = F.concat_ws(":", F.lit(""), F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64(F.lit(1), "row"))).alias("same")
    groups = held.groupBy("entity").agg(F.count("*").alias("ne"), same).filter("ne > 1").select("entity", "same")
    return held.join(groups, "entity").select("row", F.col("same").alias("entity")).distinct()


def _pairs_anywhere(found: DataFrame, shared: DataFrame) -> DataFrame:
    """entity, term, contexts, joint: how many rows hold both, for values of ``_shared``."""
    words = _all_terms(found.join(shared.select("row").distinct(), "row", "left_semi")).select("row", F.explode("all").alias("w"))
    held = words.groupBy("row", "w.term").agg(F.min("w.context").alias("context"))
    pairs = held.join(shared, "row").groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count("*").alias("joint"))
    return pairs.filter((F.col("joint") > 1) & (F.col("contexts") >= LEAST_CONTEXTS))


def revealing_terms(found: DataFrame, docs: DataFrame, total: int, shared: DataFrame | None = None) -> DataFrame:
    """entity, term, share (of the entity's information that the term reveals), from GENERALISE on.

    found: rows with values, base and beside of ``_located``. Only values and terms that stand together in two distinct contexts can get here.
    shared: of ``_shared``, for terms that stand anywhere in a value's rows.
    """
    beside = found.select("row", F.explode("beside").alias("b")).select("row", "b.entity", "b.context", "b.term")
    pairs = beside.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("joint")).filter(F.col("contexts") >= LEAST_CONTEXTS)
    held = _held(found)
    if shared is not None:
        pairs, held = pairs.unionByName(_pairs_anywhere(found, shared)), held.unionByName(shared)
    pairs = materialize(pairs, "pairs")
    holds = held.groupBy("entity").agg(F.count("*").alias("ne"))
    # an inner join, which stays above the counting: a semi join would be pushed under it, to every occurrence of a term
    stats = pairs.join(corpus_terms(docs), "term").join(holds, "entity")
    pmi = F.log2(F.lit(float(total)) * F.col("joint") / (F.col("n") * F.col("ne")))
    content = F.log2(F.lit(float(total)) / F.col("ne"))
    share = F.when(content > 0, F.least(pmi / content, F.lit(1.0))).otherwise(0.0)
    return stats.select("entity", "term", F.round(share, 9).alias("share")).filter(F.col("share") >= GENERALISE)


def find_personal(docs: DataFrame, *keep: str, anywhere: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs``, and spans: base ones by kind and start, then revealing terms by start.

    ``base`` and ``terms`` are array<struct<kind,start,end,value>>; a term's kind is ``term``, its value ``removed`` or
    ``generalised``. A null text is empty; a null doc_id stays null; repeated rows are judged alike and stay; an empty
    table stays empty. Values and terms are counted over all rows. Columns of ``docs`` may have any names; those named
    ``base`` or ``terms`` are replaced. ``anywhere``: terms are sought in the whole texts that hold a value, not beside it only.
    """
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    keep = [c for c in keep if c not in ("base", "terms")]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("nothing")])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), text_or_empty().alias("body"))
    kind = lambda share: F.when(share >= 1, "removed").otherwise("generalised").alias("value")
    if anywhere:
        body = F.when(F.size("base") > 0, F.col("body")).alias("body")
        found = materialize(_with_beside(numbered.withColumn("base", find_values(F.col("body")))).select("row", "kept", "base", "beside", body), "personal")
        some = found.filter(F.size("base") > 0)
        shared = materialize(_shared(_held(some)), "shared")
        terms = materialize(revealing_terms(some, docs, found.count(), shared), "terms")
        told = _held(some).unionByName(shared).join(terms, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))
        told = told.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
        here = F.filter("all", lambda w: F.map_contains_key("shares", w["term"]))
        spans = F.transform(here, lambda w: F.struct(F.lit(TERM).alias("kind"), w["start"], w["end"], kind(F.try_element_at("shares", w["term"]))))
        spans = _all_terms(some.join(told, "row")).select("row", F.array_sort(spans).alias("terms"))
        plain = found.filter(F.size("base") == 0)
    else:
        found = materialize(_located(numbered), "personal")
        some = found.filter(F.size("beside") > 0)
        terms = revealing_terms(found.filter(F.size("base") > 0), docs, found.count())
        hits = some.select("row", F.explode("beside").alias("b")).select("row", "b.entity", "b.term", "b.start", "b.end").join(terms, ["entity", "term"])
        spans = hits.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
        spans = spans.select("row", F.struct(F.lit(TERM).alias("kind"), F.col("start"), F.col("end"), kind(F.col("share"))).alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("terms"))
        plain = found.filter(F.size("beside") == 0)
    # only rows with a value, or something beside one, can have terms; the others, and their texts, are not shuffled
    rows = plain.withColumn("terms", none).unionByName(some.join(spans, "row", "left").withColumn("terms", F.coalesce("terms", none)))
    return rows.select(*[F.col(f"kept.`{c}`") for c in keep], "base", "terms")


def _located(numbered: DataFrame) -> DataFrame:
    return _with_beside(numbered.withColumn("base", find_values(F.col("body")))).select("row", "kept", "base", "beside")


def all_spans() -> Column:
    return F.concat("base", "terms")


def _general(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def sanitise(text: Column) -> Column:
    """``text`` with values put as their kind, removed terms left out, and generalised ones put as a general term."""
    put = lambda s, word: F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "removed", "").otherwise(_general(word))
    return masked(text, ordered(all_spans(), [*KINDS, TERM], by_start=True), put)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in all documents."""
    found = find_personal(documents(spark, sf_dir, "doc_id", "text"), "doc_id", anywhere=True)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(all_spans()).alias("spans"))
