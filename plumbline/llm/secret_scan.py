"""Secret scans over a ledger of blobs.

Every version of every document is addressed by its content. The ledger holds which (blob, rule version) pairs were
scanned and what was found; only pairs it doesn't have are scanned, each blob once however many rows hold it (copies
meet before the shuffle), and the findings are joined back to all of them. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import documents, materialize, text_or_empty
from plumbline.llm._spans import matches, ordered, spelled

#: Raise it with any change of the rules below.
RULE_VERSION = 1

#: Rules of the contract, in its order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
BASE_KINDS = ["assign", "access", "hex"]
#: Further rules: private keys in PEM armour, signed web tokens, tokens with an issuer's prefix, credentials in addresses.
MORE = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "issued": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})",
    "login": r"(?<![A-Za-z])[a-z][a-z0-9+.]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@[A-Za-z0-9.-]{1,255}",
}
KINDS = [*BASE_KINDS, *MORE]

LEDGER = "blob binary, rule_version int, spans array<struct<kind:string,start:long,end:long>>"


def scan(text: Column) -> Column:
    """All findings in a text: array<struct<kind,start,end>>, by start, then kind as listed."""
    lowered_signs = F.regexp_like(text, F.lit(r"(?i)passw|secret|token|api_?key"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")
    found = [
        F.when(lowered_signs, matches(text, ASSIGN, "assign", lambda v, g: F.length(g) >= ASSIGN_LEAST, group=1)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")).otherwise(none),
        matches(text, HEX, "hex"),
    ]
    signs = {"pem": "-----BEGIN ", "jwt": "eyJ", "login": "://"}
    for kind, pattern in MORE.items():
        sign = F.contains(text, F.lit(signs[kind])) if kind in signs else F.contains(text, F.lit("gh")) & text.rlike("gh[pousr]_") | F.contains(text, F.lit("glpat-")) | F.contains(text, F.lit("xox")) | F.contains(text, F.lit("sk_live_")) | F.contains(text, F.lit("AIza"))
        found.append(F.when(sign, matches(text, pattern, kind)).otherwise(none))
    return F.transform(ordered(F.concat(*found), KINDS, by_start=True), lambda x: F.struct(x["kind"], x["start"], x["end"]))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(versions with their blob, new ledger rows) of a table with doc_id and text; other columns go along.

    One row of each unseen blob is scanned, also where rows repeat an id and a text or have no id. A null text is the
    empty text. Rows that share an id but not a text are versions of their own; an empty table adds nothing to the ledger.
    """
    named = versions.drop("blob").withColumn("blob", F.unhex(F.sha2(text_or_empty(), 256)))
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    blobs = named.select("blob", text_or_empty().alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    rows = blobs.join(seen, "blob", "left_anti").select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("text")).alias("spans"))
    return named, materialize(rows, "ledger")


def findings(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """Every version with the spans found in its blob, now or by an earlier scan (column ``spans``; text is dropped)."""
    spark = versions.sparkSession
    old = ledger if ledger is not None else empty_ledger(spark)
    named, new = scan_new(versions, old, rule_version)
    known = old.filter(F.col("rule_version") == rule_version).select("blob", "spans").unionByName(new.select("blob", "spans")) if ledger is not None else new.select("blob", "spans")
    found = known.filter(F.size("spans") > 0)
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return named.drop("text", "spans").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents against an empty ledger."""
    found = findings(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
