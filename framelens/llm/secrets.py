"""Operator 4: secret scans with an incremental blob ledger (native).

Every version of a text is content-addressed (SHA-256 of the text is its
blob). The ledger holds one row per (blob, rule, rule version) with the spans
found, so a run scans only pairs that the ledger does not hold: new blobs with
all rules, old blobs with new or re-versioned rules. Findings are joined back
to every path (document) that holds the blob. All steps are DataFrame and SQL
functions.

Spans are code points, end exclusive. A rule's matches are leftmost and do
not overlap; the gaps between them (``split``) give their places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """``value``: the group whose length counts (0: the whole match)."""
    name: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" \
    + either_case("api") + "_?" + either_case("key")

# Base rules first, in the order in which equal starts are listed. A run that is too short for
# `access` or `hex` holds no longer one, so their least length stands in the pattern.
BASE = (
    Rule("assign", 1, "(" + KEYWORDS + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
# A key runs from its marker over the headers of an encrypted key and the base64 body (line breaks may be written
# as \n) through the END line; without one it ends at the first character that a body cannot hold.
PEM = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
       r"(?:[\x20\t\r\nrn\\]*Proc-Type:\x20*[0-9]+,[A-Z-]+)?(?:[\x20\t\r\nrn\\]*DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+)?"
       r"[A-Za-z0-9+/=\x20\t\r\n\\]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
EXTRA = (
    Rule("pem", 2, PEM),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + EXTRA


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches in ``text``."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(rule.value)) if rule.value else found
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    empty = F.array().cast(SPANS)
    scanned = F.aggregate(
        rows, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.length(m["found"])).alias("at"),
            F.when(F.length(m["value"]) >= rule.least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(m["gap"])).alias("start"),
                (acc["at"] + F.length(m["gap"]) + F.length(m["found"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return F.when(text.rlike(rule.pattern), scanned["spans"]).otherwise(empty)


def blob(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Ledger rows of the (blob, rule, version) pairs that ``ledger`` lacks.

    Each unseen blob is read once, from the version with the smallest doc_id.
    A null text is the empty blob; a null doc_id counts as the smallest id.
    """
    path = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("bigint"))
    firsts = docs.groupBy(blob().alias("_blob")).agg(F.min(path).alias("_path"))
    wanted = firsts.withColumn("_due", F.array(*[F.lit(r.name) for r in rules]))
    if ledger is not None:
        known = F.concat_ws(":", "rule", "version")
        done = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set(known).alias("_done"))
        due = F.filter(F.array(*[F.concat(F.lit(f"{r.name}:{r.version}")) for r in rules]),
                       lambda x: ~F.array_contains(F.coalesce(F.col("_done"), F.array().cast("array<string>")), x))
        wanted = (firsts.join(done, "_blob", "left")
                  .withColumn("_due", F.transform(due, lambda x: F.substring_index(x, ":", 1)))
                  .filter(F.size("_due") > 0).drop("_done"))
    texts = docs.select(blob().alias("_blob"), path.alias("_path"),
                        F.coalesce("text", F.lit("")).alias("_text"))
    due = texts.join(wanted, ["_blob", "_path"])
    spans = F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
        F.when(F.array_contains("_due", r.name), match_spans(F.col("_text"), r)).alias("spans")) for r in rules])
    return due.select(F.col("_blob").alias("blob"), F.explode(F.filter(spans, lambda s: s["spans"].isNotNull()))
                      .alias("s")).select("blob", "s.rule", "s.version", "s.spans")


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Add ``secrets``: all spans of the row's blob as (start, ord, end, rule), sorted.

    Every row keeps its columns; rows without findings have an empty array.
    ``ord`` is the rule's place in ``rules``. Repeated ledger rows count once.
    """
    order = F.lit(len(rules))
    for i, r in enumerate(rules):
        order = F.when((F.col("rule") == r.name) & (F.col("version") == r.version), i).otherwise(order)
    hits = (ledger.withColumn("_ord", order).filter(F.col("_ord") < len(rules))
            .filter(F.size("spans") > 0)
            .select("blob", F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), F.col("_ord").alias("ord"), s["end"].alias("end"),
                F.col("rule").alias("rule"))).alias("_s"))
            .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("secrets")))
    rows = docs.withColumn("_blob", blob())
    out = rows.join(hits.withColumnRenamed("blob", "_blob"), "_blob", "left")
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,rule:string>>")
    return out.withColumn("secrets", F.coalesce("secrets", none)).drop("_blob")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """``(docs with secrets, ledger rows added)``; see ``scan_new`` and ``findings``."""
    new = scan_new(docs, ledger, rules)
    both = new if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(new)
    return findings(docs, both, rules), new


def redact(docs: DataFrame, rules=RULES, mask: str = "[secret]") -> DataFrame:
    """Texts with every span replaced by ``mask``; overlapping spans share one mask.

    Columns stay as they are; ``n_chars``, if there, follows the new text.
    Null texts stay null, rows are never dropped.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id"), F.col("text"))
    found, _ = scan(packed, None, rules)
    cut = F.aggregate(
        F.col("secrets"), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"),
                                        (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
            .otherwise(acc["out"]).alias("out")))
    rest = F.substring(F.col("text"), (F.col("_cut.at") + 1).cast("int"), F.length("text"))
    new = F.when(F.size("secrets") > 0, F.concat(F.col("_cut.out"), rest)).otherwise(F.col("text"))
    out = found.withColumn("_cut", F.when(F.size("secrets") > 0, cut)).withColumn("_new", new)
    cols = []
    for field in docs.schema.fields:
        col = F.col(f"_doc.`{field.name}`")
        if field.name == "text":
            col = F.col("_new")
        elif field.name == "n_chars":
            col = F.when(F.size("secrets") > 0, F.length("_new").cast(field.dataType)).otherwise(col)
        cols.append(col.alias(field.name))
    return out.select(*cols)
