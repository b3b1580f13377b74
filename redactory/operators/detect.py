"""Built-in, custom and screening detectors over a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.bank import BANK, BOOST, SEVERITY_RANK, Pattern
from redactory.functions.dialect import java
from redactory.functions.spans import explode_spans, exploded, screened, spans
from redactory.functions.values import VALIDATORS, valid_luhn, valid_phone_digits, valid_ssn_loose
from redactory.operators import tenants

SPAN = "array<struct<start:int,stop:int,value:string,type:string,display_name:string,severity:string,confidence:double,prio:int>>"


def confidence_of(p: Pattern) -> float:
    """Validated kinds gain a little, up to 1."""
    return min(1.0, p.confidence + BOOST) if p.validator else p.confidence


def pattern_spans(text: Column, p: Pattern, prio: int = 0, held: Column | None = None) -> Column:
    """The pattern's valid spans, with type, severity and confidence."""
    found = spans(text, p.regex, p.ignore_case, p.needs, held)
    if p.validator:
        found = F.filter(found, lambda s: VALIDATORS[p.validator](s["value"]))
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), F.lit(p.type).alias("type"), F.lit(p.display_name).alias("display_name"),
            F.lit(p.severity).alias("severity"), F.lit(confidence_of(p)).alias("confidence"), F.lit(prio).alias("prio"),
        ),
    )


def builtin_spans(text: Column) -> Column:
    """All built-in detectors in one projection over one scan; a detector runs over the texts that may hold its pattern."""
    held = screened(text, [(p.regex, p.ignore_case) for p in BANK])
    return F.concat(*(pattern_spans(text, p, i, F.array_contains(held, i)) for i, p in enumerate(BANK)))


def gravest(text: Column) -> Column:
    """Severity of a text's gravest built-in span, or null: kinds are looked for from the gravest down until one is there, without places."""
    held = screened(text, [(p.regex, p.ignore_case) for p in BANK])

    def there(i: int, p: Pattern) -> Column:
        own = java(p.regex, p.ignore_case)
        hit = F.exists(F.regexp_extract_all(text, F.lit(own), F.lit(0)), VALIDATORS[p.validator]) if p.validator else text.rlike(own)
        return F.array_contains(held, i) & hit

    order = sorted(enumerate(BANK), key=lambda x: -SEVERITY_RANK[x[1].severity])
    return F.coalesce(*(F.when(there(i, p), p.severity) for i, p in order))


def long_form(df: DataFrame, column: str = "spans") -> DataFrame:
    """One row per span; values are left out on request of the sink, so keep them here only while needed."""
    rest = [c for c in df.columns if c != column]
    return exploded(df, *rest, array=column, alias="_s").select(
        *rest, F.col("_s.start").alias("span_start"), F.col("_s.stop").alias("span_end"), F.col("_s.type").alias("type"), F.col("_s.display_name").alias("display_name"),
        F.col("_s.severity").alias("severity"), F.col("_s.confidence").alias("confidence"), F.col("_s.value").alias("value"), F.col("_s.prio").alias("prio"),
    )


def detect(df: DataFrame, p: Pattern) -> DataFrame:
    """One detector over doc_id, text: rows without the matched value."""
    return long_form(df.select("doc_id", pattern_spans(F.col("text"), p).alias("spans"))).select("doc_id", "span_start", "span_end", "type", "severity", "confidence")


def detect_all(df: DataFrame, keep_value: bool = False) -> DataFrame:
    out = long_form(df.select("doc_id", builtin_spans(F.col("text")).alias("spans")))
    return out if keep_value else out.drop("value", "prio")


# The cheap screen's tests, in order.
SCREEN = [
    (r"\d{3}[-.\s]?\d{2}[-.\s]?\d{4}", False),
    (r"[3456]\d{3}[-\s]?\d{4}", False),
    (r"AKIA|ABIA|ACCA|ASIA", False),
    (r"sk-[A-Za-z0-9]{10,}", False),
    (r"api[_-]?key|apikey", True),
    (r"\b[^\s@]+@[^\s@]+\.[a-z]{2,}", True),
    (r"(?:sk|pk|rk)_(?:live|test)_", False),
    (r"xox[baprs]-", False),
    (r"aws_secret_access_key|secret_access_key|SecretAccessKey", True),
    (r"[Bb]earer\s+[A-Za-z0-9_\-.]{20,}", False),
]


def quick_check(text: Column) -> Column:
    """Cheap screen: may the text hold something? Not a superset of the detectors, so never a prefilter for them."""
    tests = [text.rlike(java(p, i)) for p, i in SCREEN] + [F.contains(text, F.lit("BEGIN")) & F.contains(text, F.lit("PRIVATE KEY"))]
    return F.when(F.length(text) < 8, F.lit(False)).otherwise(reduce(lambda a, b: a | b, tests))


# The blocking check's patterns, in order; the validator sees the first hit only.
BLOCKING = [
    ("Email Address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False, None),
    ("Phone Number", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", False, "phone"),
    ("Social Security Number", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", False, "ssn_loose"),
    ("Credit Card Number", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", False, "luhn"),
    ("API Key", r"\b(?:sk|api|key)[-_]?[a-zA-Z0-9]{20,}\b", True, None),
    ("AWS Access Key", r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", False, None),
    ("Private Key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", False, None),
    ("GitHub Token", r"\b(?:ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})\b", False, None),
]
_FIRST = {"phone": valid_phone_digits, "ssn_loose": valid_ssn_loose, "luhn": valid_luhn}


def first_match_block(text: Column) -> Column:
    """Name of the first pattern that matches, or null."""

    def hit(regex: str, ignore: bool, check: str | None) -> Column:
        p = java(regex, ignore)
        return text.rlike(p) & (_FIRST[check](F.regexp_extract(text, p, 0)) if check else F.lit(True))

    return F.coalesce(*(F.when(hit(r, i, c), F.lit(name)) for name, r, i, c in BLOCKING))


def route_short(text: Column) -> Column:
    """allow for empty texts, the screen's answer for short ones, a full scan for the rest."""
    size = F.length(F.trim(text))
    return F.when(size == 0, "allow").when(size < 20, F.when(quick_check(text), "block").otherwise("allow")).otherwise("scan")


def keyword_spans(df: DataFrame, keywords: DataFrame) -> DataFrame:
    """All occurrences, overlapping ones too, of each keyword (pattern_id, keyword), whatever the case; blank keywords have none.

    One automaton pass over each text, as for a tenant's keywords, with all documents as one tenant's.
    """
    one = F.lit(0).cast("long")
    usable = keywords.where(F.trim("keyword") != "").select(one.alias("tenant_id"), "pattern_id", one.alias("seq"), F.col("pattern_id").alias("name"), F.lit("keyword").alias("kind"), F.col("keyword").alias("value"))
    found = tenants.tenant_spans(df.select("doc_id", one.alias("tenant_id"), "text"), usable)
    return found.select("doc_id", "pattern_id", "span_start", "span_end", "type", "confidence")


def custom_regex_spans(df: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Tenant patterns, case-insensitive, each compiled once as a literal."""

    def tagged(i: str, p: str) -> Column:
        return F.transform(spans(F.col("text"), p, True), lambda s: F.struct(F.lit(i).alias("pattern_id"), s["start"].alias("start"), s["stop"].alias("stop")))

    every = F.concat(*(tagged(i, p) for i, p in patterns))
    return exploded(df, "doc_id", array=every, alias="s").select("doc_id", "s.pattern_id", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), F.lit("custom").alias("type"), F.lit(0.85).alias("confidence"))


def valid_patterns(spark, patterns: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Split patterns into usable and rejected: bad syntax, able to match nothing, or of nested open repeats."""
    good, bad = [], []
    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    for i, p in patterns:
        try:
            (bad if compiler.compile(p).matcher("").find() or tenants.nested_quantifiers(p) else good).append((i, p))
        except IllegalArgumentException:  # what the JVM's syntax error arrives as
            bad.append((i, p))
    return good, bad


__all__ = ["BANK", "BLOCKING", "SCREEN", "builtin_spans", "custom_regex_spans", "detect", "detect_all", "explode_spans", "first_match_block", "gravest", "keyword_spans", "long_form", "pattern_spans", "quick_check", "route_short", "valid_patterns"]
