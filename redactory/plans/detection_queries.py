"""Queries of the detectors, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.bank import BANK
from redactory.functions.dialect import quoted, re2
from redactory.functions.spans import sql_spans
from redactory.functions.values import SQL_LUHN, SQL_VALIDATORS, VALIDATORS, valid_luhn, valid_phone_digits, valid_ssn, valid_ssn_loose
from redactory.operators import detect as d
from redactory.sources.corpus import TEXTS_SQL, documents, texts

KEYWORDS = [("kw1", "Patient"), ("kw2", "salary"), ("kw3", "production server"), ("kw4", "disgusting"), ("kw5", "The And")]
REGEXES = [("rx1", r"\bproj(?:ect)?-\d+"), ("rx2", r"[a-z]+shire\b"), ("rx3", r"(?:oak|elm) street"), ("rx4", "("), ("rx5", "x*")]
QUERIES, SQL = {}, {}


def detector_sql(p, carry: str = "doc_id, text", out: str = "doc_id, span_start, span_end") -> str:
    where = f" WHERE {SQL_VALIDATORS[p.validator]}" if p.validator else ""
    return f"""SELECT {out}, {quoted(p.type)} AS type, {quoted(p.severity)} AS severity, CAST({d.confidence_of(p)!r} AS DOUBLE) AS confidence
        FROM ({sql_spans(TEXTS_SQL, p.regex, p.ignore_case, carry)}){where}"""


for _p in BANK:
    QUERIES[_p.op] = lambda s, sf, p=_p: d.detect(texts(s, sf), p)
    SQL[_p.op] = detector_sql(_p)

ALL_SQL = " UNION ALL ".join(detector_sql(p, out=f"doc_id, span_start, span_end, {quoted(p.display_name)} AS display_name") for p in BANK)
QUERIES["detect_all_builtin"] = lambda s, sf: d.detect_all(texts(s, sf))
SQL["detect_all_builtin"] = ALL_SQL

#: doc_id, span_start, span_end, type, severity, confidence, value, prio for all built-in spans.
SPANS_SQL = " UNION ALL ".join(detector_sql(p, out=f"doc_id, span_start, span_end, value, {i} AS prio, {quoted(p.display_name)} AS display_name") for i, p in enumerate(BANK))


def _sql_screen(text: str = "text") -> str:
    tests = " OR ".join(f"regexp_matches({text}, {quoted(re2(p, i))})" for p, i in d.SCREEN)
    return f"(CASE WHEN length({text}) < 8 THEN false ELSE {tests} OR (contains({text}, 'BEGIN') AND contains({text}, 'PRIVATE KEY')) END)"


QUERIES["quick_check"] = lambda s, sf: texts(s, sf).select("doc_id", d.quick_check(F.col("text")).alias("may_hold"), d.quick_check(F.substring("text", -12, 12)).alias("tail_may_hold"))
SQL["quick_check"] = f"SELECT doc_id, {_sql_screen()} AS may_hold, {_sql_screen('right(text, 12)')} AS tail_may_hold FROM ({TEXTS_SQL})"


def _quick_custom(s, sf) -> DataFrame:
    good, _ = d.valid_patterns(s, REGEXES)
    text = F.col("text")
    hit = F.lit(False)
    for _, k in KEYWORDS:
        hit = hit | F.contains(F.lower(text), F.lit(k.lower()))
    for _, p in good:
        hit = hit | text.rlike(d.java(p, True))
    return texts(s, sf).select("doc_id", hit.alias("custom_hit"))


_GOOD = REGEXES[:3]
QUERIES["quick_check_custom"] = _quick_custom
SQL["quick_check_custom"] = "SELECT doc_id, " + " OR ".join([f"contains(lower(text), {quoted(k.lower())})" for _, k in KEYWORDS] + [f"regexp_matches(text, {quoted(re2(p, True))})" for _, p in _GOOD]) + f" AS custom_hit FROM ({TEXTS_SQL})"

_PHONE = "length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 10 AND 11"
_LOOSE = "(length(regexp_replace({v}, '[^0-9]', '', 'g')) = 9 AND substr(regexp_replace({v}, '[^0-9]', '', 'g'), 1, 3) NOT IN ('000', '666') AND substr(regexp_replace({v}, '[^0-9]', '', 'g'), 1, 1) <> '9')"
_FIRST_SQL = {"phone": _PHONE, "ssn_loose": _LOOSE, "luhn": SQL_LUHN.replace("value", "{v}")}


def _first_sql() -> str:
    cases = []
    for name, regex, ignore, check in d.BLOCKING:
        p = quoted(re2(regex, ignore))
        test = f"regexp_matches(text, {p})"
        if check:
            test += f" AND {_FIRST_SQL[check].replace('{v}', f'regexp_extract(text, {p})')}"
        cases.append(f"WHEN {test} THEN {quoted(name)}")
    return "CASE " + " ".join(cases) + " END"


QUERIES["first_match_block"] = lambda s, sf: texts(s, sf).select("doc_id", d.first_match_block(F.col("text")).alias("first_match"))
SQL["first_match_block"] = f"SELECT doc_id, {_first_sql()} AS first_match FROM ({TEXTS_SQL})"

QUERIES["route_short"] = lambda s, sf: texts(s, sf).select("doc_id", d.route_short(F.col("text")).alias("route"), d.route_short(F.substring("text", -24, 24)).alias("tail_route"), d.route_short(F.substring("text", -12, 12)).alias("short_route"))
_ROUTE = "CASE WHEN length(trim({t})) = 0 THEN 'allow' WHEN length(trim({t})) < 20 THEN CASE WHEN {q} THEN 'block' ELSE 'allow' END ELSE 'scan' END"
SQL["route_short"] = f"SELECT doc_id, {_ROUTE.format(t='text', q=_sql_screen())} AS route, {_ROUTE.format(t='right(text, 24)', q=_sql_screen('right(text, 24)'))} AS tail_route, {_ROUTE.format(t='right(text, 12)', q=_sql_screen('right(text, 12)'))} AS short_route FROM ({TEXTS_SQL})"

_DIGITED = r"\b[0-9][0-9 .-]{7,22}[0-9]\b"
_DIGITED_SQL = sql_spans(TEXTS_SQL, _DIGITED)


def _digited(s, sf) -> DataFrame:
    return d.explode_spans(texts(s, sf).select("doc_id", d.spans(F.col("text"), _DIGITED).alias("spans")))


for _name, _test, _sql in (
    ("valid_ssn", valid_ssn, SQL_VALIDATORS["ssn"]),
    ("valid_luhn", valid_luhn, SQL_LUHN),
    ("valid_phone_digits", valid_phone_digits, _PHONE.replace("{v}", "value")),
    ("valid_ssn_loose", valid_ssn_loose, _LOOSE.replace("{v}", "value")),
):
    QUERIES[_name] = lambda s, sf, t=_test, n=_name: _digited(s, sf).select("doc_id", "span_start", t(F.col("value")).alias("valid"))
    SQL[_name] = f"SELECT doc_id, span_start, {_sql} AS valid FROM ({_DIGITED_SQL})"
_AWSISH = r"\bA[A-Z0-9]{3,24}\b"
QUERIES["valid_aws_key"] = lambda s, sf: d.explode_spans(texts(s, sf).select("doc_id", d.spans(F.col("text"), _AWSISH).alias("spans"))).select("doc_id", "span_start", VALIDATORS["aws"](F.col("value")).alias("valid"))
SQL["valid_aws_key"] = f"SELECT doc_id, span_start, {SQL_VALIDATORS['aws']} AS valid FROM ({sql_spans(TEXTS_SQL, _AWSISH)})"

QUERIES["detect_custom_keyword"] = lambda s, sf: d.keyword_spans(texts(s, sf), s.createDataFrame(KEYWORDS, "pattern_id string, keyword string"))
SQL["detect_custom_keyword"] = f"""
    WITH k(pattern_id, keyword) AS (VALUES {', '.join(f"({quoted(a)}, {quoted(b)})" for a, b in KEYWORDS)}), t AS ({TEXTS_SQL})
    SELECT doc_id, pattern_id, CAST(p AS INTEGER) AS span_start, CAST(p + n AS INTEGER) AS span_end, 'custom' AS type, CAST(0.9 AS DOUBLE) AS confidence
    FROM (SELECT doc_id, pattern_id, n, unnest(list_transform(g[1:len(g) - 1], lambda x, i: list_sum(list_transform(g[1:i], lambda y: length(y))) + (i - 1) * n)) AS p
          FROM (SELECT doc_id, pattern_id, length(keyword) AS n, string_split(lower(text), lower(keyword)) AS g FROM t JOIN k ON contains(lower(text), lower(keyword))))"""


def _custom(s, sf) -> DataFrame:
    return d.custom_regex_spans(texts(s, sf), d.valid_patterns(s, REGEXES)[0])


QUERIES["detect_custom_regex"] = _custom
SQL["detect_custom_regex"] = " UNION ALL ".join(f"SELECT doc_id, {quoted(i)} AS pattern_id, span_start, span_end, 'custom' AS type, CAST(0.85 AS DOUBLE) AS confidence FROM ({sql_spans(TEXTS_SQL, p, True)})" for i, p in _GOOD)
QUERIES["scan_documents"] = lambda s, sf: documents(s, sf).select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
SQL["scan_documents"] = "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents"
