"""Extension points: detectors by name, value functions for SQL users."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.bank import Pattern
from redactory.functions.dialect import java
from redactory.functions.values import KINDS

_detectors: dict[str, Callable[[DataFrame], DataFrame]] = {}
SPAN_COLUMNS = ["doc_id", "span_start", "span_end", "type", "confidence"]


def register_detector(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """A detector turns doc_id, text into rows of SPAN_COLUMNS; a later one of the same name replaces it."""
    _detectors[name] = fn


def run_detectors(texts: DataFrame, *names: str) -> DataFrame:
    """Spans of the named detectors, with the name as source; an unknown name adds nothing."""
    out = None
    for n in names:
        if n in _detectors:
            one = _detectors[n](texts).select(*SPAN_COLUMNS).selectExpr("*", f"'{n}' AS source")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else texts.sparkSession.createDataFrame([], "doc_id long, span_start int, span_end int, type string, confidence double, source string")


def register_table_detector(spark: SparkSession, name: str, make: Callable[[], Callable[[str], Iterable[tuple[str, int, int, float]]]]) -> None:
    """Make a Python detector callable from SQL as a table function: text -> rows (type, start, stop, confidence).

    make() is called once in a task; what it gives takes a text and yields spans. Rows
    travel in Arrow batches. Use it with a lateral join: FROM t, LATERAL name(t.text).
    (Functions over whole Arrow arrays are not allowed there.) A null text has no spans.
    """

    class Detector:
        def __init__(self):
            self.spans = make()

        def eval(self, text: str) -> Iterator[tuple[str, int, int, float]]:
            if text is not None:
                yield from self.spans(text)

    spark.udtf.register(name, F.udtf(Detector, returnType="type string, start int, stop int, confidence double", useArrow=True))


def pattern_detector(patterns: Sequence[Pattern], confidence: Callable[[Pattern], float]) -> Callable[[], Callable[[str], list[tuple[str, int, int, float]]]]:
    """A detector for register_table_detector from patterns of the bank that need no validator."""
    if any(p.validator for p in patterns):
        raise ValueError("patterns with validators are not for this detector")
    sources = [(p.type, java(p.regex), re.A | (re.I if p.ignore_case else 0), confidence(p)) for p in patterns]

    def make() -> Callable[[str], list[tuple[str, int, int, float]]]:
        compiled = [(t, re.compile(x, flags), c) for t, x, flags, c in sources]
        return lambda text: [(t, m.start(), m.end(), c) for t, x, c in compiled for m in x.finditer(text)]

    return make


#: Value functions in SQL: name, arguments, result, body.
FUNCTIONS = [
    ("mask_digits", "v STRING", "STRING", "regexp_replace(v, '[0-9]', 'X')"),
    ("value_fingerprint", "v STRING", "STRING", "substr(sha2(v, 256), 1, 8)"),
    ("valid_ssn", "v STRING", "BOOLEAN", "regexp_replace(v, '[^0-9]', '') RLIKE '^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$'"),
    ("card_network", "v STRING", "STRING", "CASE WHEN v RLIKE '^4' THEN 'visa' WHEN v RLIKE '^5[1-5]' THEN 'mastercard' WHEN v RLIKE '^3[47]' THEN 'amex' WHEN v RLIKE '^6(011|5)' THEN 'discover' ELSE 'generic' END"),
]


_KIND = "CASE " + " ".join(f"WHEN trim(v) RLIKE r'{x}\\z' THEN '{k}'" for k, x in KINDS) + " ELSE 'none' END"
FUNCTIONS.append(("value_format", "v STRING", "STRING", _KIND))


def register_functions(spark: SparkSession) -> None:
    """Make the value functions callable from SQL in this session."""
    for name, args, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
