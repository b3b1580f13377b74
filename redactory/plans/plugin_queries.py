"""Queries of the extension points, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.functions.bank import BANK
from redactory.functions.values import KINDS, SQL_VALIDATORS
from redactory.operators import detect as d
from redactory.operators import plugins
from redactory.plans.detection_queries import detector_sql
from redactory.plans.policy_queries import SPANS_SQL, spans
from redactory.sources.corpus import texts

QUERIES, SQL = {}, {}
_EMAIL = next(p for p in BANK if p.op == "detect_email")


def _plugged(s, sf):
    plugins.register_detector("mail", lambda t: d.detect(t, _EMAIL))
    return plugins.run_detectors(texts(s, sf), "mail", "not there")


QUERIES["registered_detectors"] = _plugged
SQL["registered_detectors"] = f"SELECT doc_id, span_start, span_end, type, confidence, 'mail' AS source FROM ({detector_sql(_EMAIL)})"


def _functions(s, sf):
    plugins.register_functions(s)
    return spans(s, sf).select("doc_id", "span_start", "type", F.expr("mask_digits(value)").alias("shape"), F.expr("value_fingerprint(value)").alias("fingerprint"), F.expr("valid_ssn(value)").alias("ssn"))


QUERIES["sql_functions"] = _functions
SQL["sql_functions"] = f"SELECT doc_id, span_start, type, regexp_replace(value, '[0-9]', 'X', 'g') AS shape, substr(sha256(value), 1, 8) AS fingerprint, {SQL_VALIDATORS['ssn']} AS ssn FROM ({SPANS_SQL})"


#: Kinds whose patterns need no validator.
_PLAIN = [p for p in BANK if p.op in ("detect_email", "detect_ipv4", "detect_kv_secret", "detect_conn_string", "detect_jwt")]


def _lateral(s, sf):
    """A Python detector as a table function, called from SQL for each text."""
    plugins.register_table_detector(s, "plain_secrets", plugins.pattern_detector(_PLAIN, d.confidence_of))
    texts(s, sf).createOrReplaceTempView("texts_for_plain_secrets")
    return s.sql("SELECT t.doc_id, d.type, d.start AS span_start, d.stop AS span_end, d.confidence FROM texts_for_plain_secrets t, LATERAL plain_secrets(t.text) d")


QUERIES["lateral_detector"] = _lateral
SQL["lateral_detector"] = " UNION ALL ".join(f"SELECT doc_id, type, span_start, span_end, confidence FROM ({detector_sql(p)})" for p in _PLAIN)


def _formats(s, sf):
    plugins.register_functions(s)
    return spans(s, sf).select("doc_id", "span_start", "type", F.expr("value_format(value)").alias("format"))


QUERIES["sql_value_format"] = _formats
_FORMAT = "CASE " + " ".join(f"WHEN regexp_full_match(trim(value), '{x[1:]}') THEN '{k}'" for k, x in KINDS) + " ELSE 'none' END"
SQL["sql_value_format"] = f"SELECT doc_id, span_start, type, {_FORMAT} AS format FROM ({SPANS_SQL})"
