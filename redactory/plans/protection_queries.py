"""Queries of merging, masking, surrogates, hashes and audit facts, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactory.functions import values as v
from redactory.functions.bank import ACTION_RANK, SEVERITY_RANK
from redactory.functions.spans import exploded
from redactory.operators import detect as d
from redactory.operators import merge as m
from redactory.operators import policy as p
from redactory.operators import redact as r
from redactory.operators import surrogate as g
from redactory.plans.policy_queries import SQL as POLICY_SQL
from redactory.plans.policy_queries import SEV, SEV_BACK, SPANS_SQL, acted, acted_sql, case, spans, spans_in_text
from redactory.sources import corpus as c
from redactory.sources import storage as st

QUERIES, SQL = {}, {}
VALUE = "type, value FROM (" + SPANS_SQL + ")"

# masks and hashes
QUERIES["mask_placeholder"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", v.mask_placeholder(F.col("display_name")).alias("mask"))
SQL["mask_placeholder"] = f"SELECT doc_id, span_start, '[' || regexp_replace(upper(display_name), '\\s+', '_', 'g') || ']' AS mask FROM ({SPANS_SQL})"
QUERIES["mask_digits"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", v.mask_digits(F.col("value")).alias("shape"))
SQL["mask_digits"] = f"SELECT doc_id, span_start, regexp_replace(value, '[0-9]', 'X', 'g') AS shape FROM ({SPANS_SQL})"
QUERIES["preview"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", v.preview(F.col("value")).alias("preview"))
SQL["preview"] = f"SELECT doc_id, span_start, substr(value, 1, 4) || '...' AS preview FROM ({SPANS_SQL})"
QUERIES["preview_limit"] = lambda s, sf: c.documents(s, sf).select("doc_id", v.shortened(F.col("text"), 500).alias("preview"))
SQL["preview_limit"] = "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 499) || '…' ELSE text END AS preview FROM documents"
QUERIES["content_sha256"] = lambda s, sf: c.documents(s, sf).select("doc_id", v.content_sha256(F.col("text")).alias("content_hash"))
SQL["content_sha256"] = "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents"
QUERIES["value_fingerprint"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", v.fingerprint(F.col("value")).alias("fingerprint"))
SQL["value_fingerprint"] = f"SELECT doc_id, span_start, substr(sha256(value), 1, 8) AS fingerprint FROM ({SPANS_SQL})"
QUERIES["content_hmac"] = lambda s, sf: c.documents(s, sf).select("doc_id", v.content_hmac(F.col("text"), F.concat((F.col("doc_id") % 25).cast("string"), F.lit("|"), F.col("source"))).alias("content_hmac"))
_PAD = "unhex(list_aggregate(list_transform(range(0, 64), lambda i: printf('%02x', xor(CASE WHEN i < length(k) THEN ascii(k[i + 1]) ELSE 0 END, {b}))), 'string_agg', ''))"
SQL["content_hmac"] = f"SELECT doc_id, 'hmac-sha256:' || sha256({_PAD.format(b=92)} || unhex(sha256({_PAD.format(b=54)} || encode(text)))) AS content_hmac FROM (SELECT doc_id, text, CAST(doc_id % 25 AS VARCHAR) || '|' || source AS k FROM documents)"
QUERIES["content_hash32"] = lambda s, sf: c.documents(s, sf).select("doc_id", v.hash32(F.col("text")).alias("hash32"))
SQL["content_hash32"] = "SELECT doc_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash32 FROM (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda ch: unicode(ch)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM documents)"
QUERIES["content_dedup"] = lambda s, sf: c.documents(s, sf).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
SQL["content_dedup"] = "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1"
QUERIES["card_network"] = lambda s, sf: spans(s, sf).where("type = 'credit_card'").select("doc_id", "span_start", v.card_network(v.digits(F.col("value"))).alias("network"))
SQL["card_network"] = f"SELECT doc_id, span_start, CASE WHEN d LIKE '4%' THEN 'visa' WHEN regexp_matches(d, '^5[1-5]') THEN 'mastercard' WHEN regexp_matches(d, '^3[47]') THEN 'amex' WHEN d LIKE '6011%' OR d LIKE '65%' THEN 'discover' ELSE 'generic' END AS network FROM (SELECT doc_id, span_start, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({SPANS_SQL}) WHERE type = 'credit_card')"

_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(trim(value), '{x[1:]}') THEN '{k}'" for k, x in v.KINDS) + " ELSE 'none' END"
#: Structured values of many shapes: order dates and totals, customer balances and names, and detected spans.
VALUES_SQL = """SELECT CAST(o_orderdate AS STRING) AS value FROM orders UNION ALL SELECT '$' || CAST(CAST(o_totalprice AS BIGINT) AS STRING) AS value FROM orders
    UNION ALL SELECT CAST(c_custkey AS STRING) || '.' || CAST(c_nationkey AS STRING) AS value FROM customer UNION ALL SELECT c_name AS value FROM customer"""


def values_of(s, sf):
    return c.relation(s, sf, VALUES_SQL, "orders", "customer").unionByName(spans(s, sf).select("value"))


ALL_VALUES = f"({VALUES_SQL} UNION ALL SELECT value FROM ({SPANS_SQL}))"
QUERIES["format_profile"] = lambda s, sf: values_of(s, sf).groupBy(v.value_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
SQL["format_profile"] = f"SELECT {_KIND} AS kind, count(*) AS n FROM {ALL_VALUES} GROUP BY 1"


def money_columns(value):
    num = F.trim(F.regexp_replace(value, r"^[$€£¥]", ""))
    mag = F.upper(F.regexp_extract(num, r"([KMBTkmbt])\z", 1))
    body = F.trim(F.regexp_replace(num, r"[KMBTkmbt]\z", ""))
    return [
        F.regexp_extract(value, r"^([$€£¥])", 1).alias("symbol"), mag.alias("magnitude"), F.contains(body, F.lit(",")).alias("commas"),
        F.length(F.regexp_extract(body, r"\.([0-9]*)\z", 1)).alias("decimals"), F.length(F.regexp_replace(F.regexp_replace(body, r"\..*\z", ""), r"[,\s]", "")).alias("digits"),
    ]


_MONEY = "SELECT '$' || CAST(CAST(o_totalprice AS BIGINT) AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '.50' WHEN 1 THEN 'K' ELSE ',000' END AS value, o_orderkey FROM orders"
#: The same for Spark, whose cast to a whole number cuts off, where the SQL twin's rounds, halves to the even one.
_SPARK_MONEY = _MONEY.replace("CAST(o_totalprice AS BIGINT)", "CAST(rint(o_totalprice) AS BIGINT)")
QUERIES["money_format"] = lambda s, sf: c.relation(s, sf, _SPARK_MONEY, "orders").select("o_orderkey", *money_columns(F.col("value")))
SQL["money_format"] = f"""SELECT o_orderkey, regexp_extract(value, '^([$€£¥])', 1) AS symbol, upper(regexp_extract(num, '([KMBTkmbt])$', 1)) AS magnitude, contains(body, ',') AS commas,
    length(regexp_extract(body, '\\.([0-9]*)$', 1)) AS decimals, length(regexp_replace(regexp_replace(body, '\\..*$', ''), '[,\\s]', '', 'g')) AS digits
    FROM (SELECT *, trim(regexp_replace(num, '[KMBTkmbt]$', '')) AS body FROM (SELECT *, trim(regexp_replace(value, '^[$€£¥]', '')) AS num FROM ({_MONEY})))"""


def phone_columns(value):
    rest = F.regexp_replace(value, r"^\+\d{1,3}\s*", "")
    sep = F.when(F.contains(rest, F.lit("-")), "-").when(F.contains(rest, F.lit(".")), ".").when(F.contains(rest, F.lit(" ")), " ").otherwise("")
    return [F.startswith(rest, F.lit("(")).alias("parens"), F.regexp_extract(value, r"^(\+\d{1,3})\s*", 1).alias("prefix"), sep.alias("separator"), F.length(v.digits(rest)).alias("digits"), F.transform(F.filter(F.split(F.trim(F.regexp_replace(rest, "[^0-9]+", " ")), " "), lambda x: x != ""), lambda x: F.length(x)).alias("group_sizes")]


QUERIES["phone_format"] = lambda s, sf: spans(s, sf).where("type = 'phone'").select("doc_id", "span_start", *phone_columns(F.col("value")))
SQL["phone_format"] = f"""SELECT doc_id, span_start, starts_with(rest, '(') AS parens, regexp_extract(value, '^(\\+\\d{{1,3}})\\s*', 1) AS prefix,
    CASE WHEN contains(rest, '-') THEN '-' WHEN contains(rest, '.') THEN '.' WHEN contains(rest, ' ') THEN ' ' ELSE '' END AS separator, length(regexp_replace(rest, '[^0-9]', '', 'g')) AS digits,
    list_transform(regexp_extract_all(rest, '[0-9]+'), lambda x: length(x)) AS group_sizes
    FROM (SELECT *, regexp_replace(value, '^\\+\\d{{1,3}}\\s*', '') AS rest FROM ({SPANS_SQL}) WHERE type = 'phone')"""

# spans: order, merge, redaction
QUERIES["span_index"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", "span_end", "type", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("span_start"), F.desc("span_end"), "type")) - 1).alias("idx"))
SQL["span_index"] = f"SELECT doc_id, span_start, span_end, type, row_number() OVER (PARTITION BY doc_id ORDER BY span_start DESC, span_end DESC, type) - 1 AS idx FROM ({SPANS_SQL})"
for _name, _cols, _order in (
    ("sort_start", ("span_start", "type"), "span_start, type"),
    ("sort_start_conf", ("span_start", "-confidence", "type"), "span_start, -confidence, type"),
    ("sort_replace_desc", ("-span_start", "type"), "-span_start, type"),
    ("sort_longest", ("-length(value)", "value", "type"), "-length(value), value, type"),
):
    QUERIES[_name] = lambda s, sf, k=_cols: spans(s, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*(F.expr(x).alias(f"k{i}") for i, x in enumerate(k)), F.col("span_end").alias("e"), F.col("type").alias("t")))), lambda x: F.concat_ws(":", x["t"], x["e"].cast("string"))).alias("ordered"))
    SQL[_name] = f"SELECT doc_id, list(type || ':' || span_end ORDER BY {_order}, span_end) AS ordered FROM ({SPANS_SQL}) GROUP BY 1"


def _with_source(s, sf):
    """Bank spans, and a second producer that sees card and phone values one character short."""
    one = lambda source, start, confidence: F.struct(start.alias("span_start"), "span_end", "type", F.lit(source).alias("source"), confidence.alias("confidence"))
    other = one("ner", F.col("span_start") + 1, F.col("confidence") + F.when(F.col("doc_id") % 2 == 0, -0.1).otherwise(0.005))
    both = F.array(one("regex", F.col("span_start"), F.col("confidence")), F.when(F.col("type").isin("credit_card", "phone", "email"), other))
    rows = exploded(spans(s, sf), "doc_id", array=both, alias="s").select("doc_id", "s.*")  # one scan serves both
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("source"), "span_start", "span_end", "type")))


TWO_SQL = f"""SELECT doc_id, span_start, span_end, type, 'regex' AS source, confidence FROM ({SPANS_SQL}) UNION ALL
    SELECT doc_id, span_start + 1, span_end, type, 'ner' AS source, confidence + CASE WHEN doc_id % 2 = 0 THEN -0.1 ELSE 0.005 END FROM ({SPANS_SQL}) WHERE type IN ('credit_card', 'phone', 'email')"""
QUERIES["union_sources"] = lambda s, sf: _with_source(s, sf).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total"))
SQL["union_sources"] = f"SELECT source, type, count(*) AS n, round(sum(confidence), 6) AS total FROM ({TWO_SQL}) GROUP BY ALL"
for _name, _fold in (("merge_same_type", m.merge_same_type), ("first_writer_wins", m.first_writer_wins), ("sweep_dedup", m.sweep)):
    QUERIES[_name] = lambda s, sf, f=_fold: m.unfold(m.as_spans(_with_source(s, sf), "doc_id").withColumn("spans", f(F.col("spans"))))


def _fold_sql(step, order):
    """Both producers' spans of a document in order, folded: acc is the list kept so far, x a list of the next one."""
    return f"""SELECT doc_id, s.a AS span_start, s.b AS span_end, s.t AS type, s.p AS source, s.c AS confidence FROM (
      SELECT doc_id, unnest(list_reduce(list([{{'a': span_start, 'b': span_end, 't': type, 'p': source, 'c': confidence}}] ORDER BY {order}), lambda acc, x: {step})) AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source DESC, span_start, span_end, type) AS ord FROM ({TWO_SQL})) GROUP BY doc_id)"""


_SHARED = "(least(o.b, x[1].b) - greatest(o.a, x[1].a))"
_CLASH = f"coalesce(list_position(list_transform(acc, lambda o: o.t = x[1].t AND {_SHARED} > 0 AND {_SHARED} / least(o.b - o.a, x[1].b - x[1].a) > 0.5), true), 0)"
SQL["merge_same_type"] = _fold_sql(f"CASE WHEN {_CLASH} > 0 THEN list_transform(acc, lambda o, i: CASE WHEN i = {_CLASH} AND x[1].c > o.c THEN x[1] ELSE o END) ELSE acc || x END", "ord")
SQL["first_writer_wins"] = _fold_sql("CASE WHEN len(list_filter(acc, lambda o: x[1].a < o.b AND x[1].b > o.a)) > 0 THEN acc ELSE acc || x END", "ord")
SQL["sweep_dedup"] = _fold_sql("CASE WHEN x[1].a >= acc[-1].b THEN acc || x WHEN x[1].b > acc[-1].b AND x[1].c > acc[-1].c THEN acc[1:len(acc) - 1] || x ELSE acc END", "span_start, -confidence, ord")


def _llm_merge(s, sf):
    """Spans of the second producer, the longest first, added to those of the bank but phone numbers; one shuffle by document."""
    both = _with_source(s, sf).where("source = 'ner' OR type <> 'phone'").withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.expr("span_start - span_end"), "span_start", "type")))
    of = lambda name: F.filter("spans", lambda x: x["source"] == name)
    return m.unfold(m.as_spans(both, "doc_id").withColumn("spans", m.added(of("regex"), of("ner")))).select("doc_id", "span_start", "span_end", "type")


QUERIES["llm_merge"] = _llm_merge
SQL["llm_merge"] = f"""SELECT doc_id, k.a AS span_start, k.b AS span_end, k.t AS type FROM (
    SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: o.a < x[1].b AND o.b > x[1].a)) = 0 THEN acc || x ELSE acc END)) AS k FROM (
      SELECT doc_id, list([{{'a': span_start, 'b': span_end, 't': type}}] ORDER BY span_start - span_end, span_start, type) AS l FROM ({TWO_SQL}) a
      WHERE source = 'ner' AND NOT EXISTS (SELECT 1 FROM ({SPANS_SQL}) b WHERE b.type <> 'phone' AND b.doc_id = a.doc_id AND a.span_start < b.span_end AND a.span_end > b.span_start) GROUP BY 1))"""
QUERIES["conf_filter"] = lambda s, sf: _with_source(s, sf).where("confidence >= 0.85").select("doc_id", "span_start", "type", "source")
SQL["conf_filter"] = f"SELECT doc_id, span_start, type, source FROM ({TWO_SQL}) WHERE confidence >= 0.85"
QUERIES["ambiguous_band"] = lambda s, sf: _with_source(s, sf).where(F.col("confidence").between(0.4, 0.8)).select("doc_id", "span_start", "type", "source")
SQL["ambiguous_band"] = f"SELECT doc_id, span_start, type, source FROM ({TWO_SQL}) WHERE confidence BETWEEN 0.4 AND 0.8"
QUERIES["resolve_value"] = lambda s, sf: spans_in_text(s, sf).select("doc_id", "span_start", "span_end", (r.resolve_value(F.col("text"), F.col("span_start"), F.col("span_end")) == F.col("value")).alias("same"), r.resolve_value(F.col("text"), F.col("span_start"), F.length("text") + 1).alias("outside"))
SQL["resolve_value"] = f"SELECT doc_id, span_start, span_end, true AS same, CAST(NULL AS VARCHAR) AS outside FROM ({SPANS_SQL})"
QUERIES["classifier_window"] = lambda s, sf: spans_in_text(s, sf).select("doc_id", "span_start", "type", F.substr("text", F.greatest(F.lit(0), F.col("span_start") - 128) + 1, F.col("span_end") + 128 - F.greatest(F.lit(0), F.col("span_start") - 128)).alias("around"))
SQL["classifier_window"] = f"SELECT doc_id, span_start, type, substr(t.text, greatest(0, span_start - 128) + 1, span_end + 128 - greatest(0, span_start - 128)) AS around FROM ({SPANS_SQL}) JOIN ({c.TEXTS_SQL}) t USING (doc_id)"


def protected(s, sf, replacement):
    """doc_id, protected: every text with its spans replaced, in one projection over one scan."""
    found = c.texts(s, sf).select("doc_id", "text", d.builtin_spans(F.col("text")).alias("spans"))
    return found.select("doc_id", r.redacted(F.col("text"), F.col("spans"), replacement).alias("protected"))


def masked(s, sf):
    return protected(s, sf, lambda x: v.mask_placeholder(x["display_name"]))


QUERIES["redact_text"] = masked
MASK = "'[' || regexp_replace(upper(display_name), '\\s+', '_', 'g') || ']'"
_GAP = "CASE WHEN i = 1 THEN 0 ELSE k[i - 1].b END"
#: The same fold in SQL: spans in order, each that starts after the last one kept, and the text around their masks.
MASKED_SQL = f"""SELECT t.doc_id, CASE WHEN k IS NULL THEN text ELSE
    list_aggregate(list_transform(k, lambda s, i: substr(text, {_GAP} + 1, s.a - {_GAP}) || s.m), 'string_agg', '') || substr(text, k[len(k)].b + 1) END AS protected
    FROM ({c.TEXTS_SQL}) t LEFT JOIN (
      SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].a >= acc[-1].b THEN acc || x ELSE acc END) AS k FROM (
        SELECT doc_id, list([{{'a': span_start, 'b': span_end, 'm': {MASK}}}] ORDER BY span_start, -span_end, {MASK}) AS l FROM ({SPANS_SQL}) GROUP BY doc_id)) f ON t.doc_id = f.doc_id"""
SQL["redact_text"] = MASKED_SQL
SQL["sink_protected"] = f"SELECT doc_id, length(protected) AS chars, sha256(protected) AS content_hash FROM ({MASKED_SQL})"
QUERIES["sink_protected"] = lambda s, sf: st.cut(masked(s, sf), "protected").select("doc_id", F.length("protected").alias("chars"), F.sha2(F.col("protected").cast("binary"), 256).alias("content_hash"))
QUERIES["protect_text"] = lambda s, sf: protected(s, sf, lambda x: F.when(F.col("doc_id") % 4 == 0, x["value"]).when(F.col("doc_id") % 4 == 1, F.lit("<custom>")).when(F.col("doc_id") % 4 == 2, v.mask_placeholder(x["display_name"])).otherwise(g.surrogate(x["type"], x["value"])))
QUERIES["replacement_chosen"] = lambda s, sf: spans(s, sf).select("doc_id", "span_start", "type", r.chosen(F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).when(F.col("doc_id") % 3 == 1, v.mask_placeholder(F.col("display_name"))).otherwise(F.col("value"))).alias("choice"))
SQL["replacement_chosen"] = f"SELECT doc_id, span_start, type, CASE doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'masked' ELSE 'dummy' END AS choice FROM ({SPANS_SQL})"

# surrogates
QUERIES["surrogate_map"] = lambda s, sf: g.surrogate_map(spans(s, sf)).select("type", v.fingerprint(F.col("value")).alias("fingerprint"), "surrogate")
QUERIES["surrogate_ip"] = lambda s, sf: g.surrogate_map(spans(s, sf).where("type = 'ip_address'")).select("type", "value", "surrogate")
SQL["surrogate_ip"] = f"SELECT DISTINCT type, value, '192.0.2.1' AS surrogate FROM ({SPANS_SQL}) WHERE type = 'ip_address'"
#: Names of one, two and three words, some with a title or suffix.
NAMES_SQL = """SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Dr. ' || c_name || ' ' || c_mktsegment WHEN 2 THEN c_name || ' ' || c_mktsegment || ' Ann Jr.' ELSE 'Miss ' || c_name END AS value, c_custkey % 4 AS k FROM customer"""
QUERIES["surrogate_name"] = lambda s, sf: c.relation(s, sf, NAMES_SQL, "customer").select(F.lit("person_name").alias("type"), "value").transform(g.surrogate_map)
_FIRST, _LAST = (f"{names!r}[{g.sql_draw(k, 8)} + 1]" for k, names in enumerate((g.FIRST, g.LAST)))
_MIDDLE = f"CASE WHEN {g.sql_draw(10, 3)} = 0 THEN chr(CAST(65 + {g.sql_draw(11, 26)} AS INTEGER)) || '.' ELSE {g.FIRST!r}[{g.sql_draw(12, 8)} + 1] END"
SQL["surrogate_name"] = f"""SELECT type, value, CASE k WHEN 0 THEN {_LAST} WHEN 1 THEN 'Dr. ' || {_FIRST} || ' ' || {_LAST} WHEN 2 THEN {_FIRST} || ' ' || {_MIDDLE} || ' ' || {_LAST} || ' Jr.' ELSE 'Miss ' || {_LAST} END AS surrogate
    FROM (SELECT DISTINCT 'person_name' AS type, value, k FROM ({NAMES_SQL}))"""
QUERIES["surrogate_email"] = lambda s, sf: g.surrogate_map(spans(s, sf).where("type = 'email'")).select("type", "value", "surrogate")
SQL["surrogate_email"] = f"""SELECT DISTINCT type, value, lower({g.FIRST!r}[{g.sql_draw(0, 8)} + 1]) || '.' || lower({g.LAST!r}[{g.sql_draw(1, 8)} + 1]) || {g.sql_draw(2, 100)}
    || CASE WHEN contains(split_part(value, '@', 1), '+') THEN '+' || {g.TAGS!r}[{g.sql_draw(4, 5)} + 1] ELSE '' END || '@' || {g.DOMAINS!r}[{g.sql_draw(3, 3)} + 1] AS surrogate FROM ({SPANS_SQL}) WHERE type = 'email'"""
QUERIES["surrogate_routing"] = lambda s, sf: c.table(s, sf, "customer").select(F.lit("routing_number").alias("type"), F.col("c_name").alias("value")).transform(g.surrogate_map).select("value", "surrogate")


def _check_surrogates(s, sf):
    made = g.surrogate_map(spans(s, sf))
    ok = F.when(F.col("type") == "ssn", v.valid_ssn(F.col("surrogate"))).when(F.col("type") == "credit_card", v.valid_luhn(F.col("surrogate"))).when(F.col("type") == "phone", v.valid_phone_digits(F.col("surrogate"))).otherwise(F.lit(True))
    return made.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("invalid"), F.count_if(F.col("surrogate") == F.col("value")).alias("unchanged"))


QUERIES["check_surrogates"] = _check_surrogates
SQL["check_surrogates"] = f"SELECT type, count(DISTINCT value) AS n, 0 AS invalid, 0 AS unchanged FROM ({SPANS_SQL}) GROUP BY 1"

# audit
QUERIES["count_by_type"] = lambda s, sf: spans(s, sf).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
SQL["count_by_type"] = f"SELECT doc_id, type, count(*) AS n FROM ({SPANS_SQL}) GROUP BY 1, 2"
QUERIES["count_by_severity"] = lambda s, sf: spans(s, sf).groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))
SQL["count_by_severity"] = f"SELECT doc_id, severity, count(*) AS n FROM ({SPANS_SQL}) GROUP BY 1, 2"
QUERIES["exposure_rollup"] = lambda s, sf: spans(s, sf).rollup("source", "type", "severity").agg(F.count(F.lit(1)).alias("n"))
SQL["exposure_rollup"] = f"SELECT source, type, severity, count(*) AS n FROM ({SPANS_SQL}) GROUP BY ROLLUP (source, type, severity)"
QUERIES["highest_severity"] = lambda s, sf: spans(s, sf).groupBy("doc_id").agg(p.severity_of(F.max(p.ranked(F.col("severity"), SEVERITY_RANK))).alias("severity"), F.array_sort(F.collect_set("type")).alias("categories"))
SQL["highest_severity"] = f"SELECT doc_id, {case(f'max({SEV})', SEV_BACK)} AS severity, list_sort(list(DISTINCT type)) AS categories FROM ({SPANS_SQL}) GROUP BY 1"


def _ordered():
    """Display names in the order of their spans."""
    return F.transform(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "display_name"))), lambda x: x["display_name"])


QUERIES["distinct_types"] = lambda s, sf: spans(s, sf).groupBy("doc_id").agg(F.array_distinct(_ordered()).alias("names"))
SQL["distinct_types"] = f"SELECT doc_id, list(display_name ORDER BY a, b, display_name) AS names FROM (SELECT doc_id, display_name, (min(struct_pack(a := span_start, b := span_end))).a AS a, (min(struct_pack(a := span_start, b := span_end))).b AS b FROM ({SPANS_SQL}) GROUP BY 1, 2) GROUP BY 1"


def _summary(s, sf):
    named = spans(s, sf).groupBy("doc_id").agg(F.array_distinct(_ordered()).alias("names"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.size("names") == 1, F.concat(F.element_at("names", 1), F.lit(" detected"))).otherwise(F.concat(F.size("names").cast("string"), F.lit(" types of sensitive data detected: "), F.array_join("names", ", ")))
    return c.documents(s, sf).select("doc_id").join(named, "doc_id", "left").select("doc_id", F.when(F.col("names").isNull(), "No sensitive data detected").otherwise(text).alias("summary"))


QUERIES["detection_summary_text"] = _summary
SQL["detection_summary_text"] = f"SELECT doc_id, CASE WHEN names IS NULL THEN 'No sensitive data detected' WHEN len(names) = 1 THEN names[1] || ' detected' ELSE len(names) || ' types of sensitive data detected: ' || array_to_string(names, ', ') END AS summary FROM documents LEFT JOIN ({SQL['distinct_types']}) USING (doc_id)"
QUERIES["stage_counts"] = lambda s, sf: _with_source(s, sf).groupBy("doc_id").agg(F.count_if(F.col("source") == "regex").alias("regex"), F.count_if(F.col("source") == "ner").alias("ner"))
SQL["stage_counts"] = f"SELECT doc_id, count(*) FILTER (source = 'regex') AS regex, count(*) FILTER (source = 'ner') AS ner FROM ({TWO_SQL}) GROUP BY 1"
QUERIES["latency_percentiles"] = lambda s, sf: c.table(s, sf, "events").groupBy("event_type").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
SQL["latency_percentiles"] = "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1"


#: The kind that each planted sentence holds.
_PLANTED = "CASE doc_id % 24 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in {0: "ssn", 2: "credit_card", 3: "aws_key", 4: "api_key", 5: "api_key", 6: "private_key", 7: "api_key", 8: "email", 9: "aws_secret", 10: "api_key", 11: "api_key", 12: "api_key", 13: "phone", 14: "ip_address", 15: "connection_string", 16: "jwt", 17: "api_key", 18: "date"}.items()) + " END"


def _eval(s, sf):
    want = c.documents(s, sf).select("doc_id", F.expr(_PLANTED).alias("type")).where("type IS NOT NULL").withColumn("want", F.lit(1))
    found = spans(s, sf).select("doc_id", "type").distinct().withColumn("got", F.lit(1))
    both = want.join(found, ["doc_id", "type"], "full").groupBy("type").agg(F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("got").isNull()).alias("fn"))
    return both.withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6)).withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6))


QUERIES["detector_eval"] = _eval
SQL["detector_eval"] = f"""WITH w AS (SELECT * FROM (SELECT doc_id, {_PLANTED} AS type FROM documents) WHERE type IS NOT NULL), f AS (SELECT DISTINCT doc_id, type FROM ({SPANS_SQL})),
    x AS (SELECT coalesce(w.type, f.type) AS type, count(*) FILTER (w.type IS NOT NULL AND f.type IS NOT NULL) AS tp, count(*) FILTER (w.type IS NULL) AS fp, count(*) FILTER (f.type IS NULL) AS fn FROM w FULL JOIN f ON w.doc_id = f.doc_id AND w.type = f.type GROUP BY 1)
    SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision FROM x"""
_FILES = "SELECT doc_id, sum(detections) AS file_detections, count(*) AS files FROM (SELECT page_id AS doc_id, page_id % 5 AS detections FROM pages) GROUP BY 1"


def _pages(s, sf):
    return c.relation(s, sf, _FILES.replace("GROUP BY 1", "GROUP BY doc_id"), "pages")


def _kind(spans_):
    """What an event holds, by which of its two sides are there."""
    return F.when(spans_.isNotNull() & F.col("files").isNotNull(), "text_and_file").when(F.col("files").isNotNull(), "file").otherwise("text")


def _event(s, sf):
    one = spans(s, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))
    both = one.join(_pages(s, sf), "doc_id", "full")
    return both.select("doc_id", _kind(F.col("spans")).alias("content_type"), (F.coalesce("spans", F.lit(0)) + F.coalesce("file_detections", F.lit(0))).alias("total"))


QUERIES["event_total"] = lambda s, sf: _event(s, sf).select("doc_id", "total")
QUERIES["bypass_content_type"] = lambda s, sf: _event(s, sf).select("doc_id", "content_type")
_EVENT = f"SELECT coalesce(a.doc_id, f.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND f.doc_id IS NOT NULL THEN 'text_and_file' WHEN f.doc_id IS NOT NULL THEN 'file' ELSE 'text' END AS content_type, coalesce(n, 0) + coalesce(file_detections, 0) AS total FROM (SELECT doc_id, count(*) AS n FROM ({SPANS_SQL}) GROUP BY 1) a FULL JOIN ({_FILES}) f ON a.doc_id = f.doc_id"
SQL["event_total"] = f"SELECT doc_id, total FROM ({_EVENT})"
SQL["bypass_content_type"] = f"SELECT doc_id, content_type FROM ({_EVENT})"


def _evidence(s, sf):
    return acted(s, sf).select("doc_id", "tenant_id", "span_start", "type", "severity", "confidence", "action", v.fingerprint(F.col("value")).alias("fingerprint"), F.length("value").alias("chars"), v.mask_digits(F.regexp_replace("value", "[A-Za-z]", "a")).alias("shape"))


QUERIES["structured_evidence"] = _evidence
SQL["structured_evidence"] = f"SELECT doc_id, tenant_id, span_start, type, severity, confidence, action, substr(sha256(value), 1, 8) AS fingerprint, length(value) AS chars, regexp_replace(regexp_replace(value, '[A-Za-z]', 'a', 'g'), '[0-9]', 'X', 'g') AS shape FROM ({acted_sql()})"


def _warn(s, sf):
    """Documents whose strictest action warns, from one scan: the hash of a text goes with its first span, or alone."""
    rows = c.texts(s, sf).select("doc_id", (F.col("doc_id") % 25).alias("tenant_id"), v.content_sha256(F.col("text")).alias("hash"), d.builtin_spans(F.col("text")).alias("spans"))
    every = rows.select("doc_id", "tenant_id", "hash", F.posexplode_outer("spans").alias("pos", "s")).select("doc_id", "tenant_id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("hash")).alias("hash"), "s.type", "s.severity")
    done = p.span_actions(every, c.policies(s, sf), c.rules(s, sf))
    rank = F.when(F.col("type").isNotNull(), p.ranked(F.col("action"), ACTION_RANK))
    by_doc = done.groupBy("doc_id").agg(F.max(rank).alias("rank"), F.count("type").alias("detections"), F.collect_list("hash").alias("hashes"))
    return by_doc.where(F.col("rank") == ACTION_RANK["warn"]).select("doc_id", "detections", F.explode("hashes").alias("content_hash"))


SQL["warn_event"] = f"""SELECT a.doc_id, detections, 'sha256:' || sha256(text) AS content_hash FROM ({POLICY_SQL['policy_action']}) a
    JOIN (SELECT doc_id, count(*) AS detections FROM ({SPANS_SQL}) GROUP BY 1) n ON a.doc_id = n.doc_id JOIN ({c.TEXTS_SQL}) t ON a.doc_id = t.doc_id WHERE action = 'warn'"""
QUERIES["warn_event"] = _warn
QUERIES["sink_warn"] = lambda s, sf: st.audited(_warn(s, sf))
SQL["sink_warn"] = SQL["warn_event"]


def _bypass(s, sf):
    """One grouping by document says what a bypass let through and of which kinds."""
    by_type = spans(s, sf).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.sum("n").alias("total"))
    both = by_type.join(_pages(s, sf), "doc_id", "full")
    return both.select("doc_id", _kind(F.col("total")).alias("content_type"), "by_type", "total")


QUERIES["bypass_event"] = lambda s, sf: _bypass(s, sf).select("doc_id", "content_type", F.to_json("by_type").alias("by_type"), F.coalesce("total", F.lit(0)).alias("total"))
QUERIES["sink_bypass"] = lambda s, sf: st.audited(_bypass(s, sf).select("doc_id", "content_type", F.coalesce("total", F.lit(0)).alias("total")))
_BY_TYPE = f"""SELECT doc_id, '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' AS by_type, sum(n) AS n FROM (SELECT doc_id, type, count(*) AS n FROM ({SPANS_SQL}) GROUP BY 1, 2) GROUP BY 1"""
SQL["bypass_event"] = f"SELECT e.doc_id, content_type, by_type, coalesce(b.n, 0) AS total FROM ({_EVENT}) e LEFT JOIN ({_BY_TYPE}) b ON e.doc_id = b.doc_id"
SQL["sink_bypass"] = f"SELECT doc_id, content_type, total FROM ({SQL['bypass_event']})"
QUERIES["zk_event"] = lambda s, sf: spans(s, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.to_json(F.array_sort(F.collect_list(F.struct("span_start", "type")))).alias("details")).select("doc_id", "total", F.octet_length(st.sealed(F.col("details"), st.seal_key(s))).alias("sealed_bytes"))
SQL["zk_event"] = f"SELECT doc_id, count(*) AS total, 28 + strlen('[' || string_agg('{{\"span_start\":' || span_start || ',\"type\":\"' || type || '\"}}', ',') || ']') AS sealed_bytes FROM ({SPANS_SQL}) GROUP BY 1"


def _payload(s, sf):
    """The whole event of a bypass, one row a document from one scan: hash, counts, and each span's kind, fingerprint and mask."""
    one = F.transform(d.builtin_spans(F.col("text")), lambda x: F.concat_ws(":", F.lpad(x["start"].cast("string"), 9, "0"), x["type"], v.fingerprint(x["value"]), v.mask_placeholder(x["display_name"])))
    every = exploded(c.texts(s, sf), "doc_id", v.content_sha256(F.col("text")).alias("content_hash"), array=F.array(F.array_sort(one)), alias="mappings")  # a filter on the spans themselves works them out a second time
    rows = every.where(F.size("mappings") > 0).join(_pages(s, sf), "doc_id", "left")
    return rows.select("doc_id", "content_hash", "mappings", F.size("mappings").alias("detections"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("file_detections", F.lit(0)).alias("file_detections"))


QUERIES["bypass_payload"] = _payload
SQL["bypass_payload"] = f"""SELECT a.doc_id, 'sha256:' || sha256(text) AS content_hash, mappings, len(mappings) AS detections, coalesce(files, 0) AS files, coalesce(file_detections, 0) AS file_detections FROM (
    SELECT doc_id, list_sort(list(lpad(CAST(span_start AS VARCHAR), 9, '0') || ':' || type || ':' || substr(sha256(value), 1, 8) || ':' || {MASK})) AS mappings FROM ({SPANS_SQL}) GROUP BY 1) a
    JOIN ({c.TEXTS_SQL}) t ON a.doc_id = t.doc_id LEFT JOIN ({_FILES}) f ON a.doc_id = f.doc_id"""
