"""Tenants' patterns, their guard, and reject tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from redactory.operators import surrogate as g
from redactory.operators import tenants as t
from redactory.plans import policy_queries, tenant_queries
from redactory.sources import rejects

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("pattern", ["(a+)+$", "(?:a*)*", "((ab)+c*)+", "(a{2,})+", r"(\w+\s?)*!", "(?P<x>[a-z]+)*", "(a|b+){1,40}", "(?<=x)(y+)+"])
def test_nested_open_repeats_are_found(pattern):
    assert t.nested_quantifiers(pattern) and t.regex_fault(pattern) == "nested quantifiers"


@pytest.mark.parametrize("pattern", ["a+b+", "(?:foo|bar)+", r"\(a+\)+", "[(a+)]+", "[]a+)]+b", r"(\d{1,3}\.){3}\d+", "(a+)?b", "(ab)+c+", "(a+){2}"])
def test_plain_repeats_pass(pattern):
    assert not t.nested_quantifiers(pattern) and t.regex_fault(pattern) is None


PATTERNS = [
    (1, "a", 2, "A", "keyword_list", '["aba", "AB", "", null]', True), (1, "b", 1, "B", "regex", r"x\d+", True), (1, "c", 3, "C", "regex", "(a+)+$", True), (1, "d", 4, "D", "regex", "(", True), (1, "e", 5, "E", "regex", None, True),
    (1, "f", 6, "F", "keyword_list", "oops", True), (1, "g", 7, "G", "keyword_list", '["zzz"]', False), (2, "h", 1, "H", "keyword_list", '["x1"]', True), (1, "i", 9, "I", "semantic", "names", True), (None, "j", 1, "J", "regex", "x", True), (1, "k", 1, "K", "regex", "y*", None),
]
SCHEMA = "tenant_id long, pattern_id string, seq long, name string, pattern_type string, pattern_value string, enabled boolean"


@pytest.mark.parametrize("most", [t.SENT_BYTES, 0])
def test_each_tenant_has_its_own_patterns(spark, most):
    usable, rejected = t.checked(spark.createDataFrame(PATTERNS, SCHEMA))
    reasons = sorted((r.pattern_id, r.reason) for r in rejected.collect())
    assert reasons == [("a", "blank keyword"), ("a", "blank keyword"), ("c", "nested quantifiers"), ("d", "bad syntax"), ("e", "blank pattern"), ("f", "not a list of keywords")]
    rows = [(1, 1, "ABABA x12 X3"), (2, 2, "ABABA x12"), (3, None, "aba x1"), (4, 1, None), (5, 1, ""), (6, 3, "aba"), (7, 1, "zzz y é aba")]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, tenant_id long, text string, name string")
    got = t.tenant_spans(texts, usable, most)
    assert got.where("reason IS NOT NULL").count() == 0
    found = sorted((r.doc_id, r.pattern_id, r.span_start, r.span_end, r.confidence) for r in got.collect() if r.doc_id != 3)
    assert found == [(1, "a", 0, 2, 0.9), (1, "a", 0, 3, 0.9), (1, "a", 2, 4, 0.9), (1, "a", 2, 5, 0.9), (1, "b", 6, 9, 0.85), (1, "b", 10, 12, 0.85), (2, "h", 6, 8, 0.9), (7, "a", 8, 10, 0.9), (7, "a", 8, 11, 0.9)]
    assert got.where("doc_id = 3").count() == 0
    assert {r.doc_id: r.custom_match for r in t.first_match(texts, usable, most).collect()} == {1: "B", 2: "H", 3: None, 4: None, 5: None, 6: None, 7: "A"}
    block = {r.doc_id: r.first_match for r in t.blocked(texts, usable, lambda x: F.when(F.contains(x, F.lit("zzz")), "own"), most).collect()}
    assert block == {1: "B", 2: "H", 3: None, 4: None, 5: None, 6: None, 7: "own"}
    assert t.tenant_spans(texts.limit(0), usable, most).count() == 0 and t.tenant_spans(texts, usable.limit(0), most).count() == 0


def test_a_pattern_that_takes_too_long_goes_to_the_rejects(spark, monkeypatch):
    monkeypatch.setattr(t, "SECONDS", 0.05)
    own = t.Patterns([(1, "p", "P", "regex", "(a|aa)+$"), (2, "q", "Q", "keyword", "b")])
    hits = list(own.hits("a" * 60 + "b"))
    assert [h[6] for h in hits] == [None, "took too long"]


def test_divided_rows_are_all_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "1"), (2, None), (3, "x"), (4, ""), (4, "")], "id int, v string")
    out = rejects.divided(df, [("null", F.col("v").isNull()), ("no number", F.expr("try_cast(v AS int) IS NULL")), ("never", F.lit(None).cast("boolean"))], "t", str(tmp_path / "d"))
    assert [r.id for r in out.kept.collect()] == [1] and out.kept.columns == ["id", "v"]
    assert {r.reason: r.n for r in out.counts().collect()} == {None: 1, "null": 1, "no number": 3}
    assert rejects.divided(df.limit(0), [("null", F.col("v").isNull())], "t").counts().count() == 0
    with pytest.raises(ValueError, match="reject"):
        rejects.divided(df.withColumn("reason", F.lit(1)), [], "t")


def test_twenty_five_tenants_have_different_sets(spark):
    usable, rejected = tenant_queries.patterns(spark, "/root/testdata/sf0.01")
    sets = usable.groupBy("tenant_id").agg(F.sort_array(F.collect_set("value")).alias("v")).collect()
    assert len(sets) == 25 and len({tuple(r.v) for r in sets}) > 1
    assert {r.reason for r in rejected.collect()} == {"nested quantifiers", "bad syntax", "matches nothing", "blank keyword", "not a list of keywords"}


def test_a_tag_is_drawn(spark):
    df = spark.createDataFrame([("jane.doe+acme-secret@corp.com",), ("jane@corp.com",)], "v string").select("v", g.email(F.lit("email"), F.col("v")).alias("s"))
    made = {r.v: r.s for r in df.collect()}
    assert "acme" not in made["jane.doe+acme-secret@corp.com"] and made["jane.doe+acme-secret@corp.com"].split("@")[0].split("+")[1] in g.TAGS
    assert "+" not in made["jane@corp.com"]


def test_both_rule_sets_are_read_from_one_scan(spark):
    plan = policy_queries.QUERIES["monitor_shadow"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents") <= 1 and plan.count("regexp_extract_all") == 18
