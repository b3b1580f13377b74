"""Term tables, typed keywords and tenant patterns against brute force, and the plans of span queries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from redactory.functions.bank import BANK
from redactory.operators import analysis
from redactory.operators import detect as d
from redactory.operators import entities as e
from redactory.operators import lexicons as lx
from redactory.plans import entity_queries as eq
from redactory.sources import corpus as c

SF = "/root/testdata/sf0.01"
WORD = "[A-Za-z0-9_]"


def _brute(text, terms):
    """Leftmost longest hits between borders, by trying every term at every place."""
    low, out, end = lx.lowered(text or ""), [], 0
    by_first = {}
    for t in sorted(set(terms), key=lambda t: -len(t)):
        by_first.setdefault(t[0], []).append(t)
    for i in range(len(low)):
        if i >= end and not (i and re.match(WORD, low[i - 1])):
            for t in by_first.get(low[i], ()):
                if low.startswith(t, i) and not re.match(WORD, low[i + len(t) : i + len(t) + 1]):
                    out.append((i, i + len(t)))
                    end = i + len(t)
                    break
    return out


@pytest.mark.parametrize("most", [lx.BLOCK_BYTES, 100_000])
def test_five_thousand_terms_equal_a_brute_search(spark, most):
    terms = eq.terms(spark, SF)
    rows = terms.collect()
    assert len(rows) >= 5000
    own = [r.term for r in rows if r.dictionary == "ner_drug"]
    docs = c.texts(spark, SF)
    got = {}
    for r in lx.term_spans(docs, terms, most=most).where("dictionary = 'ner_drug'").collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").where("doc_id % 10 = 0").collect()}
    for i, text in texts.items():
        assert sorted(got.get(i, [])) == _brute(text, own)


ODD = [("a-b c", 1), (None, 2), ("", 3), ("A-B c a-b", 4), ("xa-b a-bx é a-b", 4), ("İ a-b ab abc", 5), ("a-b " * 5000, 6)]


@pytest.mark.parametrize("most", [lx.BLOCK_BYTES, 80])
def test_odd_terms_and_texts(spark, most):
    texts = spark.createDataFrame([(i, t, "clash", "n") for t, i in ODD], "doc_id long, text string, term string, near string")
    terms = spark.createDataFrame([("x", t) for t in ("a-b", "A-B", "a-b c", "", " ", None, "ab", "c")] + [("y", "c")], "dictionary string, term string")
    got = lx.term_spans(texts, terms, cue="c a", most=most)
    assert got.columns == ["doc_id", "dictionary", "span_start", "span_end", "near"]
    found = sorted((r.doc_id, r.span_start, r.span_end) for r in got.where("dictionary = 'x'").collect())
    own = ["a-b", "a-b c", "ab", "c"]
    assert found == sorted((i, a, b) for t, i in ODD for a, b in _brute(t, own))
    assert {(r.doc_id, r.span_start) for r in got.where("dictionary = 'y'").collect()} == {(1, 4), (4, 4)}
    assert lx.usable(terms)[1].count() == 3
    assert lx.term_spans(texts.limit(0), terms, most=most).count() == 0 and lx.term_spans(texts, terms.limit(0), most=most).count() == 0


def test_known_pairs_of_any_form(spark):
    texts = spark.createDataFrame([(1, "met Ana Al-Roth and Jo-Ana Roth, Ana Unknown, Bob Roth"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("first", "Ana"), ("last", "Roth"), ("last", "Roth")], "side string, name string")
    assert sorted((r.span_start, r.span_end) for r in lx.known_pairs(texts, names).collect()) == [(4, 15), (20, 31)]


def _gap(text, start, stop, words, window):
    """Least gap by trying every place of every keyword."""
    low, gaps = lx.lowered(text), []
    for w in words:
        for a in range(max(0, start - window), min(len(low), stop + window)):
            if low.startswith(w, a) and a + len(w) <= stop + window:
                gaps.append(max(0, start - a - len(w)) if a < start else max(0, a - stop))
    return min(gaps, default=None)


def test_keyword_distances_equal_brute_force(spark):
    own = eq._scored_spans(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in c.texts(spark, "/root/testdata/sf0.001").collect()}
    seen = 0
    for r in own:
        for s in r.spans:
            for side, by, got in (("boost", e.BOOST_WORDS, s.near), ("suppress", e.SUPPRESS_WORDS, s.against)):
                assert got == _gap(texts[r.doc_id], s.start, s.stop, by.get(s.type, ()), eq.WINDOW), (r.doc_id, s, side)
                seen += got is not None
    assert seen > 20


def test_keyword_distances_of_odd_rows(spark):
    rows = [(1, "pay $5 pay", [(4, 6, "m")], 1), (2, None, [(0, 1, "m")], 2), (3, "x", None, 3), (4, "pay", [], 4), (5, "paypay", [(1, 2, "m"), (0, 0, "other")], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,stop:int,type:string>>, near int")
    words = spark.createDataFrame([("m", "Pay", "boost"), ("m", "", "boost"), ("m", None, "suppress"), ("m", "ypa", "suppress")], "type string, keyword string, side string")
    got = {r.doc_id: r for r in lx.keyword_distances(df, words, 10).collect()}
    assert [(s.near, s.against) for s in got[1].spans] == [(1, None)] and got[1].near == 1
    assert [s.near for s in got[2].spans] == [None] and got[3].spans is None and got[4].spans == []
    assert [(s.near, s.against) for s in got[5].spans] == [(0, 0), (None, None)]
    assert [s.near for r in lx.keyword_distances(df, words.limit(0), 10).collect() for s in r.spans or ()] == [None] * 4


def test_patterns_run_once_and_after_rows_are_dealt(spark):
    """No pattern stands in a filter below the generator, where it would run a second time in the scan's tasks."""
    plan = d.detect_all(c.texts(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "regexp_extract_all" in below
    assert not [line for line in below.splitlines() if "Filter" in line and ("RLIKE" in line or "regexp" in line)]
    assert plan.count("regexp_extract_all") == len(BANK)


def test_places_in_the_row_keep_other_columns_and_feed_the_entities(spark):
    rows = [(1, "He took Zaltrafen and zaltra daily, the patient had Morbus Ix.", None, "x"), (2, None, None, "y"), (3, "", None, "z"), (3, "", None, "z"), (4, "zaltrafenx Morbus  Ix", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, terms string, doc_id string")
    table = spark.createDataFrame([("ner_drug", "zaltra"), ("ner_drug", "Zaltrafen"), ("ner_condition", "morbus ix"), ("ner_drug", " "), ("ner_drug", None)], "dictionary string, term string")
    for most in (128, lx.BLOCK_BYTES):  # two automata, or one
        placed = lx.with_terms(df, table, r"(?i)patient", most=most)
        assert placed.columns == df.columns
        got = sorted((r.id, r.doc_id, sorted((t.dictionary, t.start, t.stop, t.near) for t in r.terms)) for r in placed.fillna("none", ["doc_id"]).collect())
        assert got == [(1, "x", [("ner_condition", 52, 61, True), ("ner_drug", 8, 17, True), ("ner_drug", 22, 28, True)]), (2, "y", []), (3, "z", []), (3, "z", []), (4, "none", [])]
    assert lx.with_terms(df, table, without=("text",)).columns == [c for c in df.columns if c != "text"]
    placed = lx.with_terms(df, table, r"(?i)patient").where("id = 1")
    found = {(s["start"], s["stop"], s["type"], s["confidence"]) for n in ("ner_drug", "ner_condition") for s in placed.select(analysis.term_entities(F.col("terms"), n).alias("e")).first().e}
    assert found == {(8, 17, "medical", 0.80), (22, 28, "medical", 0.80), (52, 61, "medical", 0.88)}
    empty = lx.with_terms(df.limit(0), table.limit(0))
    assert empty.count() == 0
