"""Patterns that many rows share, long texts with many spans, and rounding."""

from __future__ import annotations

import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactory.functions.spans import pieces, window
from redactory.operators import entities, lexicons, merge
from redactory.operators import tenants as t
from redactory.plans import protection_queries


@pytest.mark.parametrize("most", [t.SENT_BYTES, 0])
def test_a_value_that_many_patterns_share_runs_once(spark, monkeypatch, most):
    rows = [(1, f"p{i}", i, f"P{i}", kind, value) for i in range(2, 402) for kind, value in (("regex", "x[0-9]"), ("keyword", "ab"))]
    usable = spark.createDataFrame(rows, "tenant_id long, pattern_id string, seq long, name string, kind string, value string")
    texts = spark.createDataFrame([(1, 1, "ab x1"), (2, 1, "none"), (3, 2, "ab x1")], "doc_id long, tenant_id long, text string")
    sent = []
    real = t._matched
    monkeypatch.setattr(t, "_matched", lambda texts, usable, *rest: sent.append(usable.count()) or real(texts, usable, *rest))
    found = t.tenant_spans(texts, usable, most).collect()
    assert len(found) == 800 and len({(r.pattern_id, r.span_start, r.span_end, r.confidence) for r in found}) == 800 and {r.doc_id for r in found} == {1}
    assert {r.doc_id: r.custom_match for r in t.first_match(texts, usable, most).collect()} == {1: "P2", 2: None, 3: None}
    assert sent == [2, 2]


def test_merging_follows_runs_of_overlapping_spans(spark):
    n = 1500
    rows = [(3 * i, 3 * i + 2, "a", x, c, i) for x, c in (("p", 0.5), ("q", 0.7)) for i in range(n)]
    df = spark.createDataFrame([(rows,)], f"spans array<{merge.SPAN}>")
    begun = time.time()
    got = df.select(merge.merge_same_type(F.col("spans")).alias("m"), merge.first_writer_wins(F.col("spans")).alias("f")).first()
    assert [s.start for s in got.m] == [3 * i for i in range(n)] and {s.source for s in got.m} == {"q"}
    assert [s.start for s in got.f] == [3 * i for i in range(n)] and {s.source for s in got.f} == {"p"}
    assert time.time() - begun < 30


def test_windows_out_of_pieces(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(3000)) + "😀z"
    places = [(0, 0), (0, 5), (1023, 1025), (1024, 1024), (500, 2900), (2990, 9000), (3002, 3010), (3500, 3600)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    got = df.select("a", "b", window(pieces(F.col("t")), F.col("a"), F.col("b")).alias("w")).collect()
    assert [(r.a, r.b, r.w) for r in got] == [(a, b, text[a:b]) for a, b in places]


def test_places_of_keywords(spark):
    df = spark.createDataFrame([("Testest comp COMPENSATION",), ("",), (None,)], "t string")
    got = [r.p and sorted((x.start, x.stop) for x in r.p) for r in df.select(entities.keyword_places(F.col("t"), ("test", "comp", "compensation")).alias("p")).collect()]
    assert got[0] == [(0, 4), (3, 7), (8, 12), (13, 17), (13, 25)] and not got[1] and not got[2]


def test_money_is_rounded_as_in_the_sql(spark, tmp_path):
    rows = [(1, 9999.7), (2, 99.5), (3, 98.5), (4, 999.49), (5, -99.5), (6, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in protection_queries.QUERIES["money_format"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == set(con.execute(protection_queries.SQL["money_format"]).fetchall())


def test_tasks_work_on_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(lexicons, "PART_CHARS", 10)
    texts = ["abcdef", None, "abc", "é" * 30, "", "abcdefghij", "a"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    got = list(lexicons.parts(iter([batch, batch.slice(0, 0)])))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist()
    assert [b.num_rows for b in got] == [3, 1, 2, 1, 0]
