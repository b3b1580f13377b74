"""Many small files, and screens that spare texts without a match."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from redactory.functions.bank import BANK
from redactory.functions.spans import screened, spans
from redactory.operators import detect, entities, tenants
from redactory.plans import entity_queries, protection_queries
from redactory.sources import storage

#: Texts around which the two matchers could differ: vertical tabs, wide blanks, accents, the Kelvin sign, line ends, bad bytes.
ODD = [
    None, "", "219\x0b09\x0b1234", "card 4111\x0b1111\x0b1111\x0b1111", "api_key\x0b=\x0b" + "a" * 24, "éA@b.com", "x\u00a0219-09-1234\u2003y", "TO\u212aEN = abcdefgh1", "pa\u017f\u017fword: hunter2hunter2",
    "-----BEGIN\x0bRSA PRIVATE\nKEY-----", "Bearer\x0b" + "b" * 20, "March\x0b5,\x0b1984", "next\x0bweek", "Dr.\x0bSarah\x0bChen", "Acme\x0bWidgets\x0bLLC", "diagnosed\x0bwith flu\x0b\x0bx", "P.O.\x0bBox\x0b12", "history of gout", "$2\x0bmillion", "postgres://é\u2028x",
]


def test_many_files_share_folders_and_tasks(spark, tmp_path):
    df = spark.range(600).selectExpr("concat('a/b ', id) AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('text ', id) END AS text")
    path = storage.write_files(df, "k", f"{tmp_path}/out")
    found = [f for _, _, files in os.walk(path) for f in files]
    assert len(found) == 600 and "k=a%2Fb%200.txt" in found and len(os.listdir(path)) <= storage.FOLDERS
    with storage.small_files(spark):
        read = storage.scan_files(spark, path)
        assert sorted(r.text for r in read.select("text").collect()) == sorted("\n" if i % 7 == 0 else f"text {i}\n" for i in range(600))
        assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    with pytest.raises(ValueError, match="exists"):
        storage.write_files(df, "k", path)


def test_screens_lose_no_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, text string").union(spark.sql("SELECT 99L, cast(concat(x'3A2F2F', x'FF') AS string) || ' postgres://' || cast(x'FFFE' AS string)"))
    kinds = [(p.regex, p.regex, p.ignore_case) for p in BANK] + [(x.java(), x.whole(), x.ignore_case) for f in entities.FAMILIES.values() for x in f]
    kinds += [(x.regex + (f"(?={x.until})" if x.until else ""), x.regex + (f"(?:{x.until})" if x.until else ""), False) for x in entities.CONTEXTS]
    held = screened(F.col("text"), [(w, i) for _, w, i in kinds])
    plain = F.array(*(spans(F.col("text"), p, i) for p, _, i in kinds))
    quick = F.array(*(spans(F.col("text"), p, i, held=F.array_contains(held, n)) for n, (p, _, i) in enumerate(kinds)))
    got = df.select("text", plain.alias("a"), quick.alias("b")).collect()
    assert sum(len(x) for r in got for x in r.a) > 15
    assert all(r.a == r.b for r in got)


def test_a_pattern_that_arrow_refuses_is_looked_for_everywhere(spark):
    df = spark.createDataFrame([("ab",), ("c",), (None,)], "text string")
    assert [r[0] for r in df.select(screened(F.col("text"), [("a(?=b)", False), ("B", True)])).collect()] == [[0, 1], [0], []]


@pytest.mark.parametrize("make", [detect.builtin_spans, lambda t: entities.entity_spans(t, entities.FAMILIES["ner_date"]), lambda t: entities.context_spans(t, entities.CONTEXTS[0])])
def test_detectors_screen_all_texts_in_one_pass(spark, make):
    plan = spark.range(1).selectExpr("cast(id AS string) AS text").select(make(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_two_producers_take_one_scan(spark):
    plan = protection_queries.QUERIES["sweep_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["warn_event", "bypass_event", "context_boost"])
def test_a_query_scans_and_screens_texts_once(spark, name):
    plan = protection_queries.QUERIES.get(name, entity_queries.QUERIES.get(name))(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_warning_counts_all_texts_of_a_number(spark, tmp_path):
    rows = [(13, "web", "none"), (13, "web", "call 555-123-4567"), (37, "web", "x"), (14, "web", None), (None, "web", "a@b.com")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("nation", "supplier"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t, at in (("documents", "documents.parquet/*.parquet"), ("nation", "nation.parquet"), ("supplier", "supplier.parquet")):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{at}'")
    names = ["doc_id", "detections", "content_hash"]
    mine = protection_queries.QUERIES["warn_event"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({protection_queries.SQL['warn_event']})").fetchall())


@pytest.mark.parametrize("most", [tenants.SENT_BYTES, 0])
def test_hits_of_a_value_that_many_patterns_share_are_dealt_out(spark, monkeypatch, most):
    """Blocks of patterns meet the hits, so one value's rows come from many tasks; null names and copies are kept."""
    monkeypatch.setattr(tenants, "BLOCK", 50, raising=False)
    ids = [f"p{i}" for i in range(1000)] + ["p7", None]
    usable = spark.createDataFrame([(1, p, i, "n", "keyword", "ab") for i, p in enumerate(ids)], "tenant_id long, pattern_id string, seq long, name string, kind string, value string")
    texts = spark.createDataFrame([(i, 1 + i % 2, "ab ab") for i in range(80)], "doc_id long, tenant_id long, text string")
    found = tenants.tenant_spans(texts, usable, most)
    got = Counter((r.doc_id, r.pattern_id, r.span_start) for r in found.collect())
    assert got == Counter((i, p, at) for i in range(0, 80, 2) for p in ids for at in (0, 3))
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(by_task) < (1 if most else 0.2) * sum(by_task)


def test_a_payload_works_its_spans_out_once(spark, tmp_path):
    spark.createDataFrame([(1, "mail", "Write to a@b.org or 10.0.0.1."), (2, "web", None), (26, "web", ""), (31, "web", "nothing")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,), (1,), (99,)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    out = protection_queries.QUERIES["bypass_payload"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(BANK)
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(protection_queries.SQL["bypass_payload"]).fetchall())
