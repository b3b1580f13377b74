"""Analysis of long texts, term tables in small memory, listings of many files."""

from __future__ import annotations

import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactory.functions import dialect
from redactory.functions.spans import exploded, spans
from redactory.operators import analysis, merge, termtable
from redactory.operators import entities as e
from redactory.operators import lexicons as lx
from redactory.operators import predictions as pr
from redactory.sources import storage


def test_entities_carry_their_kind_and_settle_like_the_folds(spark):
    text = "We met Dr. Ann Chen and Sarah Chen at Memorial Hospital. A patient with asthma, on aspirin since May 2020, lives at 5 Oak Street; mail jo at corp dot com."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, (text + " ") * 40)], "doc_id long, text string")
    kinds = [{"person"}, {"organization"}, {"date"}, {"medical"}, {"address"}, {"phone_conversational"}, {"email_obfuscated"}]
    found = df.select(analysis.every_entity(F.col("text")).alias("x")).collect()
    assert {s.ord for r in found for s in r.x or ()} >= {0, 1, 2, 3, 4, 6}
    assert all(s.type in kinds[s.ord] for r in found for s in r.x or ())
    old = {r.doc_id: r.x for r in df.select("doc_id", analysis.entities(F.col("text")).alias("x")).collect()}
    new = analysis.with_entities(df, into="x")
    assert new.columns == ["doc_id", "text", "x"] and {r.doc_id: r.x for r in new.collect()} == old and len(old[4]) > 200


def test_settled_spans_equal_the_folds(spark):
    draw = random.Random(4)
    rows = [(i, [(a, a + draw.randint(1, 9), "t", "ner", draw.choice([0.5, 0.7, 0.9]), draw.randint(0, 2)) for a in (draw.randint(0, 60) for _ in range(draw.randint(0, 25)))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, f"doc_id long, spans array<{merge.SPAN}>")
    by_kind = F.concat(*(merge.first_writer_wins(F.expr(f"filter(spans, s -> s.ord = {kind})")) for kind in range(3)))
    old = {r.doc_id: r.x for r in df.select("doc_id", merge.sweep(by_kind).alias("x")).collect()}
    assert {r.doc_id: r.spans for r in merge.settled(df).collect()} == old


def test_the_classifier_reads_each_span_once(spark):
    text = "The plaintiff said the settlement and salary of patient Ann Lee, CEO and manager, is Kng-size. " * 3
    spans = [(a, a + 5, "custom", "ner", c, 0) for a, c in ((0, 0.5), (40, 0.8), (200, 0.9), (len(text) - 3, 0.4))]
    df = spark.createDataFrame([(1, text, spans), (2, None, []), (3, "", None)], f"doc_id long, text string, spans array<{merge.SPAN}>")
    out = analysis.classified(df, "spans", analysis.cue_probabilities)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    cues = {t: {k for x in e.CONTEXTS if x.type == t for k in x.keywords} for t, _, _ in pr.CATEGORIES}

    def brute(around):
        n = [sum(k in around.lower() for k in cues[t]) for t, _, _ in pr.CATEGORIES]
        return [x / (sum(n) + 1.0) for x in n]

    asked = [text[max(0, a - 128) : b + 128] for a, b, *_ in spans] + [None, ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i long, x string").select("i", analysis.cue_probabilities(F.col("x")).alias("p")).collect()
    assert all(r.p == (None if asked[r.i] is None else brute(asked[r.i])) for r in got)
    assert sorted(r.span_start for r in out.collect()) == sorted(a for a, _, _, _, c, _ in spans if c > 0.8 or c * 0.5 >= 0.3 or max(brute(text[max(0, a - 128) : a + 133])) > 0.5)


def _hits(text, terms):
    """Leftmost longest places of one dictionary's terms, by trying all of them everywhere."""
    low, out, end = lx.lowered(text or ""), [], 0
    for i in range(len(low)):
        for t in sorted(terms, key=len, reverse=True):
            if i >= end and low.startswith(t, i) and lx.bordered(low, i, i + len(t)):
                out.append((i, i + len(t)))
                end = i + len(t)
    return out


@pytest.mark.parametrize("most", [lx.BLOCK_BYTES, 3000])
def test_terms_of_any_form_are_found(spark, most):
    draw = random.Random(7)
    words = ["ab", "b", "ab1", "_x", "kilo", "é", "naïve", "x" * 130, "c++", ".net", "a-b", "日本", "q"]
    term = lambda: draw.choice([" ", "  ", "-", "\n", "", "–"]).join(draw.choice(words) for _ in range(draw.randint(1, 6)))
    own = {d: {t for t in (term() for _ in range(60)) if t.strip()} for d in ("one", "two", None)}
    text = lambda: draw.choice([" ", ". ", "é ", "\n"]).join(draw.choice([term(), term().upper(), "Kilo", "İ"]) for _ in range(draw.randint(0, 30)))
    texts = [None, "", "\n"] + [text() for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(d, t) for d, ts in own.items() for t in ts], "dictionary string, term string")
    got = {r.doc_id: r.terms for r in lx.with_terms(df, table, most=most).collect()}
    for i, x in enumerate(texts):
        for d, ts in own.items():
            assert sorted((t.start, t.stop) for t in got[i] if t.dictionary == d) == _hits(x, {lx.lowered(t) for t in ts}), (i, d, x)
    assert sum(map(len, got.values())) > 500


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(termtable, "hashes", lambda data, starts, stops: (stops - starts).astype("uint64"))
    rows = pa.table({"dictionary": ["d", "d", "e", "d"], "term": ["ab", "cd", "xyz", "ab cd"]})
    table = termtable.Table(rows)
    assert sorted(table.others) == ["ab", "cd"] and len(table.hashes) == 2
    found = [tuple(int(v) for v in x) for a in table.places(["abc xyz", "xyz ab cd"]) for x in zip(*a)]
    assert sorted(found) == [(0, 1, 4, 7), (1, 0, 4, 9), (1, 1, 0, 3)]


def test_a_table_of_terms_is_small():
    n = 100_000
    rows = pa.table({"dictionary": ["d"] * n, "term": [f"term{i} word" for i in range(n)]})
    assert len(pickle.dumps(termtable.Table(rows))) < 50 * n


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for name in ("a.txt", "deep/b=1/c d.MD", "deep/b=1/e%20.json", "_part=1/f.txt", "deep/_hidden/g.txt", "deep/.h.txt", "deep/_i.txt", "j.exe", "k.txt.gz", "empty/l.csv"):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"" if name.startswith("empty") else b"text of " + name.encode())
    for i in range(300):
        (tmp_path / "in" / f"n{i}.log").write_text(str(i))
    (tmp_path / "in" / "large.txt").write_bytes(b"x" * (storage.LOCAL_BYTES + 1))
    out = storage.scan_files(spark, f"{tmp_path}/in")
    spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/in")
    want = spark_own.where(storage.extension(F.col("path")).isin(storage.LOCAL_EXTENSIONS) & (F.col("length") <= storage.LOCAL_BYTES)).select("path", "length", F.col("content").cast("string"))
    assert out.columns == ["path", "length", "text"] and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert out.count() == 304 and "BinaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    assert storage.scan_files(spark, f"{tmp_path}/in/a.txt").count() + storage.scan_files(spark, f"{tmp_path}/in/n*.log").count() == 301
    (tmp_path / "none").mkdir()
    assert storage.scan_files(spark, f"{tmp_path}/none").count() == 0


def test_context_distances_equal_those_of_the_window(spark):
    draw = random.Random(3)
    pieces_ = ["Ann Lee", "$120,000", "95k", "salary", "é", "the CEO", "Make", "10.0.0.1", "patient", "x" * 70, "日本", "\n", "pay", "Dr. Bo Chen", "server"]
    texts = [None, "", "salary", "Ann Lee"] + [" ".join(draw.choice(pieces_) for _ in range(n)) for n in (3, 10, 40, 400) for _ in range(6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n = 0
    for x in e.CONTEXTS:
        every = exploded(df, "doc_id", "text", array=spans(F.col("text"), x.java()), alias="s").select("doc_id", "s.start", "s.stop", e.near_distance(F.col("text"), F.col("s.start"), F.col("s.stop"), x.keywords, x.window).alias("d")).collect()
        want = {(r.doc_id, r.start, r.stop): r.d for r in every}
        got = {(r.doc_id, r.span_start, r.span_end): r.distance for r in e.context_candidates(df, x).collect()}
        assert all(want[k] == d for k, d in got.items())
        assert set(got) == {k for k, d in want.items() if d is not None and (1 - d / x.window) >= 0.3 and int((1 - d / x.window) * x.confidence * 1000 + 0.5) / 1000 >= 0.5}
        n += len(got)
    assert n > 100


def test_borders_in_java_see_ascii_words_only(spark):
    old = "[A-Za-z0-9_]"
    plain = lambda p: p.replace(r"\b", f"(?:(?<!{old})(?={old})|(?<={old})(?!{old}))").replace(r"\m", f"(?={old})(?<!{old})").replace(r"\M", f"(?!{old})")
    texts = ["Ann Lee", "éAnn xAnn _Ann 9Ann -Ann", "ÀB Kelvin KB İB", "O'Neil-Smith Jones", "AB́ Ab", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"\b[A-Z][a-z]*\b", r"\m[A-Z]+\M", r"\b[A-Z]?x", r"\b[A-Z]{2}", e.BIGRAM, e.CAPS):
        r = df.select(F.regexp_extract_all("t", F.lit(dialect.java(p)), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain(p)), F.lit(0)).alias("b")).collect()
        assert all(x.a == x.b for x in r), p
    assert dialect.java(e.BIGRAM).startswith("(?=[A-Z])")
