"""Whole analysis of a text: all detectors, context, classifier, merge; each stage inside the row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.bank import BANK
from redactory.functions.dialect import java
from redactory.functions.spans import bound, exploded, pieces, spans, window as cut_out
from redactory.operators import detect as d
from redactory.operators import entities as e
from redactory.operators import lexicons as lx
from redactory.operators import merge as m
from redactory.operators import predictions as pr
from redactory.operators import surrogate as g

#: Takes a text column, gives an array of m.SPAN structs; None stands for a detector that is not ready, whose stage is skipped.
Detector = Callable[[Column], Column] | None
SEVERITIES = {t: s for _, t, s in pr.LABELS} | {p.type: p.severity for p in BANK}
LEAST_CONFIDENCE = 0.3
#: Characters beside a span that the classifier reads.
AROUND = 128


def _span(s: Column, type_: Column | str, source: str, confidence: Column | float, ord_: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), lit(type_).alias("type"), F.lit(source).alias("source"), lit(confidence).alias("confidence"), lit(ord_).cast("int").alias("ord"))


def severity_of(type_: Column) -> Column:
    """Severity of a kind; unknown ones are medium."""
    out = F.lit("medium")
    for name, severity in SEVERITIES.items():
        out = F.when(type_ == name, severity).otherwise(out)
    return out


def name_pairs(text: Column, ord_: int = 0) -> Column:
    """A known first name before a known last name; a part such as Al- before either may be missing or added."""

    def known(s: Column) -> Column:
        words = F.split(s["value"], r"\s+")
        first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        bare = lambda w: F.regexp_replace(w, "^[A-Z][a-z]+-", "")
        al = lambda w: F.concat(F.lit("Al-"), w)
        lasts = [x.isin(e.LAST_NAMES) for x in (last, bare(last), al(bare(last)), al(last))]
        return (first.isin(e.FIRST_NAMES) | bare(first).isin(e.FIRST_NAMES)) & reduce(lambda x, y: x | y, lasts)

    return F.transform(F.filter(spans(text, e.BIGRAM), known), lambda s: _span(s, "person", "ner", 0.84, ord_))


def capitalised_runs(text: Column, ord_: int = 0) -> Column:
    """Two to four capitalised words that do not begin a sentence and hold no stop-word."""

    def inside(s: Column, parts: Column) -> Column:
        trimmed = lambda x: F.regexp_replace(x, r"\s+\z", "")
        near = trimmed(cut_out(parts, F.greatest(s["start"] - 64, F.lit(0)), s["start"]))
        before = bound(near, lambda x: F.when(x != "", x).otherwise(trimmed(F.substr(text, F.lit(1), s["start"]))))
        stops = F.array(*map(F.lit, e.STOP_WORDS))
        return ~F.arrays_overlap(F.split(s["value"], r"\s+"), stops) & bound(before, lambda x: (x != "") & ~x.rlike(r"[.!?]\z"))

    kept = bound(pieces(text), lambda parts: F.filter(spans(text, e.CAPS), lambda s: inside(s, parts)))
    return F.transform(kept, lambda s: _span(s, "person", "ner", 0.63, ord_))


def dictionary_spans(text: Column, name: str, ord_: int = 0) -> Column:
    """Terms of one dictionary; a condition is more certain with a medical word within 60 characters."""
    type_, confidence, terms = e.DICTIONARIES[name]

    def sure(s: Column) -> Column | float:
        if name != "ner_condition":
            return confidence
        at = F.greatest(F.lit(0), s["start"] - 60)
        near = F.substr(text, at + 1, s["stop"] + 60 - at).rlike(java(rf"\b(?:{e.MEDICAL_WORDS})\b", True))
        return F.when(near, confidence).otherwise(0.72)

    return F.transform(spans(text, e.dictionary_regex(terms), True), lambda s: _span(s, type_, "ner", sure(s), ord_))


def term_entities(terms: Column, name: str) -> Column:
    """The same from a dictionary of any size, whose places lexicons.with_terms has found."""
    type_, confidence, _ = e.DICTIONARIES[name]
    sure = lambda t: F.when(t["near"], confidence).otherwise(0.72) if name == "ner_condition" else confidence
    return F.transform(F.filter(terms, lambda t: t["dictionary"] == name), lambda t: _span(t, type_, "ner", sure(t)))


#: Detectors of one kind of entity, in the order in which they take places: a pattern family, then others.
GROUPS = [
    ("ner_person_title", ("ner_person_bigram", "ner_person_caps")), ("ner_org_suffix", ("ner_org_dict",)), ("ner_date", ()), ("ner_medical_phrase", ("ner_drug", "ner_condition", "ner_procedure")),
    ("ner_address", ()), ("ner_phone_spoken", ()), ("ner_email_obfuscated", ()),
]
OTHERS = {"ner_person_bigram": name_pairs, "ner_person_caps": capitalised_runs} | {n: partial(dictionary_spans, name=n) for n in e.DICTIONARIES}


def _kinds(text: Column, terms: Column | None) -> list[Column]:
    """Spans of each of GROUPS, by its detectors in turn; overlaps are not yet settled."""
    one = lambda o: term_entities(terms, o) if terms is not None and o in e.DICTIONARIES else OTHERS[o](text)
    return [F.concat(e.entity_spans(text, e.FAMILIES[f]), *map(one, others)) for f, others in GROUPS]


def every_entity(text: Column, terms: Column | None = None, fold: Callable[[Column], Column] = m.first_writer_wins) -> Column:
    """Spans of all entity detectors, with their kind's place as ord; within a kind earlier detectors win. Without terms, the dictionaries are the short samples."""
    placed = lambda x, i: F.transform(fold(x), lambda s: _span(s, s["type"], "ner", s["confidence"], i))
    return F.concat(*(placed(x, i) for i, x in enumerate(_kinds(text, terms))))


def entities(text: Column, terms: Column | None = None) -> Column:
    """All entities, overlaps swept from left to right."""
    return m.sweep(every_entity(text, terms))


def with_entities(df: DataFrame, terms: str | None = None, into: str = "entities") -> DataFrame:
    """df with text, and the spans of entities beside it, settled in a time that grows with their number; the column of terms is left out."""
    found = every_entity(F.col("text"), F.col(terms) if terms else None, lambda x: x)
    return m.settled(df.select(*(c for c in df.columns if c not in (terms, into)), found.alias(into)), into)


def custom_spans(text: Column, patterns: Sequence[str], keywords: Sequence[str]) -> Column:
    """A tenant's valid patterns and its keywords, whatever the case."""
    found = [F.transform(spans(text, p, True), lambda s: _span(s, "custom", "custom", 0.85)) for p in patterns]
    found += [F.transform(spans(text, re.sub(r"(\W)", r"\\\1", k), True), lambda s: _span(s, "custom", "custom", 0.9)) for k in keywords]
    return F.concat(*found) if found else F.expr(m.EMPTY)


def detected(text: Column, patterns: Sequence[str] = (), keywords: Sequence[str] = (), model: Detector = None, boost: tuple[str, ...] = (), suppress: tuple[str, ...] = (), window: int = 150) -> Column:
    """Built-in, custom and model spans scored by their context, then context spans that overlap none of them."""

    def score(s: Column, places: Column) -> Column:
        near = [bound(e.least_gap(places[side], s["start"], s["stop"], window), lambda x: e.proximity(x, window)) if words else F.lit(0.0) for side, words in (("boost", boost), ("suppress", suppress))]
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["type"].alias("type"), s["source"].alias("source"), e.adjusted(s["confidence"], *near).alias("confidence"), s["ord"].alias("ord"))

    context = F.concat(*(F.transform(e.context_spans(text, x, i), lambda s: _span(s, s["type"], "context", s["confidence"], s["ord"])) for i, x in enumerate(e.CONTEXTS)))

    def merged(own: Column, context: Column) -> Column:
        free = F.filter(context, lambda x: ~F.exists(own, lambda o: m.overlaps(o, x)))
        none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
        places = F.struct(*((e.keyword_places(text, words) if words else none).alias(side) for side, words in (("boost", boost), ("suppress", suppress))))
        return F.filter(F.concat(bound(places, lambda x: F.transform(own, lambda s: score(s, x))), m.first_writer_wins(free)), lambda s: s["confidence"] >= LEAST_CONFIDENCE)

    builtin = F.transform(d.builtin_spans(text), lambda s: _span(s, s["type"], "regex", s["confidence"], s["prio"]))
    every = F.concat(builtin, custom_spans(text, patterns, keywords), *([model(text)] if model else []))
    return bound(F.struct(every.alias("own"), context.alias("context")), lambda x: merged(x["own"], x["context"]))


def cue_probabilities(around: Column) -> Column:
    """A stand-in for a trained classifier: each category's share of the context keywords that stand around a span; null for null.

    One automaton pass over each string. The function counts as one that may change its answers,
    so that no filter on them is put below it, where it would run a second time.
    """
    cues = {t: sorted({k for x in e.CONTEXTS if x.type == t for k in x.keywords}) for t in {x.type for x in e.CONTEXTS}}
    categories = [t for t, _, _ in pr.CATEGORIES]
    words = sorted({k for t in categories for k in cues.get(t, ())})
    own = [np.array([k in cues.get(t, ()) for t in categories], np.int64) for k in words]

    def shares(found: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = lx.automaton({k: i for i, k in enumerate(words)})

        @lru_cache(maxsize=1 << 16)
        def share(held: frozenset) -> list[float]:
            n = sum((own[i] for i in held), np.zeros(len(categories), np.int64))
            return (n / (n.sum() + 1.0)).tolist()

        for texts in found:
            yield pa.array([None if x is None else share(frozenset(i for _, i in places.iter(x))) for x in texts.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(shares, "array<double>").asNondeterministic()(F.lower(around))


def classified(df: DataFrame, found: str = "spans", classify: Callable[[Column], Column] | None = None) -> DataFrame:
    """Long form of df (key columns, text, an array of spans) with severity, after the classifier's changes to doubtful spans.

    classify gets the characters around a span, null for those that are not doubtful, a row a span.
    """
    keys = [c for c in df.columns if c not in ("text", found)]
    near = lambda s, parts: cut_out(parts, F.greatest(F.lit(0), s["start"] - AROUND), s["stop"] + AROUND)
    around = (lambda s, parts: F.when(s["confidence"].between(0.4, 0.8), near(s, parts))) if classify else (lambda s, parts: F.lit(None).cast("string"))
    rows = exploded(df, *keys, array=bound(pieces(F.col("text")), lambda parts: F.transform(found, lambda s: F.struct(s.alias("s"), around(s, parts).alias("around")))), alias="x")
    probs = classify(F.col("x.around")) if classify else F.expr("cast(null as array<double>)")
    long = rows.select(*keys, F.col("x.s.start").alias("span_start"), F.col("x.s.stop").alias("span_end"), "x.s.type", "x.s.source", "x.s.confidence", probs.alias("probs")).withColumn("severity", severity_of(F.col("type")))
    return (pr.adjust(long) if classify else long).drop("probs")


def analyzed(df: DataFrame, found: Column, semantic: Detector = None, terms: str | None = None, ner: str | None = None) -> DataFrame:
    """Of df with text: the other columns, content_hash, counts by stage, the merged spans and their surrogates; text is left out.

    found are the first stage's spans; entities are the second's; semantic is an
    optional third. terms names a column of dictionary places, which is left out too;
    ner names one that holds the entities already, which are found anew where it is None.
    Spans of one type that mostly overlap are merged.
    """
    keys = [c for c in df.columns if c not in ("text", terms, ner)]
    second = F.col(ner) if ner else entities(F.col("text"), F.col(terms) if terms else None)
    staged = df.select(*keys, "text", found.alias("regex"), second.alias("ner"), (semantic(F.col("text")) if semantic else F.expr(m.EMPTY)).alias("semantic"))
    merged = staged.withColumn("spans", m.merge_same_type(F.concat("regex", "ner", "semantic")))
    made = F.transform("spans", lambda s: g.surrogate(s["type"], F.substr("text", s["start"] + 1, s["stop"] - s["start"])))
    return merged.select(*keys, F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), *(F.size(x).alias(f"{x}_count") for x in ("regex", "ner", "semantic")), "spans", made.alias("surrogates"))
