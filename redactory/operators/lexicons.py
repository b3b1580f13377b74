"""Tables of thousands of terms: one automaton pass over each text finds dictionary terms and context keywords.

A table is measured before it is sent to the tasks. One that is too large is dealt
into blocks; the texts go through one after the other and carry their hits along, so
nothing is shuffled and the rows are the same. Of dictionary terms, only those of odd
signs or many words need an automaton, which takes hundreds of bytes a term; the
others stand in a table of hashes (termtable.py).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from redactory.functions.spans import exploded, spans
from redactory.operators import entities as e
from redactory.operators import termtable as tt
from redactory.operators.termtable import lowered
from redactory.sources.storage import cut

#: Bytes of terms that one automaton, or table of hashes, and so one task, may hold.
BLOCK_BYTES = 32 << 20
#: Characters of texts that a task works on at once; what it finds in them is Python objects, many times as large.
PART_CHARS = 1 << 18
_WORD = tt.WORD


def usable(terms: DataFrame, column: str = "term") -> tuple[DataFrame, DataFrame]:
    """Terms in lower case without repeats, and the rejected rows: null or blank ones, which would hit everywhere or nowhere."""
    blank = F.coalesce(F.trim(F.col(column)) == "", F.lit(True))
    return terms.where(~blank).withColumn(column, F.lower(column)).distinct(), terms.where(blank).withColumn("reason", F.lit("blank term"))


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PART_CHARS characters of text, or one row where its text is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > PART_CHARS:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def blocks(terms: DataFrame, column: str = "term", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a table of terms, in blocks of about that many bytes at most: 32 and its signs for a term that a table of hashes takes, hundreds for another."""
    signs = F.octet_length(column)
    plain = F.col(column).rlike(rf"^[a-z0-9_]+([\x00-\x7f&&[^a-z0-9_]]+[a-z0-9_]+){{0,{tt.WORDS - 1}}}\z") & (signs <= tt.SIGNS)
    size = terms.agg(F.coalesce(F.sum(F.when(plain, signs + 32).otherwise(signs * 16 + 256)), F.lit(0))).first()[0]
    n = size // most + 1
    for i in range(n):
        yield (terms if n == 1 else terms.where(F.pmod(F.xxhash64(column), F.lit(n)) == i)).toArrow()


def automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w, value in words.items():
        found.add_word(w, value)
    if words:
        found.make_automaton()
    return found


def bordered(text: str, start: int, stop: int) -> bool:
    """No ASCII word sign right before or after."""
    return (start == 0 or text[start - 1] not in _WORD) and (stop >= len(text) or text[stop] not in _WORD)


_HIT = "array<struct<dictionary:string,start:int,stop:int,near:boolean>>"


def with_terms(df: DataFrame, terms: DataFrame, cue: str | None = None, around: int = 60, most: int = BLOCK_BYTES, into: str = "terms", without: tuple[str, ...] = (), cued: tuple[str, ...] | None = None) -> DataFrame:
    """df with an array of where the terms of each dictionary stand, whatever their case: dictionary, start, stop, near.

    df: text and any columns, of which those in without are left out; a column of the
    array's name is replaced. terms: dictionary, term. A term stands between signs that
    are no ASCII word signs; of overlapping terms of one dictionary the leftmost
    stays, then the longest. near says whether the cue, a pattern, is found within
    around characters; it is looked for beside the terms of the dictionaries named in
    cued, or of all. Null texts, and blank terms, give an empty array. The usable terms
    are written to a shared scratch folder, so that measuring them and reading their
    blocks works them out once.
    """
    own = cut(usable(terms.select("dictionary", "term"))[0], "terms")

    def passed(table: tt.Table, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others = automaton({t: (len(t), t) for t in table.others})
            sure = re.compile(cue) if cue else None

            def odd(lows: list[str], number: dict[str, int]) -> list[tuple[int, int, int, int]]:
                return [(i, number[d], at + 1 - size, at + 1) for i, low in enumerate(lows if table.others else ()) for at, (size, t) in others.iter(low) if bordered(low, at + 1 - size, at + 1) for d in table.others[t]]

            for batch in parts(batches):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                before = batch.column(into)
                old = before.flatten()
                names = tt.ordered([*table.names, *pc.unique(old.field("dictionary")).to_pylist()])
                number = {n: i for i, n in enumerate(names)}
                lows = [lowered(t) for t in texts]
                found = [(i, np.array([number[n] for n in table.names], np.int64)[d], a, b) for i, d, a, b in table.places(lows)]
                found.append(tuple(np.array(odd(lows, number), np.int64).reshape(-1, 4).T))
                if len(old):
                    counts = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64)
                    kinds = pc.index_in(old.field("dictionary"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
                    found.append((np.repeat(np.arange(len(counts)), counts), kinds, old.field("start").to_numpy(), old.field("stop").to_numpy()))
                text, kind, start, stop = (np.concatenate([x[k] for x in found]).astype(np.int64) for k in range(4))
                order = np.lexsort((-stop, start, kind, text))
                near = None
                if last:
                    kept, key, end = [], None, 0
                    for j, i, k, a, b in zip(order.tolist(), *(x[order].tolist() for x in (text, kind, start, stop)), strict=True):
                        if (i, k) != key:
                            key, end = (i, k), 0
                        if a >= end:
                            kept.append(j)
                            end = b
                    order = np.array(kept, np.int64)
                    if sure:
                        asked = [number[n] for n in names if cued is None or n in cued]
                        near = np.array([k in asked and bool(sure.search(texts[i][max(0, a - around) : b + around])) for i, k, a, b in zip(*(x[order].tolist() for x in (text, kind, start, stop)), strict=True)], bool)
                near = np.zeros(len(order), bool) if near is None else near
                text, kind, start, stop = (x[order] for x in (text, kind, start, stop))
                hits = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(kind)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(near)], ["dictionary", "start", "stop", "near"])
                made = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), hits)
                columns = [n for n in batch.schema.names if not (last and n in without)]
                yield pa.RecordBatch.from_arrays([made if n == into else batch.column(n) for n in columns], columns)

        return run

    rows = df.withColumn(into, F.expr(f"cast(array() as {_HIT})"))
    *others, final = map(tt.Table, blocks(own, most=most))
    for table in others:
        rows = rows.mapInArrow(passed(table, False), rows.schema)
    return rows.mapInArrow(passed(final, True), StructType([f for f in rows.schema.fields if f.name not in without]))


def term_spans(texts: DataFrame, terms: DataFrame, cue: str | None = None, around: int = 60, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, dictionary, span_start, span_end, near: the places of with_terms, a row each.

    texts: doc_id, text; other columns are not read. Rows that repeat give theirs each.
    """
    own = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = exploded(with_terms(own, terms, cue, around, most, without=("text",)), "doc_id", array="terms", alias="t")
    return found.select("doc_id", "t.dictionary", F.col("t.start").alias("span_start"), F.col("t.stop").alias("span_end"), "t.near")


def keyword_distances(df: DataFrame, keywords: DataFrame, window: int = 150, found: str = "spans", most: int = BLOCK_BYTES) -> DataFrame:
    """df with each span's least distance to a keyword of its type on either side: near (boost) and against (suppress).

    df: any columns, text and an array of structs with start, stop and type;
    keywords: type, keyword, side. The array becomes structs with near and against
    added: 0 where a keyword touches or overlaps the span, null where none lies wholly
    within the window. All keywords of a text are found in one pass and kept as
    sorted places by type and side; a span looks its own ones up by bisection, so
    the cost follows neither the number of types nor that of keywords. A type
    without keywords has none near. Null texts and null arrays stay as they are.
    """
    own, _ = usable(keywords.select("type", "keyword", "side"), "keyword")
    size = own.agg(F.coalesce(F.sum(F.octet_length("keyword") + 64), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the keyword table holds {size} bytes, above {most}; call once for each part of the types")
    rows = own.collect()
    by_word: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for r in rows:
        by_word[r.keyword].append((r.type, r.side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton({w: (len(w), tuple(sorted(x))) for w, x in by_word.items()})

        def least(places: list[tuple[int, int]], start: int, stop: int) -> int | None:
            best = None
            for a, b in places[bisect_left(places, (start - window, 0)) : bisect_left(places, (stop + window + 1, 0))]:
                if b <= stop + window:
                    gap = max(0, start - b) if a < start else max(0, a - stop)
                    best = gap if best is None or gap < best else best
            return best

        for batch in parts(batches):
            at = batch.schema.get_field_index(found)
            made = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True):
                places: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
                if text and own and by_word:
                    types = {s["type"] for s in own}
                    for last, (size, keys) in words.iter(lowered(text)):
                        for key in keys:
                            if key[0] in types:
                                places[key].append((last + 1 - size, last + 1))
                    for p in places.values():
                        p.sort()
                made.append(own and [[least(places.get((s["type"], side), []), s["start"], s["stop"]) for side in ("boost", "suppress")] for s in own])
            spans_of = batch.column(at)
            flat = [x for m in made for x in m or ()]
            inner = spans_of.flatten()
            fields = [*(inner.field(i) for i in range(inner.type.num_fields)), *(pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1))]
            struct = pa.StructArray.from_arrays(fields, [*(inner.type.field(i).name for i in range(inner.type.num_fields)), "near", "against"])
            offsets = pa.array([0, *accumulate(len(m or ()) for m in made)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, struct, mask=spans_of.is_null()) if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)

    element = df.schema[found].dataType.elementType
    kind = StructType([StructField(f.name, ArrayType(StructType([*element.fields, StructField("near", IntegerType()), StructField("against", IntegerType())]))) if f.name == found else f for f in df.schema.fields])
    return df.mapInArrow(run, kind)


def known_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end: a known first name before a known last name.

    names: side (first or last), name. A part such as Al- before either may be
    missing or added. Candidates come from a pattern; each asks the table for the
    forms it may have, so the table may have any size: it is joined, not sent.
    """
    found = exploded(texts, "doc_id", array=spans(F.col("text"), e.BIGRAM), alias="s")
    words = F.split("s.value", r"\s+")
    bare = lambda w: F.regexp_replace(w, "^[A-Z][a-z]+-", "")
    al = lambda w: F.concat(F.lit("Al-"), w)
    first, last = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    forms = [("first", first), ("first", bare(first)), ("last", last), ("last", bare(last)), ("last", al(bare(last))), ("last", al(last))]
    asked = found.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), F.explode(F.array_distinct(F.array(*(F.struct(F.lit(k).alias("side"), x.alias("name")) for k, x in forms)))).alias("f")).select("doc_id", "span_start", "span_end", "f.side", "f.name")
    known = asked.join(names.select("side", "name").distinct(), ["side", "name"], "left_semi")
    return known.groupBy("doc_id", "span_start", "span_end").agg(F.count_distinct("side").alias("n")).where("n = 2").drop("n")
