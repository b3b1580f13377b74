"""Queries of entity and context detection, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.functions.dialect import quoted, re2
from redactory.functions.spans import exploded, screened, spans, sql_spans
from redactory.operators import analysis as an
from redactory.operators import detect as d
from redactory.operators import entities as e
from redactory.operators import lexicons as lx
from redactory.operators import merge as m
from redactory.operators import policy as p
from redactory.plans import policy_queries as pq
from redactory.plans.detection_queries import KEYWORDS, REGEXES
from redactory.sources import corpus as c
from redactory.sources.storage import cut

QUERIES, SQL = {}, {}


def _family(name):
    def run(s, sf):
        found = e.entity_spans(F.col("text"), e.FAMILIES[name])
        kept = m.first_writer_wins(found) if len(e.FAMILIES[name]) > 1 else found
        return m.unfold(c.texts(s, sf).select("doc_id", kept.alias("spans"))).select("doc_id", "span_start", "span_end", "type", "confidence")

    return run


def entity_sql(x, ord_=0):
    """doc_id, span_start, span_end, type, confidence, ord of one pattern. What must follow is matched too, then taken off again."""
    until = x.until
    whole = f"{x.regex}(?:{until})" if until else x.regex
    after = f"length(regexp_extract(value, {quoted(re2(f'^(?:{x.regex})({until})$', getattr(x, 'ignore_case', False)))}, 1))" if until else "0"
    return f"""SELECT doc_id, span_start, CAST(span_end - {after} AS INTEGER) AS span_end, '{x.type}' AS type, CAST({x.confidence} AS DOUBLE) AS confidence, {ord_} AS ord
        FROM ({sql_spans(c.TEXTS_SQL, whole, getattr(x, 'ignore_case', False))})"""


def folded_sql(found, order, step):
    """Spans of each document in order, folded: acc is the list kept so far, x a list of the next one."""
    return f"""SELECT doc_id, s.a AS span_start, s.b AS span_end, s.t AS type, s.c AS confidence FROM (
        SELECT doc_id, unnest(list_reduce(l, lambda acc, x: {step})) AS s FROM (
          SELECT doc_id, list([{{'a': span_start, 'b': span_end, 't': type, 'c': confidence, 'o': ord}}] ORDER BY {order}) AS l FROM ({found}) GROUP BY doc_id))"""


FIRST_WINS = "CASE WHEN len(list_filter(acc, lambda o: x[1].a < o.b AND x[1].b > o.a)) > 0 THEN acc ELSE acc || x END"
SWEEP = """CASE WHEN x[1].a >= acc[-1].b THEN acc || x WHEN x[1].b > acc[-1].b AND x[1].c > acc[-1].c THEN acc[1:len(acc) - 1] || x ELSE acc END"""
ENTITIES_SQL = " UNION ALL ".join(entity_sql(x, i) for f in e.FAMILIES.values() for i, x in enumerate(f))
for _name, _members in e.FAMILIES.items():
    QUERIES[_name] = _family(_name)
    SQL[_name] = folded_sql(" UNION ALL ".join(entity_sql(x, i) for i, x in enumerate(_members)), "ord, span_start", FIRST_WINS if len(_members) > 1 else "acc || x")


QUERIES["ner_all_patterns"] = lambda s, sf: exploded(c.texts(s, sf), "doc_id", array=F.concat(*(e.entity_spans(F.col("text"), f) for f in e.FAMILIES.values())), alias="x").groupBy("x.type", "x.confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
SQL["ner_all_patterns"] = f"SELECT type, confidence, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({ENTITIES_SQL}) GROUP BY 1, 2"
# dictionaries: the short samples and thousands of terms of one or two words that come in conversations
_SAMPLES = ", ".join(f"({quoted(n)}, {quoted(t.lower())})" for n, (_, _, terms) in e.DICTIONARIES.items() for t in terms)
_DEALT = "CASE substr(md5(term), 1, 1) " + " ".join(f"WHEN '{h}' THEN '{n}'" for i, n in enumerate(e.DICTIONARIES) for h in (2 * i, 2 * i + 1)) + " END"
_TERMS = f"""SELECT DISTINCT dictionary, term FROM (SELECT {_DEALT} AS dictionary, term FROM (
    SELECT w AS term FROM ({{words}}) WHERE {{fit1}} UNION ALL SELECT w AS term FROM ({{pairs}}) WHERE {{fit2}} AND substr(md5(w), 2, 1) = '0')
    UNION ALL SELECT * FROM (VALUES {_SAMPLES}) AS v(dictionary, term)) WHERE dictionary IS NOT NULL"""
_ONE, _TWO = "^[a-z]{4,}$", "^[a-z]{2,} [a-z]{2,}$"
SPARK_TERMS = _TERMS.format(
    words="SELECT explode(split(lower(text), ' ')) AS w FROM conversations", fit1=f"w RLIKE '{_ONE}'",
    pairs="SELECT explode(transform(slice(l, 1, size(l) - 1), (x, i) -> concat(x, ' ', l[i + 1]))) AS w FROM (SELECT split(lower(text), ' ') AS l FROM conversations) WHERE size(l) > 1", fit2=f"w RLIKE '{_TWO}'",
)
DUCK_TERMS = _TERMS.format(
    words="SELECT unnest(string_split(lower(text), ' ')) AS w FROM conversations", fit1=f"regexp_matches(w, '{_ONE}')",
    pairs="SELECT unnest(list_transform(l[1:len(l) - 1], lambda x, i: x || ' ' || l[i + 1])) AS w FROM (SELECT string_split(lower(text), ' ') AS l FROM conversations) WHERE len(l) > 1", fit2=f"regexp_matches(w, '{_TWO}')",
)
_CUE = rf"(?i)(?<![A-Za-z0-9_])(?:{e.MEDICAL_WORDS})(?![A-Za-z0-9_])"
#: Words and neighbouring pairs of words that a space parts, met with the terms; of each document's hits the leftmost, then longest, stay.
TERM_SPANS_SQL = f"""SELECT doc_id, dictionary, s.a AS span_start, s.b AS span_end FROM (
    SELECT doc_id, dictionary, unnest(list_reduce(l, lambda acc, x: CASE WHEN x[1].a >= acc[-1].b THEN acc || x ELSE acc END)) AS s FROM (
      SELECT doc_id, dictionary, list([{{'a': span_start, 'b': span_end}}] ORDER BY span_start, -span_end) AS l FROM (
        WITH w AS ({sql_spans(c.TEXTS_SQL, "[A-Za-z0-9_]+")}), g AS (SELECT *, lead(value) OVER o AS v2, lead(span_start) OVER o AS s2, lead(span_end) OVER o AS e2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY span_start))
        SELECT doc_id, span_start, span_end, dictionary FROM w JOIN ({DUCK_TERMS}) t ON lower(value) = term
        UNION ALL SELECT doc_id, span_start, e2, dictionary FROM g JOIN ({DUCK_TERMS}) t ON lower(value) || ' ' || lower(v2) = term WHERE s2 = span_end + 1 AND substr(text, s2, 1) = ' ')
      GROUP BY 1, 2))"""


def terms(s, sf):
    return c.relation(s, sf, SPARK_TERMS, "conversations")


def _term_spans(name, type_, confidence):
    def run(s, sf):
        found = lx.term_spans(c.texts(s, sf), terms(s, sf).where(F.col("dictionary") == name), _CUE if name == "ner_condition" else None)
        if name == "ner_condition":
            return found.select("doc_id", "span_start", "span_end", F.when(F.col("near"), confidence).otherwise(0.72).alias("confidence"))
        return found.select("doc_id", "span_start", "span_end", F.lit(type_).alias("type"), F.lit(confidence).alias("confidence"))

    return run


for _name, (_type, _conf, _) in e.DICTIONARIES.items():
    QUERIES[_name] = _term_spans(_name, _type, _conf)
    _OWN = f"SELECT * FROM ({TERM_SPANS_SQL}) WHERE dictionary = '{_name}'"
    SQL[_name] = f"SELECT doc_id, span_start, span_end, '{_type}' AS type, CAST({_conf} AS DOUBLE) AS confidence FROM ({_OWN})"
SQL["ner_condition"] = f"""SELECT doc_id, span_start, span_end, CASE WHEN regexp_matches(substr(text, greatest(0, span_start - 60) + 1, span_end + 60 - greatest(0, span_start - 60)), '(?i)\\b(?:{e.MEDICAL_WORDS})\\b')
    THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.72 AS DOUBLE) END AS confidence FROM (SELECT * FROM ({TERM_SPANS_SQL}) WHERE dictionary = 'ner_condition') JOIN ({c.TEXTS_SQL}) USING (doc_id)"""
#: Names of the samples alone, as the union of all entities has them.
SAMPLE_SQL = {}


def _others(name):
    return lambda s, sf: m.unfold(c.texts(s, sf).select("doc_id", an.OTHERS[name](F.col("text")).alias("spans"))).select("doc_id", "span_start", "span_end", "confidence")


#: Names: the samples and capitalised words of conversations, each a first or a last name by its hash.
_NAMES = "SELECT DISTINCT side, name FROM (SELECT CASE WHEN substr(md5(w), 1, 1) < '8' THEN 'first' ELSE 'last' END AS side, w AS name FROM ({words}) WHERE {fit} UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, names in (("first", e.FIRST_NAMES), ("last", e.LAST_NAMES)) for n in names) + ") AS v(side, name))"
SPARK_NAMES = _NAMES.format(words="SELECT explode(split(text, ' ')) AS w FROM conversations", fit="w RLIKE '^[A-Z][a-z]{2,}$'")
DUCK_NAMES = _NAMES.format(words="SELECT unnest(string_split(text, ' ')) AS w FROM conversations", fit="regexp_matches(w, '^[A-Z][a-z]{2,}$')")
QUERIES["ner_person_bigram"] = lambda s, sf: lx.known_pairs(c.texts(s, sf), c.relation(s, sf, SPARK_NAMES, "conversations")).select("doc_id", "span_start", "span_end", F.lit(0.84).alias("confidence"))
_SPLIT = "regexp_split_to_array(value, '\\s+')"
_BARE = "regexp_replace({}, '^[A-Z][a-z]+-', '')"
def _names_sql(firsts, lasts):
    known = " OR ".join(f"{x} IN {lasts}" for x in ("l", _BARE.format("l"), f"'Al-' || {_BARE.format('l')}", "'Al-' || l"))
    return f"""SELECT doc_id, span_start, span_end, CAST(0.84 AS DOUBLE) AS confidence FROM (SELECT *, {_SPLIT}[1] AS f, {_SPLIT}[2] AS l FROM ({sql_spans(c.TEXTS_SQL, e.BIGRAM)}))
    WHERE (f IN {firsts} OR {_BARE.format('f')} IN {firsts}) AND ({known})"""


SQL["ner_person_bigram"] = f"WITH n AS ({DUCK_NAMES}) " + _names_sql("(SELECT name FROM n WHERE side = 'first')", "(SELECT name FROM n WHERE side = 'last')")
SAMPLE_SQL["ner_person_bigram"] = _names_sql(tuple(e.FIRST_NAMES), tuple(e.LAST_NAMES))
QUERIES["ner_person_caps"] = _others("ner_person_caps")
SQL["ner_person_caps"] = f"SELECT doc_id, span_start, span_end, CAST(0.63 AS DOUBLE) AS confidence FROM (SELECT *, regexp_replace(substr(text, 1, span_start), '\\s+$', '') AS b FROM ({sql_spans(c.TEXTS_SQL, e.CAPS)})) WHERE b <> '' AND NOT regexp_matches(b, '[.!?]$') AND NOT list_has_any({_SPLIT}, {e.STOP_WORDS!r})"

SAMPLE_SQL["ner_person_caps"] = SQL["ner_person_caps"]


def _termed(s, sf):
    """doc_id, text and the places of the dictionaries' terms, found in one pass."""
    return lx.with_terms(c.texts(s, sf).select("doc_id", "text"), terms(s, sf), _CUE, cued=("ner_condition",))


QUERIES["ner_all"] = lambda s, sf: m.unfold(m.settled(_termed(s, sf).select("doc_id", an.every_entity(F.col("text"), F.col("terms"), lambda x: x).alias("spans")))).select("doc_id", "span_start", "span_end", "type", "confidence")


def _group_sql(family, others):
    """Spans of one kind of entity: each detector's in turn, where none before it has a place."""
    type_ = {"ner_person_bigram": "person", "ner_person_caps": "person"} | {n: t for n, (t, _, _) in e.DICTIONARIES.items()}
    found = [entity_sql(x, i) for i, x in enumerate(e.FAMILIES[family])]
    found += [f"SELECT doc_id, span_start, span_end, '{type_[o]}' AS type, confidence, {len(found) + i} AS ord FROM ({SAMPLE_SQL.get(o) or SQL[o]})" for i, o in enumerate(others)]
    return folded_sql(" UNION ALL ".join(found), "ord, span_start", FIRST_WINS)


_EVERY = " UNION ALL ".join(f"SELECT doc_id, span_start, span_end, type, confidence, {i} AS ord FROM ({_group_sql(*x)})" for i, x in enumerate(an.GROUPS))
SQL["ner_all"] = folded_sql(_EVERY, "span_start, -confidence, ord", SWEEP)


def sql_distance(keywords, window):
    low, at = "lower(text)", f"greatest(0, span_start - {window})"
    before, after = f"substr({low}, {at} + 1, span_start - {at})", f"substr({low}, span_end + 1, {window})"
    around = f"substr({low}, {at} + 1, least(length(text), span_end + {window}) - {at})"
    gaps = []
    for k in keywords:
        n = f"len(string_split({{x}}, '{k}')) - 1"
        gaps += [f"CASE WHEN {n.format(x=around)} > {n.format(x=before)} + {n.format(x=after)} THEN 0 END", f"CASE WHEN contains({before}, '{k}') THEN instr(reverse({before}), '{k[::-1]}') - 1 END", f"CASE WHEN contains({after}, '{k}') THEN instr({after}, '{k}') - 1 END"]
    return f"least({', '.join(gaps)})"


def _context_hits(x):
    return f"SELECT h.doc_id, span_start, span_end, text FROM ({entity_sql(x)}) h JOIN ({c.TEXTS_SQL}) t ON h.doc_id = t.doc_id" if x.until else sql_spans(c.TEXTS_SQL, x.regex)


def context_sql(x):
    return f"""SELECT doc_id, span_start, span_end, '{x.type}' AS type, CAST(d AS INTEGER) AS distance, floor(sc * 1000 + 0.5) / 1000 AS score, floor(sc * {x.confidence} * 1000 + 0.5) / 1000 AS confidence
        FROM (SELECT *, CASE WHEN d IS NULL OR d > {x.window} THEN 0.0::DOUBLE ELSE 1 - d::DOUBLE / {x.window} END AS sc FROM (SELECT *, {sql_distance(x.keywords, x.window)} AS d FROM ({_context_hits(x)})))
        WHERE sc >= 0.3 AND floor(sc * {x.confidence} * 1000 + 0.5) / 1000 >= 0.5"""


for _x in e.CONTEXTS:
    QUERIES[_x.op] = lambda s, sf, x=_x: e.context_candidates(c.texts(s, sf), x)
    SQL[_x.op] = context_sql(_x)

BOOST = ("patient", "production", "call", "contact", "ssn", "card", "server")
SUPPRESS = ("example", "sample", "demo", "fictional", "test")
WINDOW = 150


_KINDS = [x for x in e.CONTEXTS if x.op != "ctx_ip"]  # an address by pattern is a built-in span already


def _scored_spans(s, sf):
    """doc_id and spans with near and against: built-in spans and those of the context patterns, by the keywords of their type."""
    flat = lambda x, type_, confidence: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), type_.alias("type"), confidence.alias("confidence"))
    builtin = F.transform(d.builtin_spans(F.col("text")), lambda x: flat(x, x["type"], x["confidence"]))

    held = screened(F.col("text"), [(x.whole(), False) for x in _KINDS])

    def hits(i, x):
        return F.transform(spans(F.col("text"), x.java(), held=F.array_contains(held, i)), lambda y: flat(y, F.lit(x.type), F.lit(x.confidence)))

    others = [hits(i, x) for i, x in enumerate(_KINDS)]
    own = c.texts(s, sf).select("doc_id", "text", F.concat(builtin, *others).alias("spans"))
    return lx.keyword_distances(own, s.createDataFrame(e.keyword_rows(), "type string, keyword string, side string"), WINDOW).drop("text")


def _scores(s, sf):
    return exploded(_scored_spans(s, sf), "doc_id", array="spans", alias="s").select("doc_id", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), "s.type", "s.confidence", "s.near", "s.against")


#: Spans meet the places of their type's keywords by a range join.
_SCORES = f"""WITH t AS ({c.TEXTS_SQL}), k(type, keyword, side) AS (VALUES {", ".join(f"({quoted(t)}, {quoted(w)}, {quoted(x)})" for t, w, x in e.keyword_rows())}),
    o AS (SELECT doc_id, keyword, p, p + length(keyword) AS q FROM (SELECT doc_id, keyword, unnest(list_transform(g[1:len(g) - 1], lambda x, i: list_sum(list_transform(g[1:i], lambda y: length(y))) + (i - 1) * length(keyword))) AS p
          FROM (SELECT doc_id, keyword, string_split(lower(text), keyword) AS g FROM t JOIN (SELECT DISTINCT keyword FROM k) ON contains(lower(text), keyword)))),
    h AS (SELECT *, row_number() OVER () AS r FROM (SELECT doc_id, span_start, span_end, type, confidence FROM ({pq.SPANS_SQL}) {" ".join(f"UNION ALL SELECT doc_id, span_start, span_end, type, confidence FROM ({entity_sql(x)})" for x in _KINDS)})),
    n AS (SELECT r, side, min(CASE WHEN p < span_start THEN greatest(0, span_start - q) ELSE greatest(0, p - span_end) END) AS gap FROM h JOIN k ON k.type = h.type JOIN o ON o.keyword = k.keyword AND o.doc_id = h.doc_id AND p >= span_start - {WINDOW} AND q <= span_end + {WINDOW} GROUP BY 1, 2)
    SELECT doc_id, span_start, span_end, type, confidence, a.gap AS near, b.gap AS against FROM h LEFT JOIN n a ON a.r = h.r AND a.side = 'boost' LEFT JOIN n b ON b.r = h.r AND b.side = 'suppress'"""
_PROX = "(CASE WHEN {d} IS NULL OR {d} > 150 THEN 0.0::DOUBLE ELSE 1 - {d}::DOUBLE / 150 END)"
QUERIES["keyword_distance"] = lambda s, sf: _scores(s, sf).select("doc_id", "span_start", "span_end", "type", F.col("near").cast("int").alias("near"), F.col("against").cast("int").alias("against"))
SQL["keyword_distance"] = f"SELECT doc_id, span_start, span_end, type, CAST(near AS INTEGER) AS near, CAST(against AS INTEGER) AS against FROM ({_SCORES})"
QUERIES["proximity_score"] = lambda s, sf: _scores(s, sf).select("doc_id", "span_start", "type", e.rounded(e.proximity(F.col("near"), WINDOW)).alias("score"))
SQL["proximity_score"] = f"SELECT doc_id, span_start, type, floor({_PROX.format(d='near')} * 1000 + 0.5) / 1000 AS score FROM ({_SCORES})"
QUERIES["context_boost"] = lambda s, sf: _scores(s, sf).select("doc_id", "span_start", "type", e.adjusted(F.col("confidence"), e.proximity(F.col("near"), WINDOW), F.lit(0.0)).alias("confidence"))
_UP = f"least(1.0::DOUBLE, confidence + (1 - confidence) * {_PROX.format(d='near')} * 0.4::DOUBLE)"
SQL["context_boost"] = f"SELECT doc_id, span_start, type, floor({_UP} * 1000 + 0.5) / 1000 AS confidence FROM ({_SCORES})"
QUERIES["context_suppress"] = lambda s, sf: _scores(s, sf).select("doc_id", "span_start", "type", e.adjusted(F.col("confidence"), e.proximity(F.col("near"), WINDOW), e.proximity(F.col("against"), WINDOW)).alias("confidence"))
SQL["context_suppress"] = f"SELECT doc_id, span_start, type, floor(greatest(0.0::DOUBLE, {_UP} - {_UP} * {_PROX.format(d='against')} * 0.5::DOUBLE) * 1000 + 0.5) / 1000 AS confidence FROM ({_SCORES})"


def _candidates(s, sf):
    """Context spans that no built-in span covers, in the patterns' order: all inside the row, over one scan."""
    found = c.texts(s, sf).select("doc_id", F.concat(*(e.context_spans(F.col("text"), x, i) for i, x in enumerate(e.CONTEXTS))).alias("spans"), d.builtin_spans(F.col("text")).alias("own"))
    free = F.filter("spans", lambda x: ~F.exists("own", lambda o: (o["start"] <= x["start"]) & (o["stop"] >= x["stop"])))
    return exploded(found, "doc_id", array=free, alias="s").select("doc_id", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), "s.type", "s.distance", "s.score", "s.confidence", "s.ord")


QUERIES["context_scan"] = lambda s, sf: _candidates(s, sf).drop("ord", "distance")
_ALL = " UNION ALL ".join(context_sql(x) for x in e.CONTEXTS)
SQL["context_scan"] = f"SELECT doc_id, span_start, span_end, type, score, confidence FROM ({_ALL}) x WHERE NOT EXISTS (SELECT 1 FROM ({pq.SPANS_SQL}) o WHERE o.doc_id = x.doc_id AND o.span_start <= x.span_start AND o.span_end >= x.span_end)"


def _merged(s, sf):
    own = cut(_scores(s, sf).select("doc_id", "span_start", "span_end", "type", e.adjusted(F.col("confidence"), e.proximity(F.col("near"), WINDOW), e.proximity(F.col("against"), WINDOW)).alias("confidence")), "own")
    extra = m.disjoint(cut(_candidates(s, sf), "candidates"), own).withColumn("source", F.lit("context"))
    fresh = m.unfold(m.as_spans(extra.withColumn("ord", F.col("ord") * 1000000 + F.col("span_start")), "doc_id").withColumn("spans", m.first_writer_wins(F.col("spans"))))
    return own.withColumn("source", F.lit("regex")).unionByName(fresh, allowMissingColumns=True).where("confidence >= 0.3")


QUERIES["context_merge"] = _merged
_NUMBERED = " UNION ALL ".join(f"SELECT doc_id, span_start, span_end, type, confidence, {i} AS ord FROM ({context_sql(x)})" for i, x in enumerate(e.CONTEXTS))
_MERGE_OWN = f"SELECT doc_id, span_start, span_end, type, floor(greatest(0.0::DOUBLE, {_UP} - {_UP} * {_PROX.format(d='against')} * 0.5::DOUBLE) * 1000 + 0.5) / 1000 AS confidence FROM ({_SCORES})"
_MERGE_NEW = f"""SELECT * FROM ({_NUMBERED}) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.span_start <= x.span_start AND b.span_end >= x.span_end)
    AND NOT EXISTS (SELECT 1 FROM own w WHERE w.doc_id = x.doc_id AND w.span_start < x.span_end AND w.span_end > x.span_start)"""
SQL["context_merge"] = f"""WITH b AS (SELECT doc_id, span_start, span_end FROM ({pq.SPANS_SQL})), own AS ({_MERGE_OWN})
    SELECT * FROM (SELECT *, 'regex' AS source FROM own UNION ALL SELECT *, 'context' AS source FROM ({folded_sql(_MERGE_NEW, "ord, span_start", FIRST_WINS)})) WHERE confidence >= 0.3"""


def _found(s, model=an.entities):
    """The first stage over a text: built-in and custom spans and those of a model (entities here), scored and merged with contexts."""
    patterns = [x for _, x in d.valid_patterns(s, REGEXES)[0]]
    return an.detected(F.col("text"), patterns, [k for _, k in KEYWORDS], model, BOOST, SUPPRESS, WINDOW)


QUERIES["pipeline_detect"] = lambda s, sf: an.classified(an.with_entities(_termed(s, sf), "terms").select("doc_id", "text", _found(s, lambda _: F.col("entities")).alias("spans")), "spans", an.cue_probabilities)


def _analyze(s, sf):
    """One row per document: hash, counts by stage, types, action of the tenant's policy and how many surrogates differ from each other."""
    own = an.with_entities(c.texts(s, sf).select("doc_id", (F.col("doc_id") % 25).alias("tenant_id"), "text"))
    done = cut(an.analyzed(own, _found(s, lambda _: F.col("entities")), ner="entities"), "analyzed")
    long = m.unfold(done.select("doc_id", "tenant_id", "spans")).withColumn("severity", an.severity_of(F.col("type")))
    top = p.strictest(p.span_actions(long, c.policies(s, sf), c.rules(s, sf)), "doc_id").select("doc_id", "action", "trigger_type")
    types = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["type"])))
    own = done.select("doc_id", "content_hash", "regex_count", "ner_count", "semantic_count", F.size("spans").alias("merged_count"), types.alias("types"), F.size(F.array_distinct("surrogates")).alias("surrogates"))
    return own.join(top, "doc_id", "left").withColumn("action", F.coalesce("action", F.lit("allow"))).withColumn("version", F.lit("1"))


QUERIES["doc_analyze"] = _analyze
