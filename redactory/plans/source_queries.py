"""Queries of sources, files, payloads, predictions and mappings, with SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from redactory.functions import values as v
from redactory.functions.spans import exploded
from redactory.operators import mappings as mp
from redactory.operators import predictions as pr
from redactory.operators import detect as d
from redactory.operators.redact import redacted
from redactory.plans.policy_queries import SPANS_SQL, spans, spans_in_text
from redactory.plans.protection_queries import MASKED_SQL, masked
from redactory.sources import corpus as c
from redactory.sources import storage as st

QUERIES, SQL = {}, {}
_EXT = ["txt", "PDF", "json", "py", "docx", "exe", "csv", "", "html", "xlsx"]
#: One file name, size and time for each document.
FILES_SQL = "SELECT doc_id, source || '/file' || CAST(doc_id AS STRING) || CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{'.' + x if x else ''}'" for i, x in enumerate(_EXT)) + " END AS path, n_chars * 97 AS length, doc_id % 86400 AS mtime, text FROM documents"
_EXTENSION = "CASE WHEN contains(list_last(string_split(path, '/')), '.') THEN lower(list_last(string_split(list_last(string_split(path, '/')), '.'))) ELSE '' END"


def files(s, sf):
    return c.relation(s, sf, FILES_SQL, "documents")


def _in(values):
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


QUERIES["file_supported"] = lambda s, sf: files(s, sf).select("path", st.extension(F.col("path")).isin(st.LOCAL_EXTENSIONS).alias("supported"))
SQL["file_supported"] = f"SELECT path, {_EXTENSION} IN {_in(st.LOCAL_EXTENSIONS)} AS supported FROM ({FILES_SQL})"
QUERIES["file_supported_wide"] = lambda s, sf: files(s, sf).select("path", st.extension(F.col("path")).isin(st.WIDE_EXTENSIONS).alias("supported"))
SQL["file_supported_wide"] = f"SELECT path, {_EXTENSION} IN {_in(st.WIDE_EXTENSIONS)} AS supported FROM ({FILES_SQL})"
QUERIES["file_size_gate"] = lambda s, sf: files(s, sf).select("path", (F.col("length") <= st.LOCAL_BYTES).alias("fits_local"), (F.col("length") <= st.WIDE_BYTES).alias("fits_wide"))
SQL["file_size_gate"] = f"SELECT path, length <= {st.LOCAL_BYTES} AS fits_local, length <= {st.WIDE_BYTES} AS fits_wide FROM ({FILES_SQL})"
QUERIES["file_route"] = lambda s, sf: files(s, sf).select("path", st.route(F.col("path"), F.col("length")).alias("route"))
SQL["file_route"] = f"SELECT path, CASE WHEN {_EXTENSION} IN {_in(st.STUB_EXTENSIONS)} THEN 'stub' WHEN {_EXTENSION} NOT IN {_in(st.LOCAL_EXTENSIONS)} THEN 'unsupported' WHEN length > {st.LOCAL_BYTES} THEN 'too_large' ELSE 'local' END AS route FROM ({FILES_SQL})"


def _written(s, sf):
    """Every document as a text file of its own, named by its number; every third begins with a byte order mark."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text"))
    return st.write_files(c.texts(s, sf).select("doc_id", marked.alias("text")), "doc_id")


def _scan_files(s, sf):
    """Files are written, read, protected, written back one for one, and read again."""
    numbered = lambda df: df.select(F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), "length", F.rtrim("text", F.lit("\n")).alias("text"))
    with st.small_files(s):
        read = numbered(st.scan_files(s, _written(s, sf)))
        masked_ = read.select("doc_id", redacted(F.col("text"), d.builtin_spans(F.col("text")), lambda x: v.mask_placeholder(x["display_name"])).alias("text"))
        back = numbered(st.scan_files(s, st.write_files(masked_, "doc_id")))
        own = st.cut(read.select("doc_id", "length", F.sha2("text", 256).alias("text_sha256")), "read")
        protected = st.cut(back.select("doc_id", F.sha2("text", 256).alias("protected_sha256")), "back")
    return own.join(protected, "doc_id", "left")


QUERIES["scan_files"] = _scan_files
_BYTES = "octet_length(encode(text)) + 1 + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END"
SQL["scan_files"] = f"SELECT doc_id, {_BYTES} AS length, sha256(rtrim(text, chr(10))) AS text_sha256, sha256(rtrim(protected, chr(10))) AS protected_sha256 FROM ({c.TEXTS_SQL}) t JOIN ({MASKED_SQL}) m USING (doc_id) WHERE {_BYTES} <= {st.LOCAL_BYTES}"
QUERIES["decode_bytes"] = lambda s, sf: files(s, sf).select("path", F.concat(F.expr("x'EFBBBF'"), F.col("text").cast("binary")).alias("content"), "text").select("path", (st.decode_text(F.col("content")) == F.col("text")).alias("same"), F.length(st.decode_text(F.concat("content", F.expr("x'FF'")))).alias("chars_with_bad_byte"))
SQL["decode_bytes"] = f"SELECT path, true AS same, length(text) + 1 AS chars_with_bad_byte FROM ({FILES_SQL})"
QUERIES["json_validity"] = lambda s, sf: c.table(s, sf, "events").select("event_id", F.expr("try_parse_json(CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END) IS NOT NULL").alias("valid"))
SQL["json_validity"] = "SELECT event_id, json_valid(CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END) AS valid FROM events"


def _bodies(s, sf):
    """Chat request bodies of several shapes, from conversation turns."""
    t = c.table(s, sf, "conversations")
    shape = F.col("conv_id") % 4
    one = F.when(shape == 0, F.to_json(F.struct(F.col("text").alias("prompt")))).when(shape == 1, F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))))
    two = F.when(shape == 2, F.to_json(F.struct(F.array(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("messages")))).otherwise(F.lit("not json"))
    return t.select("conv_id", "turn", F.coalesce(one, two).alias("body"))


QUERIES["chat_payload_text"] = lambda s, sf: _bodies(s, sf).select("conv_id", "turn", st.payload_text(F.col("body")).alias("prompt"))
SQL["chat_payload_text"] = "SELECT conv_id, turn, CASE WHEN conv_id % 4 < 3 THEN text END AS prompt FROM conversations"
QUERIES["json_all_text"] = lambda s, sf: st.json_strings(_bodies(s, sf).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "body")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("all_text"))
QUERIES["conversation_text"] = lambda s, sf: c.table(s, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
SQL["conversation_text"] = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1"
_HOSTS = [h for _, hs in st.SITES for h in hs] + ["sub.notion.so", "netflix.com", "example.com"]
URLS_SQL = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://' || CASE page_id % " + str(len(_HOSTS)) + " " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS)) + " END || '/p' || CAST(page_id AS STRING) END AS url FROM pages"
_LABEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(url, '{x}')" for x in parts) + f" THEN '{label}'" for label, parts in st.URL_LABELS) + " ELSE 'unknown' END"
QUERIES["url_source"] = lambda s, sf: c.relation(s, sf, URLS_SQL, "pages").select("page_id", st.url_label(F.col("url")).alias("label"))
SQL["url_source"] = f"SELECT page_id, {_LABEL} AS label FROM ({URLS_SQL})"
QUERIES["host_site"] = lambda s, sf: st.host_site(c.relation(s, sf, URLS_SQL, "pages").select("page_id", F.lower(F.expr("parse_url(url, 'HOST')")).alias("host")))
_SITES = ", ".join(f"({i}, '{site}', '{h}')" for i, (site, hs) in enumerate(st.SITES) for h in hs)
SQL["host_site"] = f"SELECT page_id, host, arg_min(site, seq) AS site FROM (SELECT page_id, lower(split_part(url, '/', 3)) AS host FROM ({URLS_SQL})) LEFT JOIN (VALUES {_SITES}) k(seq, site, pattern) ON host = pattern OR ends_with(host, '.' || pattern) GROUP BY 1, 2"
_PATTERNS = "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS pattern_value, CASE p_partkey % 3 WHEN 0 THEN 'keyword_list' WHEN 1 THEN 'regex' ELSE 'semantic' END AS pattern_type, p_size % 4 <> 0 AS enabled FROM part"
QUERIES["load_custom_patterns"] = lambda s, sf: c.relation(s, sf, _PATTERNS, "part").where("enabled AND pattern_type <> 'semantic'").select("id", "pattern_type", "pattern_value")
SQL["load_custom_patterns"] = f"SELECT id, pattern_type, pattern_value FROM ({_PATTERNS}) WHERE enabled AND pattern_type <> 'semantic'"
QUERIES["load_semantic_rules"] = lambda s, sf: c.relation(s, sf, _PATTERNS, "part").where("pattern_type = 'semantic'").select("id", "pattern_value", "enabled")
SQL["load_semantic_rules"] = f"SELECT id, pattern_value, enabled FROM ({_PATTERNS}) WHERE pattern_type = 'semantic'"
_ITEMS = "SELECT source, path, CASE WHEN doc_id % 4 = 0 THEN 'block' WHEN doc_id % 4 = 1 THEN 'redact' ELSE 'allow' END AS action, doc_id % 9 = 0 AS failed FROM (" + FILES_SQL.replace("SELECT doc_id,", "SELECT doc_id, source,") + ")"
QUERIES["files_blocking"] = lambda s, sf: c.relation(s, sf, _ITEMS, "documents").groupBy("source").agg(F.bool_or(F.col("action") == "block").alias("blocks"))
SQL["files_blocking"] = f"SELECT source, bool_or(action = 'block') AS blocks FROM ({_ITEMS}) GROUP BY 1"
QUERIES["files_attention"] = lambda s, sf: c.relation(s, sf, _ITEMS, "documents").where(F.col("action").isin("block", "redact") & ~F.col("failed")).select("path", "action")
SQL["files_attention"] = f"SELECT path, action FROM ({_ITEMS}) WHERE action IN ('block', 'redact') AND NOT failed"

# model outputs
# Label rules of the stand-in model: what holds an at sign, four digits or more, and capitalised words in a row.
_CAPITAL, _NUMBER = "[A-Z][a-z]+[.,;:]?", "[0-9]{4,}[.,;:]?"


def _label_rules():
    """A model of token labels by the token's shape and its neighbours' inside the window; it sees nothing beyond."""
    capital, number = re.compile(_CAPITAL), re.compile(_NUMBER)

    def one(window):
        up = [False, *(capital.fullmatch(t) is not None for t in window), False]
        for i, t in enumerate(window, 1):
            prob = 0.375 if len(t) % 4 == 3 else 0.875
            yield ("B-EMAIL" if "@" in t else "I-ID_DOC" if number.fullmatch(t) else "I-PERSON" if up[i] and up[i - 1] else "B-PERSON" if up[i] and up[i + 1] else "O"), prob

    return lambda batch: [list(one(w)) for w in batch]


#: The same labels over whole texts, without windows.
_PIECES = f"SELECT doc_id, i, p, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 1 AS a FROM (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n\\r\\t]') AS l FROM ({c.TEXTS_SQL})))"
_UP = f"regexp_full_match(p, '{_CAPITAL}')"
_WORDS = f"SELECT doc_id, p, a, row_number() OVER w AS tok_idx, {_UP} AS up, coalesce(lag({_UP}) OVER w, false) AS up_before, coalesce(lead({_UP}) OVER w, false) AS up_after FROM ({_PIECES}) WHERE p <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
DUCK_TOKENS = f"""SELECT doc_id, tok_idx, CASE WHEN contains(p, '@') THEN 'B-EMAIL' WHEN regexp_full_match(p, '{_NUMBER}') THEN 'I-ID_DOC' WHEN up AND up_before THEN 'I-PERSON' WHEN up AND up_after THEN 'B-PERSON' ELSE 'O' END AS label,
    CASE WHEN length(p) % 4 = 3 THEN 0.375::DOUBLE ELSE 0.875::DOUBLE END AS prob, CAST(a AS INTEGER) AS char_start, CAST(a + length(p) AS INTEGER) AS char_end FROM ({_WORDS})"""
_BIO = f"""SELECT doc_id, entity, a AS span_start, b AS span_end, floor(p * 1000 + 0.5) / 1000 AS confidence FROM (
    SELECT doc_id, island, first(entity) AS entity, min(char_start) AS a, max(char_end) AS b, avg(prob) AS p FROM (
      SELECT *, sum(CASE WHEN entity IS NOT NULL AND (label LIKE 'B-%' OR before IS DISTINCT FROM entity) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS island FROM (
        SELECT *, lag(entity) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS before FROM (
          SELECT *, CASE WHEN label <> 'O' THEN substr(label, 3) END AS entity FROM ({DUCK_TOKENS}))))
    WHERE entity IS NOT NULL GROUP BY 1, 2) WHERE p >= 0.5 AND b > a"""


def _bio(s, sf):
    """Spans of the stand-in model over whole texts; windows are short, so that most texts have seams."""
    return pr.bio_spans(pr.label_tokens(c.texts(s, sf), _label_rules, 48, 8, r"[^ \n\r\t]+"))


QUERIES["bio_spans"] = _bio
SQL["bio_spans"] = _BIO
QUERIES["islands"] = lambda s, sf: _bio(s, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("chars"))
SQL["islands"] = f"SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS chars FROM ({_BIO}) GROUP BY 1"
QUERIES["bio_type_map"] = lambda s, sf: pr.typed(_bio(s, sf)).groupBy("entity", "type", "severity").agg(F.count(F.lit(1)).alias("n"))
SQL["bio_type_map"] = f"SELECT entity, CASE entity WHEN 'EMAIL' THEN 'email' WHEN 'PERSON' THEN 'person_name' ELSE 'identity_document' END AS type, CASE entity WHEN 'ID_DOC' THEN 'critical' ELSE 'medium' END AS severity, count(*) AS n FROM ({_BIO}) GROUP BY ALL"


def _argmax(s, sf):
    at, p = pr.argmax(F.col("embedding"))
    return c.table(s, sf, "embeddings").select("vec_id", at.alias("best"), (F.floor(p * 100000 + 0.5) / 100000).alias("p"))


QUERIES["softmax_argmax"] = _argmax
SQL["softmax_argmax"] = "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, floor(100000 / list_sum(list_transform(embedding, lambda x: exp((x - list_max(embedding))::DOUBLE))) + 0.5) / 100000 AS p FROM embeddings"
QUERIES["top_category"] = lambda s, sf: c.table(s, sf, "embeddings").select("vec_id", F.array_position(F.slice("embedding", 1, 10), F.array_max(F.slice("embedding", 1, 10))).alias("category"))
SQL["top_category"] = "SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) AS category FROM embeddings"
_PROBS = "transform(sequence(0, 9), i -> CASE WHEN i = doc_id % 10 THEN CAST((doc_id * 37 + span_start) % 100 AS DOUBLE) / 100 ELSE 0.01 END)"


def _adjusted(s, sf):
    weak = spans(s, sf).select("doc_id", "span_start", "type", "severity", (F.col("confidence") - (F.col("doc_id") % 6) * 0.1).alias("confidence"))
    out = pr.adjust(weak.withColumn("probs", F.expr(_PROBS))).drop("probs")
    return out.withColumn("confidence", F.round("confidence", 6))


QUERIES["classifier_adjust"] = _adjusted
_TYPES = "[" + ", ".join(f"'{x[0]}'" for x in pr.CATEGORIES) + "]"
_SEVS = "[" + ", ".join(f"'{x[2]}'" for x in pr.CATEGORIES) + "]"
SQL["classifier_adjust"] = f"""SELECT doc_id, span_start, CASE WHEN r THEN {_TYPES}[k] ELSE type END AS type, CASE WHEN r THEN {_SEVS}[k] ELSE severity END AS severity, round(n, 6) AS confidence FROM (
    SELECT *, amb AND best > 0.8 AND type <> {_TYPES}[k] AS r, CASE WHEN NOT amb THEN confidence WHEN best > 0.5 THEN least(0.95::DOUBLE, confidence + (best - 0.5::DOUBLE) * 0.6::DOUBLE) ELSE greatest(0.1::DOUBLE, confidence * 0.5::DOUBLE) END AS n FROM (
      SELECT *, list_max(probs) AS best, list_position(probs, list_max(probs)) AS k, confidence BETWEEN 0.4 AND 0.8 AS amb FROM (
        SELECT doc_id, span_start, type, severity, confidence - (doc_id % 6) * 0.1::DOUBLE AS confidence, list_transform(range(0, 10), lambda i: CASE WHEN i = doc_id % 10 THEN ((doc_id * 37 + span_start) % 100)::DOUBLE / 100 ELSE 0.01::DOUBLE END) AS probs FROM ({SPANS_SQL}))))
    WHERE n >= 0.3"""


#: What a model calls these types in its answers.
_ANSWERED = {"email": "email", "phone": "phone", "ip_address": "ip", "date": "dob", "ssn": "ssn"}


def _answers(s, sf):
    """Answers that name a span's value: fenced, with a value that the text lacks, and cut off."""
    one = spans_in_text(s, sf).where(F.col("type").isin(*_ANSWERED))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in _ANSWERED.items() for x in pair)), F.col("type"))
    item = F.to_json(F.struct(kind.alias("type"), "value"))
    shaped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), item, F.lit(',{"type":"name","value":"nobody by that name"}] ok'))).otherwise(F.concat(F.lit('{"detections":['), item, F.lit(',{"type":"em')))
    return pr.answer_spans(one.select("doc_id", "text", shaped.alias("response")))


QUERIES["llm_response_spans"] = _answers
SQL["llm_response_spans"] = f"""SELECT doc_id, CAST(instr(text, value) - 1 AS INTEGER) AS span_start, CAST(instr(text, value) - 1 + length(value) AS INTEGER) AS span_end, type, CAST(0.92 AS DOUBLE) AS confidence
    FROM (SELECT doc_id, value, type FROM ({SPANS_SQL}) WHERE type IN {tuple(_ANSWERED)}) JOIN ({c.TEXTS_SQL}) USING (doc_id)"""
QUERIES["llm_relabel_fix"] = lambda s, sf: c.table(s, sf, "customer").select("c_custkey", pr.relabelled(F.lit("financial"), F.lower(F.concat_ws("", F.when(F.col("c_custkey") % 2 == 0, F.lit("mr-")).otherwise(F.lit("$")), F.col("c_custkey").cast("string")))).alias("type"))
SQL["llm_relabel_fix"] = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey >= 1000 THEN 'medical_record' ELSE 'financial' END AS type FROM customer"


def _model(s, sf):
    def predict(pdf):
        return pdf.assign(n=pdf["text"].fillna("").str.len()).loc[:, ["doc_id", "n"]]

    return pr.score_with(c.documents(s, sf), predict, "doc_id long, n long")


QUERIES["model_scores"] = _model
SQL["model_scores"] = "SELECT doc_id, length(text) AS n FROM documents"


# mappings
def _mapping_for_detection(s, sf):
    """Spans are found and written once; mappings are made of them and joined back."""
    found = st.cut(spans(s, sf).select("doc_id", "type", "span_start", "span_end", "display_name"), "found")
    mappings = found.where("span_start % 5 <> 0").withColumn("replacement", v.mask_placeholder(F.col("display_name"))).withColumn("idx", F.col("span_start"))
    return mp.mapping_for_detection(found.drop("display_name"), mappings)


QUERIES["mapping_for_detection"] = _mapping_for_detection
SQL["mapping_for_detection"] = f"SELECT doc_id, type, span_start, span_end, CASE WHEN span_start % 5 <> 0 THEN '[' || regexp_replace(upper(display_name), '\\s+', '_', 'g') || ']' END AS replacement FROM ({SPANS_SQL})"
_REVIEW = "SELECT path AS name, length AS size, mtime, CASE doc_id % 4 WHEN 0 THEN 'protected' WHEN 1 THEN 'skipped' ELSE 'pending' END AS status, 'safe-' || path AS protected_name FROM (" + FILES_SQL + ") WHERE doc_id % 5 <> 0"
QUERIES["final_file_list"] = lambda s, sf: mp.final_files(files(s, sf).select(F.col("path").alias("name"), F.col("length").alias("size"), "mtime"), c.relation(s, sf, _REVIEW, "documents")).select("name", "sent")
SQL["final_file_list"] = f"SELECT f.path AS name, CASE WHEN status = 'protected' THEN protected_name ELSE f.path END AS sent FROM ({FILES_SQL}) f LEFT JOIN ({_REVIEW}) i ON f.path = i.name AND f.length = i.size AND f.mtime = i.mtime WHERE coalesce(status, 'clean') <> 'skipped'"


def _reviewed(s, sf):
    """doc_id, masked text, its tokens and its mappings, from one scan; names, starts and tokens are left out in turn."""
    found = c.texts(s, sf).select("doc_id", "text", d.builtin_spans(F.col("text")).alias("spans"))
    keyed = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["type"].alias("type"), x["display_name"].alias("display_name"))))

    def mapping(x, i):
        return F.struct(i.cast("int").alias("idx"), F.when(x["start"] % 7 != 3, x["start"]).alias("span_start"), F.when(x["start"] % 2 == 0, v.mask_placeholder(x["display_name"])).alias("placeholder"), F.when(x["start"] % 5 == 1, F.lit("[EMAIL]")).otherwise("[NONE]").alias("replacement"), F.when(x["start"] % 3 != 0, x["display_name"]).alias("display_name"))

    text = redacted(F.col("text"), F.col("spans"), lambda x: v.mask_placeholder(x["display_name"]))
    rows = found.select("doc_id", text.alias("protected"), F.transform(keyed, mapping).alias("mappings"))
    return rows.withColumn("pairs", mp.paired(F.regexp_extract_all("protected", F.lit(mp.TOKEN), F.lit(0)), F.col("mappings")))


def _pairs(s, sf):
    return exploded(_reviewed(s, sf), "doc_id", array="pairs", alias="p").select("doc_id", "p.*")


def _choices(s, sf):
    """Two of three mappings are chosen; the tokens of some were edited, so that they fall back on their names."""

    def choice(m):
        token = F.get(F.filter("pairs", lambda p: p["idx"] == m["idx"]), F.lit(0))["token"]
        return F.struct(m["idx"].alias("idx"), (m["idx"] % 3 != 0).alias("enabled"), F.concat(F.lit("<"), m["idx"].cast("string"), F.lit(">")).alias("chosen"), F.when(m["idx"] % 4 != 1, token).alias("token"), m["placeholder"].alias("placeholder"), m["replacement"].alias("replacement"))

    return _reviewed(s, sf).select("doc_id", mp.with_choices(F.col("protected"), F.transform("mappings", choice)).alias("protected"))


QUERIES["token_occurrence"] = lambda s, sf: mp.bracket_tokens(masked(s, sf)).select("doc_id", "token", "nth")
QUERIES["token_map"] = _pairs
QUERIES["apply_choices"] = _choices
QUERIES["protect_choices"] = lambda s, sf: _protect_choices(s, sf)


_TOKENS_SQL = f"SELECT doc_id, unnest(list_transform(regexp_extract_all(protected, '\\[[A-Z][A-Z0-9_ ]*\\]'), lambda x, i: {{'token': x, 'pos': i}})) AS t FROM ({MASKED_SQL})"
SQL["token_occurrence"] = f"SELECT doc_id, t.token AS token, row_number() OVER (PARTITION BY doc_id, t.token ORDER BY t.pos) AS nth FROM ({_TOKENS_SQL})"
_REPLACED = "regexp_replace(value, '[0-9]', 'X', 'g')"
SQL["protect_choices"] = f"""SELECT t.doc_id, CASE WHEN p IS NULL THEN text ELSE (list_reduce(list_prepend({{'k': 0, 'o': '', 'r': text}}, list_sort(list_distinct(p))), lambda acc, x: {{'k': 0, 'o': '', 'r': replace(acc.r, x.o, x.r)}})).r END AS protected
    FROM ({c.TEXTS_SQL}) t LEFT JOIN (SELECT doc_id, list({{'k': CAST(-length(value) AS INTEGER), 'o': value, 'r': {_REPLACED}}}) AS p FROM ({SPANS_SQL}) WHERE doc_id % 7 <> 0 AND trim(value) <> '' GROUP BY 1) q ON t.doc_id = q.doc_id"""


def _protect_choices(s, sf):
    """Each found value with its digits masked; documents whose number divides by 7 chose blanks."""
    pair = lambda x: F.struct(x["value"].alias("original"), F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(v.mask_digits(x["value"])).alias("replacement"))
    found = c.texts(s, sf).select("doc_id", "text", F.transform(d.builtin_spans(F.col("text")), pair).alias("pairs"))
    return found.select("doc_id", mp.literal_pairs(F.col("text"), F.col("pairs")).alias("protected"))


def _popup(s, sf):
    own = spans(s, sf).select("doc_id", "display_name", F.lit(1).alias("n"))
    file_part = c.table(s, sf, "pages").where("page_id % 5 <> 0").select(F.col("page_id").alias("doc_id"), F.lit("File").alias("display_name"), (F.col("page_id") % 5).cast("int").alias("n"))
    return own.unionByName(file_part).groupBy("display_name").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("documents"))


QUERIES["popup_summary"] = _popup
SQL["popup_summary"] = f"SELECT display_name, sum(n) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, display_name, 1 AS n FROM ({SPANS_SQL}) UNION ALL SELECT page_id, 'File', page_id % 5 FROM pages WHERE page_id % 5 <> 0) GROUP BY 1"


def _fallback(s, sf):
    """The preview is the found value; its mask or its placeholder is known for two of three."""
    found = spans(s, sf)
    mask = F.when(F.col("span_start") % 3 == 0, v.mask_digits(F.col("value")))
    place = F.when(F.col("span_start") % 3 == 1, v.mask_placeholder(F.col("display_name")))
    return found.select("doc_id", "span_start", "type", mp.fallback_dummy(F.col("type"), F.col("display_name"), F.col("value"), mask, place).alias("stand_in"))


QUERIES["fallback_dummy"] = _fallback
_STAND_IN = (
    [f"WHEN lower(type) = '{k}' THEN '{x}'" for k, x in mp.STAND_IN_BY_TYPE.items()]
    + [f"WHEN regexp_matches(lower(display_name), '{'|'.join(words)}') THEN '{x}'" for words, x in mp.STAND_IN_BY_NAME]
    + [f"WHEN regexp_matches(value, '{shape}') THEN '{x}'" for shape, x in mp.STAND_IN_BY_SHAPE]
    + ["WHEN span_start % 3 = 0 AND value <> '' THEN regexp_replace(value, '[0-9]', 'X', 'g')", "WHEN span_start % 3 = 1 AND display_name <> '' THEN '[' || regexp_replace(upper(display_name), '\\s+', '_', 'g') || ']'"]
)
SQL["fallback_dummy"] = f"SELECT doc_id, span_start, type, CASE {' '.join(_STAND_IN)} ELSE '[REDACTED]' END AS stand_in FROM ({SPANS_SQL})"
