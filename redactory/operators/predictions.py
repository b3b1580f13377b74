"""Operators over model outputs: token labels, logits, category probabilities, stored answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Model labels with type and severity, and categories with type, display name and severity.
LABELS = [("SSN", "ssn", "critical"), ("CREDIT_CARD", "credit_card", "critical"), ("EMAIL", "email", "medium"), ("PHONE", "phone", "medium"), ("AWS_KEY", "aws_key", "critical"), ("AWS_SECRET", "aws_secret", "critical"), ("API_KEY", "api_key", "high"), ("PRIVATE_KEY", "private_key", "critical"), ("JWT", "jwt", "high"), ("CONNECTION_STR", "connection_string", "high"), ("PERSON", "person_name", "medium"), ("ORG", "organization", "low"), ("DATE", "date", "low"), ("ADDRESS", "address", "medium"), ("MED_RECORD", "medical_record", "high"), ("FINANCIAL", "financial", "high"), ("ID_DOC", "identity_document", "critical"), ("IP_ADDR", "ip_address", "medium")]
CATEGORIES = [("person_name", "Person Name", "medium"), ("financial", "Financial Information", "high"), ("medical_record", "Medical Record", "high"), ("identity_document", "Identity Document", "critical"), ("address", "Physical Address", "medium"), ("email", "Contact Information", "low"), ("date", "Date / Date of Birth", "medium"), ("api_key", "Credential / Secret", "critical"), ("organization", "Organization Name", "low"), ("financial", "Customer Data", "medium")]
ANSWER_TYPES = [("name", "person_name"), ("money", "financial"), ("medical", "medical_record"), ("id_doc", "identity_document"), ("addr", "address"), ("dob", "date"), ("ip", "ip_address"), ("phone", "phone"), ("email", "email"), ("org", "organization"), ("ssn", "ssn"), ("credential", "api_key")]


def windows(n: int, size: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows over n tokens as (start, stop, own start, own stop): each token is owned by one, which sees half the overlap beside it."""
    step, start = size - overlap, 0
    while start < n:
        last = start + size >= n
        yield start, min(start + size, n), start + (overlap // 2 if start else 0), n if last else start + step + overlap // 2
        if last:
            return
        start += step


def label_tokens(texts: DataFrame, make: Callable[[], Callable[[list[list[str]]], list[list[tuple[str, float]]]]], size: int = 256, overlap: int = 64, token: str = r"\S+", batch: int = 64) -> DataFrame:
    """doc_id, tok_idx, label, prob, char_start, char_end: a token model's labels over whole texts.

    A text is cut into tokens (matches of token), these into windows of size that
    share overlap tokens, so a model of bounded input reads all of it. make() is called
    once in a task; what it gives takes up to batch windows and returns one (label,
    probability) for each of their tokens. At a seam, each token's label comes from
    the window that sees more around it. Tokens labelled O give no row, only a gap in
    tok_idx. Null and empty texts give none; other columns are not read.
    """
    if not 0 <= overlap < size or overlap % 2:
        raise ValueError("overlap must be even and less than size")
    kind = "doc_id long, tok_idx int, label string, prob double, char_start int, char_end int"
    schema = pa.schema([("doc_id", pa.int64()), ("tok_idx", pa.int32()), ("label", pa.string()), ("prob", pa.float64()), ("char_start", pa.int32()), ("char_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, word = make(), re.compile(token)

        def cuts() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    places = [m.span() for m in word.finditer(text.as_py() or "")]
                    if places:
                        whole = text.as_py()
                        for w in windows(len(places), size, overlap):
                            yield doc, w, places, [whole[i:j] for i, j in places[w[0] : w[1]]]

        todo = cuts()
        while some := list(islice(todo, batch)):
            rows = []
            for (doc, (start, _, own, end), places, _), labels in zip(some, model([x[3] for x in some]), strict=True):
                rows += [(doc, i, *labels[i - start], *places[i]) for i in range(own, end) if labels[i - start][0] != "O"]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def bio_spans(tokens: DataFrame, least: float = 0.5) -> DataFrame:
    """Merge B-, I- and O labels (doc_id, tok_idx, label, prob, char_start, char_end) into spans.

    An I- of another type starts a span of its own; special tokens (0, 0), O and a gap
    in tok_idx, which counts a document's tokens, end one. Only labelled tokens are
    shuffled, by document; islands come from one ordered pass over them.
    """
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    real = (F.col("label") != "O") & ~((F.col("char_start") == 0) & (F.col("char_end") == 0))
    t = tokens.where(real).withColumn("entity", F.substring("label", 3, 100))
    follows = F.lag("entity").over(w).eqNullSafe(F.col("entity")) & (F.lag("tok_idx").over(w) == F.col("tok_idx") - 1)
    opens = F.startswith("label", F.lit("B-")) | ~F.coalesce(follows, F.lit(False))
    islands = t.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(w))
    spans = islands.groupBy("doc_id", "island").agg(F.first("entity").alias("entity"), F.min("char_start").alias("span_start"), F.max("char_end").alias("span_end"), F.avg("prob").alias("p"))
    return spans.where((F.col("p") >= least) & (F.col("span_end") > F.col("span_start"))).select("doc_id", "entity", "span_start", "span_end", (F.floor(F.col("p") * 1000 + 0.5) / 1000).alias("confidence"))


def typed(spans: DataFrame) -> DataFrame:
    """Adds type and severity of a model label; an unknown label is custom and medium."""
    dim = spans.sparkSession.createDataFrame(LABELS, "entity string, type string, severity string")
    return spans.join(F.broadcast(dim), "entity", "left").withColumn("type", F.coalesce("type", F.lit("custom"))).withColumn("severity", F.coalesce("severity", F.lit("medium")))


def argmax(logits: Column) -> tuple[Column, Column]:
    """Place of the largest logit (from 0) and its softmax probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp((x - top).cast("double")))
    return F.array_position(logits, top) - 1, 1 / total


def adjust(spans: DataFrame, probs: str = "probs") -> DataFrame:
    """Classifier probabilities applied to ambiguous spans (0.4 to 0.8); others pass unchanged; below 0.3 they go."""
    best = F.array_max(probs)
    at = F.array_position(probs, best)
    ambiguous = F.col("confidence").between(0.4, 0.8)
    cat_type = F.element_at(F.array(*(F.lit(x[0]) for x in CATEGORIES)), at.cast("int"))
    cat_sev = F.element_at(F.array(*(F.lit(x[2]) for x in CATEGORIES)), at.cast("int"))
    conf = F.when(~ambiguous, F.col("confidence")).when(best > 0.5, F.least(F.lit(0.95), F.col("confidence") + (best - 0.5) * 0.6)).otherwise(F.greatest(F.lit(0.1), F.col("confidence") * 0.5))
    relabel = ambiguous & (best > 0.8) & (F.col("type") != cat_type)
    out = spans.withColumns({"new_confidence": conf, "new_type": F.when(relabel, cat_type).otherwise(F.col("type")), "new_severity": F.when(relabel, cat_sev).otherwise(F.col("severity"))})
    return out.where("new_confidence >= 0.3").withColumns({"confidence": F.col("new_confidence"), "type": F.col("new_type"), "severity": F.col("new_severity")}).drop("new_confidence", "new_type", "new_severity")


def answer_spans(answers: DataFrame) -> DataFrame:
    """Stored model answers (doc_id, text, response) to spans; what is not in the text is left out.

    Fences and what follows the last bracket go; where the rest does not parse, whole items are salvaged.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace("response", "[\\x00-\\x1f]", " "), "```(?:json)?", ""))
    array = F.regexp_extract(bare, r"(\[.*\])", 1)
    parsed = F.from_json(array, "array<struct<type:string,value:string>>", {"mode": "PERMISSIVE"})
    item = r'\{[^{}]*"type"\s*:\s*"([^"]+)"[^{}]*"value"\s*:\s*"([^"]*)"[^{}]*\}'
    salvaged = F.transform(F.regexp_extract_all(bare, F.lit(item), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, item, 1).alias("type"), F.regexp_extract(x, item, 2).alias("value")))
    good = parsed.isNotNull() & (F.size(parsed) > 0) & ~F.exists(parsed, lambda x: x["type"].isNull())
    dim = answers.sparkSession.createDataFrame(ANSWER_TYPES, "kind string, type string")
    items = answers.select("doc_id", "text", F.explode(F.when(good, parsed).otherwise(salvaged)).alias("i")).select("doc_id", "text", F.col("i.type").alias("kind"), F.col("i.value").alias("value")).join(F.broadcast(dim), "kind")
    at = F.instr("text", F.col("value")) - 1
    found = items.withColumn("span_start", at).where((F.col("span_start") >= 0) & (F.length("value") > 0))
    return found.select("doc_id", "span_start", (F.col("span_start") + F.length("value")).alias("span_end"), relabelled(F.col("type"), F.lower("value")).alias("type"), F.lit(0.92).alias("confidence"))


def relabelled(type_: Column, low: Column) -> Column:
    """Vitals, dosages, drugs and record numbers that a model called money or a person are medical."""
    medical = low.rlike(r"^\d{2,3}/\d{2,3}\z") | low.rlike(r"^\d+\.\d+%\z") | low.rlike(r"^\d+mg\z") | low.rlike("metformin|aspirin|insulin|lisinopril|amoxicillin|ibuprofen") | low.rlike(r"^[a-z]{2,3}-?\d{4,}\z")
    number = (type_ == "financial") & low.rlike(r"^[a-z]{0,3}\d{5,}\z")
    return F.when((type_.isin("financial", "person_name") & medical) | number, "medical_record").otherwise(type_)


def score_with(df: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """Batch scoring by a user's model: predict takes a pandas frame of doc_id, text and returns rows of schema."""

    def run(frames):
        for pdf in frames:
            yield predict(pdf)

    return df.select("doc_id", "text").mapInPandas(run, schema)
