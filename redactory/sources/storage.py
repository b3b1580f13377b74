"""Shared scratch folders and file sources and sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings scanned here, scanned by the wide scanner, and recognised without extraction.
LOCAL_EXTENSIONS = ["txt", "md", "log", "env", "ini", "cfg", "conf", "js", "ts", "py", "java", "sql", "rb", "go", "rs", "c", "cpp", "h", "cs", "php", "swift", "kt", "json", "yaml", "yml", "xml", "toml", "csv", "tsv"]
WIDE_EXTENSIONS = [
    "txt", "md", "log", "rtf", "json", "xml", "yaml", "yml", "env", "ini", "toml", "conf", "cfg", "config", "plist", "dockerfile", "gradle", "pdf", "docx", "pptx", "odt", "xlsx", "xls", "csv", "py", "js", "ts", "jsx", "tsx", "java", "sql", "go", "rb", "php",
    "cs", "cpp", "c", "h", "hpp", "sh", "bash", "zsh", "ps1", "swift", "kt", "kts", "rs", "scala", "r", "m", "mm", "pl", "pm", "lua", "dart", "coffee", "less", "scss", "sass", "html", "htm", "tex", "latex", "ipynb",
]
STUB_EXTENSIONS = ["pdf", "docx", "xlsx"]
LOCAL_BYTES, WIDE_BYTES = 512 * 1024, 10 * 1024 * 1024
# Sites by host, in order; and labels by what a URL contains, in order.
SITES = [
    ("chatgpt", ["chatgpt.com", "chat.openai.com"]), ("claude", ["claude.ai"]), ("gemini", ["gemini.google.com", "bard.google.com"]), ("grok", ["grok.com", "x.com", "twitter.com"]), ("deepseek", ["chat.deepseek.com", "deepseek.com"]),
    ("github-copilot", ["github.com"]), ("perplexity", ["perplexity.ai", "www.perplexity.ai"]), ("copilot", ["copilot.microsoft.com"]), ("mistral", ["chat.mistral.ai"]), ("cohere", ["coral.cohere.com", "dashboard.cohere.com"]), ("notion", ["notion.so", "www.notion.so"]),
]
URL_LABELS = [("chatgpt", ["chat.openai.com", "chatgpt.com"]), ("claude", ["claude.ai"]), ("gemini", ["gemini.google.com", "bard.google.com"]), ("grok", ["grok.com", "x.com", "twitter.com"]), ("github-copilot", ["github.com"]), ("perplexity", ["perplexity.ai"]), ("deepseek", ["deepseek.com"])]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or an own one in local runs."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(given or tempfile.mkdtemp(prefix='spark-', dir='/tmp')).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df into a shared scratch folder and read it back, so that several uses compute it once."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extension(path: Column) -> Column:
    """Lower-case ending of a file name; empty without a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def decode_text(content: Column) -> Column:
    """Bytes as text: bad sequences replaced, a leading byte order mark dropped."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 2147483647)).otherwise(text)


#: Folders that written files are dealt over by their key, so that listings run in parallel and none grows too long.
FOLDERS = 256


def _opened(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a path and the path inside it, or None where Arrow knows no such store."""
    try:
        return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


#: Bytes of files that a task reads, and that it hands over at once; a file counts for so many more.
READ_BYTES, HANDED_BYTES, FILE_BYTES = 32 << 20, 4 << 20, 4096


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(min(n, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below a folder that Arrow opens, as Spark's file source finds them: names that begin with a dot, or with _ and hold no =, are left out.

    Tasks list folder by folder, a job for each level of them, so no list of files goes through the driver.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(path)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                inside = store.get_file_info(fs.FileSelector(folder))
                seen = [i for i in inside if not i.base_name.startswith(".") and not (i.base_name.startswith("_") and "=" not in i.base_name) and not i.base_name.endswith("._COPYING_")]
                yield pa.RecordBatch.from_arrays([pa.array([i.path for i in seen], pa.string()), pa.array([i.size if i.is_file else None for i in seen], pa.int64())], ["path", "length"])

    folders, n, levels = spark.createDataFrame([(_opened(path)[1],)], "path string"), 1, []
    while n:
        levels.append(cut(_dealt(folders, n).mapInArrow(entries, "path string, length long"), "files"))
        folders = levels[-1].where("length IS NULL").select("path")
        n = folders.count()
    return reduce(DataFrame.unionAll, levels).where("length IS NOT NULL")


def scan_files(spark: SparkSession, path: str, most: int = LOCAL_BYTES) -> DataFrame:
    """path, length, text of the supported files below path; larger ones are never opened.

    Tasks list and read the files of stores that Arrow opens. Spark's file source, which keeps
    every file's status in the driver, reads the others, and patterns of paths.
    """
    own = None if re.search(r"[*?{\[]", path) else _opened(path)
    supported = (F.col("length") <= most) & extension(F.col("path")).isin(LOCAL_EXTENSIONS)
    if own is None or own[0].get_file_info(own[1]).type != fs.FileType.Directory:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.where(supported).select("path", "length", decode_text(F.col("content")).alias("text"))
    root, shown = own[1], f"file:{own[1]}" if isinstance(own[0], fs.LocalFileSystem) else path.rstrip("/")
    files = _listed(spark, path).where(supported & (F.col("length") > 0))  # Spark's source leaves out empty files too
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("length") + FILE_BYTES), F.lit(0))).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(path)

        def handed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "length", "content"])

        rows, held = [], 0
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    rows.append((shown + name[len(root) :], length, f.read()))
                held += length + FILE_BYTES
                if held >= HANDED_BYTES:
                    yield handed(rows)
                    rows, held = [], 0
        if rows:
            yield handed(rows)

    parts = max(-(-size // READ_BYTES), min(n, spark.sparkContext.defaultParallelism), 1)
    found = files.repartition(parts).mapInArrow(read, "path string, length long, content binary")
    return found.select("path", "length", decode_text(F.col("content")).alias("text"))


def write_files(texts: DataFrame, key: str, path: str | None = None) -> str:
    """Write each row's text as a file of its own below path (else a shared scratch folder), named after key.

    key must tell rows apart and not be null. A line end closes each file; a null text is an empty line.
    Tasks write the files themselves, into folders by the key's hash: a committer that moves file by file,
    and on local disks a process for each file's mode, cost far more than the files. A file gets its name
    once it is whole, and a repeated task writes the same names. Stores that only Spark opens get Spark's writer.
    """
    path = path or scratch(texts.sparkSession, "files")
    rows = texts.select(F.col(key).cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    if _opened(path) is None:
        rows.select(F.col("name").alias(key), F.col("content").cast("string").alias("text")).write.partitionBy(key).text(path)
        texts.sparkSession.catalog.refreshByPath(path)
        return path
    store, root = _opened(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    for i in range(FOLDERS):
        store.create_dir(f"{root}/{i:02x}")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                folder, file = f"{root}/{zlib.crc32(name.encode()) % FOLDERS:02x}", f"{key}={quote(name, safe='')}.txt"
                whole = f"{folder}/_{uuid.uuid4().hex}"  # names with this first sign are no input for Spark
                with store.open_output_stream(whole) as out:
                    out.write(content.as_buffer())
                    out.write(b"\n")
                store.move(whole, f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows.mapInArrow(written, "files long").agg(F.sum("files")).collect()
    texts.sparkSession.catalog.refreshByPath(path)
    return path


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Reads inside take thousands of small files a task; by Spark's own settings a file counts as 4 MB, so a task takes 32 or fewer."""
    own = {"spark.sql.files.openCostInBytes": "4096", "spark.sql.files.maxPartitionBytes": str(32 << 20)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def route(path: Column, length: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(STUB_EXTENSIONS), "stub").when(~ext.isin(LOCAL_EXTENSIONS), "unsupported").when(length > LOCAL_BYTES, "too_large").otherwise("local")


def url_label(url: Column) -> Column:
    """First label one of whose parts the URL contains."""
    out = F.lit("unknown")
    for label, parts in reversed(URL_LABELS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(url, F.lit(part))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def host_site(hosts: DataFrame) -> DataFrame:
    """Adds site: the first registered one whose host, or a parent of whose host, it is."""
    rows = [(i, site, h) for i, (site, names) in enumerate(SITES) for h in names]
    known = hosts.sparkSession.createDataFrame(rows, "seq int, site string, pattern string")
    fit = (F.col("host") == F.col("pattern")) | F.endswith("host", F.concat(F.lit("."), "pattern"))
    return hosts.join(F.broadcast(known), fit, "left").groupBy(*hosts.columns).agg(F.min_by("site", "seq").alias("site"))


def payload_text(body: Column) -> Column:
    """Prompt text of a chat request body: the first string field, else all message contents and parts."""
    fields = [F.get_json_object(body, f"$.{f}") for f in ("prompt", "content", "text", "message")]
    messages = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string,content:string>>")
    parts = F.transform(messages, lambda m: F.when(m["content"].startswith("["), F.array_join(F.transform(F.from_json(m["content"], "array<struct<type:string,text:string>>"), lambda p: p["text"]), "\n")).otherwise(m["content"]))
    return F.coalesce(*fields, F.nullif(F.array_join(parts, "\n"), F.lit("")))


def json_strings(df: DataFrame, body: str = "body", depth: int = 5) -> DataFrame:
    """id, path, text: every string of a JSON tree down to depth, by one unnesting step a level."""
    level = df.select("id", F.lit("").alias("path"), F.expr(f"try_parse_json({body})").alias("v")).where("v IS NOT NULL")
    level.createOrReplaceTempView("_json_level")
    out = None
    for i in range(depth + 1):
        kind = F.schema_of_variant("v")
        strings = level.where(kind == "STRING").select("id", "path", F.expr("variant_get(v, '$', 'string')").alias("text"))
        out = strings if out is None else out.unionByName(strings)
        if i < depth:
            view = f"_json_level_{i}"
            level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).createOrReplaceTempView(view)
            level = df.sparkSession.sql(f"SELECT id, concat(path, '/', lpad(cast(pos AS STRING), 4, '0')) AS path, value AS v FROM {view}, LATERAL variant_explode(v)")
    return out


def append_audit(events: DataFrame, path: str) -> None:
    """Append audit rows, one folder a day; raw values must be gone by now, so a column of them is refused."""
    if {"value", "text", "original"} & set(events.columns):
        raise ValueError("audit rows must not carry raw values")
    events.write.mode("append").partitionBy("event_date").parquet(path)


def audited(events: DataFrame) -> DataFrame:
    """Append events of today to a new audit folder and read back what the folder then holds, without the day."""
    rows = events.withColumn("event_date", F.current_date())
    path = scratch(events.sparkSession, "audit")
    append_audit(rows, path)
    return events.sparkSession.read.schema(rows.schema).parquet(path).drop("event_date")


#: Setting with the key, 32 hexadecimal digits, that seals the details of audit events.
SEAL_SETTING = "redactory.audit.sealKey"


def seal_key(spark: SparkSession) -> bytes:
    """The key of the setting; where it is unset a fresh one, with which nobody can open what is sealed."""
    given = spark.conf.get(SEAL_SETTING, None)
    return bytes.fromhex(given) if given else os.urandom(16)


def sealed(details: Column, key: bytes) -> Column:
    """Details as nonce, cipher text and tag (AES-GCM); aes_decrypt opens them with the same key."""
    return F.aes_encrypt(details.cast("binary"), F.lit(key), F.lit("GCM"))
