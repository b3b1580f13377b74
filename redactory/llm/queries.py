"""The registered queries of the training-data operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redactory.llm import common


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.bpe import encode_documents

    return encode_documents(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.dedup import exact_groups

    return exact_groups(common.table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.quality import score_quality

    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.packing import pack_documents

    return pack_documents(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.toxicity import score_toxicity

    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.media import decode_media, encode_media

    return decode_media(encode_media(common.table(spark, sf_dir, "documents"))).drop("clips")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.langid import identify_language

    return identify_language(common.table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.neardup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.tokenfile import token_files

    return token_files(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.sharding import byte_shards

    return byte_shards(common.table(spark, sf_dir, "documents"), shards=24)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.resample import resample

    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), width=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.hmm import lm_scores

    return lm_scores(common.table(spark, sf_dir, "documents"), folds=7, held=2)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from redactory.llm.align import align_documents

    return align_documents(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe_codec, op2_exact_dedup, op3_quality, op4_packing, op5_toxicity, op6_media, op7_language, op8_near_dedup, op9_token_files, op10_sharding, op11_resampling, op12_lm_scoring, op13_token_alignment)
    return {f.__name__: _shipped(f) for f in own}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows by DuckDB, which has no CRC: it is worked out byte by byte, once for each distinct word.
RESAMPLING_SQL = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), b AS (SELECT {_WORDS} AS words FROM benchmark),
         tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
         own AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY 1), goal AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY 1),
         v AS (SELECT word, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)),
                 lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295)) % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM goal), tab),
         s AS (SELECT bucket, sum(n)::BIGINT AS s FROM own JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM goal JOIN v USING (word) GROUP BY 1),
         g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM goal) + 10000)::DOUBLE))) AS BIGINT) AS gain
               FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
         w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY 1, 2) JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
         x AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w ON d.doc_id = w.doc_id),
         r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE n_features >= 20)
    SELECT x.doc_id, n_features, weight, score, CASE WHEN place <= (10 * (SELECT count(*) FROM r)) // 100 THEN place END AS rank FROM x LEFT JOIN r ON x.doc_id = r.doc_id
"""
#: Running bytes in doc_id order cut at equal shares; the CRC is worked out byte by byte, as above.
SHARDING_SQL = """
    WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
         d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
               FROM documents, tab),
         m AS (SELECT *, sum(size) OVER (ORDER BY doc_id)::BIGINT - size // 2 - 1 AS middle, sum(size) OVER ()::BIGINT AS whole FROM d),
         s AS (SELECT *, least(23, middle * 24 // whole)::INTEGER AS shard FROM m)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
                 g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
            FROM d JOIN g ON d.text = g.text
        """,
        "op10_sharding": SHARDING_SQL,
        "op11_resampling": RESAMPLING_SQL,
    }
