"""Queries of the training-data operators and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, mixing, neardup, packing, quality, substrings, suffixes, tokens, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _mix_sql(repetition: float = 1.25, block_docs: int = 256, seed: int = 42) -> str:
    unit = lambda h: f"(('0x' || substr({h}, 1, 13))::BIGINT / {16**13}.0)"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens, md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS h FROM documents),
    s AS (SELECT source, count(*) AS n_docs, sum(n_tokens) AS tokens FROM d GROUP BY 1),
    g AS (SELECT min(tokens)::DOUBLE / max(tokens) AS ratio, sum(tokens)::DOUBLE AS total, count(*) AS k FROM s WHERE tokens > 0),
    b AS (SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi, ratio, k FROM g UNION ALL
          SELECT i + 1, CASE WHEN pow(ratio, (lo + hi) / 2 - 1) >= {repetition} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(ratio, (lo + hi) / 2 - 1) >= {repetition} THEN hi ELSE (lo + hi) / 2 END, ratio, k FROM b WHERE i < 50),
    e AS (SELECT round(CASE WHEN k < 2 OR 1 / ratio <= {repetition} THEN 0 ELSE hi END, 9) AS x FROM b WHERE i = 50),
    z AS (SELECT sum(pow(tokens / total, x)) AS z, max(x) AS x, max(total) AS total FROM s, g, e WHERE tokens > 0),
    m AS (SELECT max(tokens * z / pow(tokens / total, x)) AS spend FROM s, z WHERE tokens > 0),
    p AS (SELECT source, CASE WHEN tokens > 0 THEN round(pow(tokens / total, x) / z, 9) ELSE 0 END AS source_weight, CASE WHEN tokens > 0 THEN round(spend * pow(tokens / total, x) / z / tokens, 6) ELSE 1 END AS epochs, greatest(ceil(n_docs / {block_docs}.0), 1) AS blocks FROM s, z, m),
    q AS (SELECT doc_id, source, n_tokens, source_weight, epochs, CAST(floor({unit('h')} * blocks) AS BIGINT) AS block, h, unnest(range(0, greatest(ceil(epochs), 1)::BIGINT)) AS epoch FROM d JOIN p USING (source)),
    r AS (SELECT *, md5(h || '/' || epoch) AS eh FROM q),
    w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch, block ORDER BY eh, n_tokens ROWS UNBOUNDED PRECEDING) AS cum, sum(n_tokens) OVER (PARTITION BY source, epoch, block) AS every, row_number() OVER (PARTITION BY source, epoch, block ORDER BY eh, n_tokens) AS block_position FROM r)
    SELECT doc_id, source, n_tokens, source_weight, epoch, block, block_position FROM w WHERE epochs - epoch >= 1 OR cum - n_tokens / 2.0 <= (epochs - epoch) * every"""


@query("op1_mix_sources", _mix_sql())
def _(spark, d):
    docs = documents(spark, d).select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), mixing.word_count(F.col("text")).alias("_n"))
    return mixing.mix(docs, repetition=1.25, tokens=F.col("_n")).drop("_n")


@query("op2_token_counts")
def _(spark, d):
    return tokens.token_counts(documents(spark, d), vocabulary())


@query("op4_pack")
def _(spark, d):
    return packing.pack(documents(spark, d), vocabulary())


_CHATS = """c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))"""


def _grown(c: str) -> str:
    return f"length({c}) + length(regexp_replace({c}, '[^\\\\<\\[]', '', 'g'))"




@query("op5_format_chats", f"""WITH {_CHATS} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(13 + {_grown('role')} + length(regexp_replace(role, '[^|]', '', 'g')) + {_grown('text')}) AS BIGINT) AS formatted_chars,
    coalesce(regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user assistant( user assistant)*'), false) AS valid FROM c GROUP BY conv_id""")
def _(spark, d):
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(turns))


@query("op6_quality_rules")
def _(spark, d):
    return quality.quality(documents(spark, d)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@query("op7_fingerprints")
def _(spark, d):
    return winnow.compare_with_edits(documents(spark, d))


@query("op8_suffix_dedup")
def _(spark, d):
    return suffixes.digest(documents(spark, d))


@query("op10_substring_dedup")
def _(spark, d):
    return substrings.digest(documents(spark, d))


@query("op3_near_duplicates")
def _(spark, d):
    return neardup.near_duplicates(documents(spark, d))


@query("op9_license_scan")
def _(spark, d):
    docs = documents(spark, d)
    out = licenses.scan(docs.select(licenses.document_path(docs).alias("path"), "text"))
    return out.withColumn("doc_id", F.expr("try_cast(split_part(path, '/', -1) AS long)"))
