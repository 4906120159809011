"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import bpe_replay, chat_format, common, jaccard_join, license_scan, lm_scoring, mixing, phrase_mining, quality_classifier, quality_rules, spelling, token_output, topk_search, toxicity
from lociq.scratch import stored


def _vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.round_trip(common.documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(common.documents(spark, sf_dir).select("doc_id", "text")).select(*quality_rules.COLUMNS)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    sized = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5("text").alias("tie")), "mix-sizes")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", taken, F.col("copies").cast("long").alias("copies"))


_OP3_SQL = f"""
WITH sized AS (SELECT doc_id, source, md5(text) AS tie, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
{mixing.MIX_SQL}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM mixed
"""


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_replay.encoded(common.documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(common.documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(common.documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(common.documents(spark, sf_dir))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, F.col("vec_id") % 100 == 0)


_OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mined(common.documents(spark, sf_dir))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"  # a conversation that holds control strings
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat_format.digests(stored(chat_format.formatted(rows), "formatted"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(common.documents(spark, sf_dir))


_OP12_SQL = chat_format.oracle_sql("""SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'""")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_bpe_replay": op4_bpe_replay,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_topk_search": op9_topk_search,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_chat_format": op12_chat_format,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_mixing": _OP3_SQL,
    "op8_license_scan": license_scan.oracle_sql(),
    "op9_topk_search": _OP9_SQL,
    "op11_phrase_mining": phrase_mining.ORACLE,
    "op12_chat_format": _OP12_SQL,
}
