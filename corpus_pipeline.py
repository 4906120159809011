"""A corpus pipeline over ``documents``: quality classifier, quality rules, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.llm import bpe_replay, common, jaccard_join, mixing, quality_classifier, quality_rules
from lociq.scratch import stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, does not reject.

    Null and empty texts are scored as empty ones, copies alike, very long texts whole; a doc_id may be null or repeated. Columns
    of any name pass through; no rows give none. Statistics are taken once to train and once more beside each text to score it: to bring the
    stored ones back to their texts would take a shuffle of all texts.
    """
    measured = stored(quality_classifier.features(docs), "quality-features")
    model = quality_classifier.train(measured, common.labels(spark, sf_dir))
    return docs.filter(quality_classifier.score_of(F.col("text"), model) >= quality_classifier.THRESHOLD)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail.

    Null and empty texts are rejected, as they have too few words; every row is judged by itself, copies alike, and long texts whole. Columns of
    any name pass through; no rows give none.
    """
    kept = quality_rules.scored(docs.select(F.struct(*docs.columns).alias("row"), "text")).filter("kept")
    return kept.select(*[F.col("cleaned").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that copies and near copies connect: of the text of least doc_id, the row of least
    doc_id. Rows without doc_id stay, as they can't be told apart, and so do different texts that share a doc_id. Null texts are
    copies of the empty text; repeated rows are copies; no rows give none; columns of any name pass through."""
    classes = jaccard_join.joined(docs, with_md5=True)
    first = classes.filter(F.col("is_first") & (F.col("text_id") == F.col("doc_id"))).select("doc_id", "text_md5").distinct()
    chosen = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_md5"), F.struct(*docs.columns).alias("row")).join(first, ["doc_id", "text_md5"], "left_semi")
    # Rows may share a doc_id and the text; the join has dealt them by both already.
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_md5").orderBy("row.text"))
    return chosen.withColumn("copy", copy).filter("copy = 1").select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source, a null text has no words; repeated rows are documents of their own. Which documents are taken
    follows from source, size, doc_id and text, so reruns agree. Columns of any name pass through; no rows give none.
    """
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text that they decode to.

    One row for each row, copies included; a null text is empty and has no ids. Other columns are left out; no rows give none.
    Words of 6 MB of text are merged at a time, half of what operator 4 takes: executors still hold what the stages before left them.
    """
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe_replay.encoded(docs, f.read(), public_tokenizers.PATTERN, chunk_bytes=6 << 20)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", clean),
    ("near duplicates", deduplicate),
    ("mixing", mix),
    ("byte-level BPE", tokenise),
]

#: Neither the classifier's scores nor the merges can be said in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
