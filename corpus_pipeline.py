"""The training-data pipeline: quality, near duplicates, contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All but the last give the columns of documents. In every stage null and empty texts, very long texts and null doc_ids
follow the operator's rules (see its module); extra columns of docs are kept, whatever their names, by all stages but the
last, which keeps doc_id, lang and source; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, decontaminate, near_dup, pii, quality
from framelake.llm.shared import checkpoint_dir, drop, settle

KEEP_FROM = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def aside(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage on ``docs`` with the columns called ``names``, which the operator would replace, under other names."""
    moved = {c: f"_kept_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    done = stage(docs.withColumnsRenamed(moved))
    return done.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts get the base score; repeated rows fare alike."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return aside(docs, {"score"}, lambda d: quality.score_quality(d, model).filter(F.col("score") >= KEEP_FROM))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, and of its repeated rows one.
    Documents without words, and rows with a null doc_id, all stay."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    named = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id")
    kept = settle(named.agg(F.max("n_shingles").alias("_n"), F.count("*").alias("_rows")))
    once = kept.filter("_rows = 1 OR _n = 0").select("doc_id")
    twice = kept.filter("_rows > 1 AND _n > 0").select("doc_id")
    # Rows without a doc_id stay where they are: as a join's key they would all meet in one task.
    single = docs.filter("doc_id IS NULL").unionByName(docs.join(once, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)))
    if not twice.take(1):
        return single
    repeated = docs.join(twice, docs.doc_id == twice.doc_id, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; those without words hold none. Repeated rows fare alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return aside(docs, set(decontaminate.RESULTS), lambda d: decontaminate.decontaminate(d, items).filter("NOT contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; n_chars follows. Null texts stay null, without a length."""
    return aside(docs, {"base", "loose", "base_spans", "added_spans", "_row"}, lambda d: pii.redact(d).withColumn("n_chars", F.length("text").cast("long")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with their count, their digest and that of the bytes decoded from them; null and
    empty texts have none. Repeated rows are encoded alike; of the other columns doc_id, lang and source stay."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests=True, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
#: The classifier is trained, so SQL can't express the rows; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again, and dropped when
    the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop(spark, f"{folder}/{last}")
        last = name
    return docs
