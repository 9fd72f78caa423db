"""The registered queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann as op6
from . import attribution as op3
from . import bpe as op5
from . import decontaminate as op7
from . import lloyd as op11
from . import near_dup as op10
from . import packing as op12
from . import phrases as op13
from . import pii as op4
from . import quality as op9
from . import revisits as op2
from . import substring_dedup as op8
from . import url_filter as op1
from .sql import ORACLE

URL_RULES = [  # fixed values: the contract's rules
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return op1.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolves the revisits in the capture stream of all pages."""
    records = op2.records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return op2.resolve_revisits(records).select(
        "record_id",
        "page_id",
        "canonical",
        "ts",
        "status",
        "refers_to",
        *(F.col("merged")[h].alias(h.replace("-", "_")) for h in ("etag", "last-modified", "content-length", "cache-control", "date")),
    )


def op3_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, border tokens by their first character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    counted = op3.attribute_tokens(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds personal data in every document."""
    return op4.summary(op4.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return op5.encode(docs, path, public_tokenizers.PATTERN, ids=False, digests=True, keep=["doc_id"])


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    return op6.nearest(table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks the benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op7.summary(op7.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds."""
    kept = op8.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = op9.score_quality(docs, op9.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", op9.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds the near-duplicate component of every document."""
    return op10.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters every embedding by three rounds of exact Lloyd."""
    return op11.lloyd(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the ids of every document into sequences of 4096."""
    return op12.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of every language."""
    return op13.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and "_" in k}


def oracle_sql() -> dict[str, str]:
    return ORACLE
