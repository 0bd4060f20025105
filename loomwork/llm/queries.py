"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import mixing, oracles
from loomwork.llm.linededup import dedup_lines
from loomwork.llm.lshforest import near_duplicates
from loomwork.llm.pieces import encode_documents
from loomwork.llm.privacy import find_personal
from loomwork.llm.quality import quality_rules
from loomwork.llm.sharding import shard_documents
from loomwork.llm.simhash import edited_fingerprints
from loomwork.llm.toxicity import toxicity
from loomwork.llm.urls import filter_urls, mirror_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that disclose it, in every document."""
    return find_personal(table(spark, sf_dir, "documents"), everywhere=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them are deleted, and a digest of what is left."""
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return left.select("doc_id", "n_lines", "n_deleted", F.char_length("text").cast("long").alias("n_chars"), digest.alias("text_sha256"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; pages with the same article are redirects to the least of their urls."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, redirects=mirror_links(pages))


#: A public BPE vocabulary with byte fallback.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and whether they decode to the text."""
    coded = encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each leaf of the tree, by epoch, that fill 70 % of all tokens at target weights."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text_md5")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards; equal texts stay together as far as counts allow."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_privacy": op3_privacy,
    "op4_simhash": op4_simhash,
    "op5_linededup": op5_linededup,
    "op6_urls": op6_urls,
    "op7_pieces": op7_pieces,
    "op8_jaccard": op8_jaccard,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
}
ORACLE: dict[str, str] = {"op6_urls": oracles.URLS, "op8_jaccard": oracles.JACCARD, "op9_mixing": mixing.oracle()}
