"""From raw documents to token ids: toxicity, line dedup, near duplicates, mixing, encoding.

Each stage takes what the one before kept, and its decisions take effect. All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import toxicity
from loomwork.llm.common import Scratch, small_batches
from loomwork.llm.linededup import dedup_lines
from loomwork.llm.lshforest import one_of_each
from loomwork.llm.mixing import mixed_documents
from loomwork.llm.pieces import encode_documents
from loomwork.llm.queries import PIECE_MODEL

#: Share of all tokens that the mixture holds, and how often a document may be in it.
SHARE, EPOCHS = (8, 10), 1
#: Parts whose ids an encoding task remembers, twice over; the earlier stages leave workers less memory than encoding alone has.
REMEMBER = 40_000
#: Bytes of rows that an encoding worker gets at a time; the JVM holds a batch several times over outside its heap.
BATCH_BYTES = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; a text without words scores 0 and stays."""
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("__score", toxicity.score_column(model, F.col("text")))
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; one that has lost all its words goes."""
    left = dedup_lines(docs, counts=("__lines", "__deleted"))
    left = left.where((F.col("__deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("__deleted") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budget at target weights, each once."""
    return mixed_documents(docs, share=SHARE, max_epochs=EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and round_trip of every document."""
    coded = encode_documents(small_batches(docs, BATCH_BYTES), PIECE_MODEL, keep=["doc_id", "source", "lang"], remember=REMEMBER)
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_documents),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: SQL can't express the trained stage nor the merge procedure; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; a stage's own tables go once it is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark, before = Scratch.mark(), docs
        docs = scratch.put(stage(spark, docs, sf_dir))
        Scratch.free_since(mark)
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
