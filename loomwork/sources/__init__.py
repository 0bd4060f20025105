"""Readers and writers; thin names over Spark's own sources so that options stay in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line, column ``value``; large files are split over tasks."""
    return spark.read.text(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, column ``value``; each file must fit in a task's memory."""
    return spark.read.text(path, wholetext=True)


def write_text(df: DataFrame, path: str) -> None:
    """Overwrite a folder of text files with the single string column of ``df``."""
    df.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite a folder of JSON lines; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in local mode one may be made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loomwork-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"
