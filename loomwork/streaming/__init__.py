"""The line filter on a stream of text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.lines import LINK_SCHEMES, link_filter


def stream_links(spark: SparkSession, folder: str, schemes: Sequence[str] = LINK_SCHEMES) -> DataFrame:
    """Lines with a link from every text file that appears in the folder; stateless, so append mode suits."""
    lines = spark.readStream.text(folder)
    return lines.where(link_filter(F.col("value"), schemes)).select(F.col("value").alias("line"))
