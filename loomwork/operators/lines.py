"""Line operators: a text column becomes rows, filtered or reduced by pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import decode_base64, first_group

# Link schemes that a subscription may hold.
LINK_SCHEMES = ("vless", "vmess", "trojan", "hysteria2", "tuic")


def explode_lines(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row a line with its 0-based ``line_no``; empty lines stay, null texts give no row."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def link_filter(line: Column, schemes: Sequence[str] = LINK_SCHEMES) -> Column:
    """True where a scheme of the list, followed by '://', stands anywhere in the line."""
    return line.rlike(f"({'|'.join(schemes)})://")


def keep_links(df: DataFrame, encoded: str, keep: Sequence[str] = (), schemes: Sequence[str] = LINK_SCHEMES) -> DataFrame:
    """Decode a base64 column, split it into lines and keep those with a link."""
    decoded = df.select(*keep, decode_base64(F.col(encoded)).alias("__decoded"))
    return explode_lines(decoded, "__decoded", keep).where(link_filter(F.col("line"), schemes))


def first_match_per_row(df: DataFrame, text: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per row, the captured group of the first line that matches; rows without a match are left out.

    Works inside the row (no explode, no shuffle): lines keep their order in the array.
    """
    hits = F.filter(
        F.transform(F.split(F.col(text), "\n"), lambda x: first_group(x, pattern)), lambda x: x.isNotNull()
    )
    return df.select(*keep, F.get(hits, 0).alias("match")).where(F.col("match").isNotNull())
