"""Record operators: nested values, JSON documents and text templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import base64_text
from loomwork.functions.text import ARM_NAMES


def to_json_record(fields: Mapping[str, Column], pretty: bool = False) -> Column:
    """A JSON object of the fields in their order; null fields are written as null.

    ``pretty`` is Spark's own layout; ``pretty_json`` has a line for each member and item.
    """
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), options)


def json_value(value: Column) -> Column:
    """The JSON text of one column; 'null' for null."""
    boxed = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(boxed, F.lit(6), F.char_length(boxed) - 6)


def pretty_json(value: Column | Mapping | Sequence, indent: int = 2, depth: int = 0) -> Column:
    """JSON text with a line for each member or item, set in by ``indent`` blanks a level, and one blank after each colon.

    Mappings give objects, lists and tuples arrays, columns the values; an empty one is ``{}`` or ``[]``.
    """
    if isinstance(value, Column):
        return json_value(value)
    inner = lambda v: pretty_json(v, indent, depth + 1)
    named = isinstance(value, Mapping)
    items = [F.concat(json_value(F.lit(k)), F.lit(": "), inner(v)) for k, v in value.items()] if named else [inner(v) for v in value]
    opening, closing = "{}" if named else "[]"
    if not items:
        return F.lit(opening + closing)
    pad = "\n" + " " * indent * (depth + 1)
    return F.concat(F.lit(opening + pad), F.concat_ws("," + pad, *items), F.lit("\n" + " " * indent * depth + closing))


def lines_to_json(df: DataFrame, key: Sequence[str], order: str, line: str, name: str = "nodes") -> DataFrame:
    """Per key, a JSON body with the non-null lines in their order. A key's lines must fit in one row."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line))))
    kept = F.filter(F.transform(pairs, lambda p: p[line]), lambda x: x.isNotNull())
    return df.groupBy(*key).agg(F.to_json(F.struct(kept.alias(name))).alias("body"))


def arch_class(name: Column) -> Column:
    """'arm' for the names of arm machines, else (also for null) 'amd'."""
    return F.when(F.coalesce(name.isin(*ARM_NAMES), F.lit(False)), "arm").otherwise("amd")


def download_list(arch: Column, base: Column, agent: Column | None = None, agent_first: bool = True) -> Column:
    """Array of {file_name, file_url}: two entries for the architecture, and an agent entry, first or last, if one is given."""
    root = F.concat(base, F.lit("/"), arch_class(arch), F.lit("/"))
    entry = lambda n: F.struct(F.lit(n).alias("file_name"), F.concat(root, F.lit(n)).alias("file_url"))
    files = F.array(entry("web"), entry("bot"))
    if agent is None:
        return files
    extra = F.struct(F.lit("agent").alias("file_name"), F.concat(root, agent).alias("file_url"))
    both = (F.array(extra), files) if agent_first else (files, F.array(extra))
    return F.when(F.coalesce(agent, F.lit("")) != "", F.concat(*both)).otherwise(files)


def node_record(fields: Mapping[str, Column]) -> Column:
    """A flat, versioned record as JSON, then base64."""
    return base64_text(to_json_record({"v": F.lit("2")} | dict(fields)))


def link_text(scheme: str, user: Column, host: Column, port: Column, name: Column) -> Column:
    """scheme://user@host:port#name; null if any part is null."""
    return F.concat(F.lit(f"{scheme}://"), user, F.lit("@"), host, F.lit(":"), port.cast("string"), F.lit("#"), name)
