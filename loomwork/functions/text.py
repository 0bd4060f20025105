"""Scalar column functions. All are JVM expressions; none runs Python on the executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a token, and the mark of a credentials document.
TOKEN_SHAPE = "^[A-Z0-9a-z=]{120,250}$"
SECRET_MARK = "TunnelSecret"
# Ports served over TLS.
TLS_PORTS = ("443", "8443", "2096", "2087", "2083", "2053")
# Machine names that count as arm.
ARM_NAMES = ("arm", "arm64", "aarch64")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null (not '') where nothing matches."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(text.rlike(pattern), found)


def last_token(text: Column, sep: str = ":") -> Column:
    """What follows the last separator; '' without a separator, null for null."""
    parts = F.split(text, f"\\Q{sep}\\E")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        F.instr(text, sep) > 0, F.element_at(parts, -1)
    ).otherwise("")


def nth_field(text: Column, sep: str, n: int) -> Column:
    """The field with 0-based number ``n``; null when there are fewer."""
    return F.get(F.split(text, f"\\Q{sep}\\E"), n)


def member_flag(value: Column, members: Iterable[str], yes: str = "tls", no: str = "") -> Column:
    """``yes`` for a member of the set, else (also for null) ``no``."""
    return F.when(F.coalesce(value.isin(*members), F.lit(False)), yes).otherwise(no)


def route_by_shape(text: Column) -> Column:
    """'token' for 120 to 250 letters, digits or '=', 'secret' if it names a secret, else 'default'."""
    return (
        F.when(text.rlike(TOKEN_SHAPE), "token")
        .when(F.instr(text, SECRET_MARK) > 0, "secret")
        .otherwise("default")
    )


def default_value(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def first_non_empty(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def display_name(name: Column, suffix: Column) -> Column:
    """'name-suffix', or the trimmed suffix alone where the name is null or empty."""
    tail = F.trim(suffix)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit("-"), tail)).otherwise(tail)


def base64_text(text: Column) -> Column:
    """Base64 of the UTF-8 bytes, without the line breaks that Spark inserts."""
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def decode_base64(text: Column) -> Column:
    """UTF-8 text of standard or URL-safe base64; null for what cannot be decoded."""
    return F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64")).cast("string")
