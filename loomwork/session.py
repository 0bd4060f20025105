"""Session settings shared by the bench, the tests and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "loomwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; keyword settings win (``_`` stands for ``.``).

    A cluster sets its own master and shuffle partitions; nothing here fixes them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
