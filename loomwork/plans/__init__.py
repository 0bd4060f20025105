"""Named queries over the Parquet tables, each with the SQL that gives the same rows."""

from loomwork.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
