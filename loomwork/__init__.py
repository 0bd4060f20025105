"""loomwork: text and record processing on Spark's built-in DataFrame and SQL functions."""

from loomwork.session import get_session

__all__ = ["get_session"]
