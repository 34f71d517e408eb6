"""Chat-message array expressions (``array<struct<role, content, ...>>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["has_role", "prepend_if_missing", "append_message", "drop_role", "message"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def message(role, content) -> Column:
    """A message struct; plain strings are literals, Columns are used as they are."""
    r = F.lit(role) if isinstance(role, str) else role
    c = F.lit(content) if isinstance(content, str) else content
    return F.struct(r.alias("role"), c.alias("content"))


def has_role(messages, role: str = "system") -> Column:
    return F.exists(_c(messages), lambda m: m["role"] == F.lit(role))


def prepend_if_missing(messages, msg: Column, role: str = "system") -> Column:
    msgs = _c(messages)
    return F.when(has_role(msgs, role), msgs).otherwise(F.concat(F.array(msg), msgs))


def append_message(messages, msg: Column) -> Column:
    return F.concat(_c(messages), F.array(msg))


def drop_role(messages, role: str = "system") -> Column:
    return F.filter(_c(messages), lambda m: m["role"] != F.lit(role))
