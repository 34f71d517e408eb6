"""Column-set operators: guarded drops, literal labels, one-hot columns aligned to a
saved feature list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_if_all_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop ``cols`` only when every one of them exists (else leave the frame as is)."""
    return df.drop(*cols) if set(cols) <= set(df.columns) else df


def one_hot_columns(df: DataFrame, col: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """``get_dummies`` for a known level list: one 0/1 INT column per level, named
    ``<prefix>_<level>``; a value outside the list is all zeros.  The level list is a
    parameter (e.g. the saved model columns), so no pass over the data collects it."""
    p = prefix or col
    return df.withColumns({f"{p}_{lv}": (F.col(col) == F.lit(lv)).cast("int") for lv in levels})


def align_columns(df: DataFrame, cols: Sequence[str], fill=0) -> DataFrame:
    """Reorder to a saved column list: missing columns become ``fill``, extra ones are
    dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in cols])
