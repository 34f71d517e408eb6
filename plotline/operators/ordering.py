"""Positions in a global order without a single-partition window.

``offsets`` deals the rows to ranges of the ordering columns, counts each range, and gives
every row the number of rows before it: one range shuffle, a row number inside each range,
and one number a range through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.operators.joins import spread_join
from plotline.session import ensure_checkpoint_dir


def offsets(table: DataFrame, columns: str | Sequence[str], out: str = "_before") -> DataFrame:
    """``table`` with ``out``: the number of rows before each one in ascending order of
    ``columns`` (nulls first; rows equal in all of them in any order).  The dealt rows are
    checkpointed, so ranges and sums stay those of one run whatever is recomputed."""
    ensure_checkpoint_dir(table.sparkSession)
    columns = [columns] if isinstance(columns, str) else list(columns)
    dealt = (table.repartitionByRange(*[F.col(c).asc() for c in columns])
             .withColumn("_range", F.spark_partition_id()).checkpoint(eager=True))
    totals = sorted(tuple(r) for r in dealt.groupBy("_range").agg(F.count(F.lit(1))).collect())
    starts = table.sparkSession.createDataFrame(
        [(r, b) for (r, _), b in zip(totals, [0, *accumulate(n for _, n in totals)])], "_range int, _start long")
    w = Window.partitionBy("_range").orderBy(*columns)
    return (dealt.withColumn(out, F.row_number().over(w) - 1)
            .join(F.broadcast(starts), "_range")          # one row a range
            .withColumn(out, (F.col("_start") + F.col(out)).cast("bigint"))
            .drop("_range", "_start"))


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(``column``, ``code``): each distinct value that is not null, numbered from 0 in
    ascending order; neither values nor codes pass through the driver."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return offsets(values, column, out="code")


def label_encode(df: DataFrame, codes: dict[str, DataFrame], suffix: str = "_code",
                 counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with the code of each column of ``codes`` (column -> its ``dense_codes``).
    A value without a code, null included, raises when the row is read.  ``counts``: about how
    many rows (``_rows``) each value has, where the caller knows; else they are counted."""
    out = df
    for c, table in codes.items():
        name = f"{c}{suffix}"
        # a value has one code, so its rows are as many before the joins as after them
        rows = counts[c] if counts else df.groupBy(c).agg(F.count(F.lit(1)).alias("_rows"))
        out = spread_join(out, table.withColumnRenamed("code", name), [c], "left", counts=rows)
        message = F.concat(F.lit(f"{c} has no code for the label "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
        out = out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(message).cast("long")).otherwise(F.col(name)))
    return out.select(*df.columns, *[f"{c}{suffix}" for c in codes])


def frequent_levels(df: DataFrame, column: str, width: int) -> DataFrame:
    """(``column``, ``code``) of the ``width`` most frequent values (ties by value), from 1
    in ascending order; at most ``width`` rows."""
    top = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), column).limit(width))
    return offsets(top.select(column), column).select(column, (F.col("_before") + 1).alias("code"))


def one_hot_indices(df: DataFrame, key: list[str], levels: dict[str, DataFrame], width: int) -> DataFrame:
    """The non-zero entries of a sparse one-hot design as (``key``, ``index``) pairs: the
    k-th column's levels take the indices after ``k * width``.  A null, a rare and an unseen
    level have none, so such a row is all zeros."""
    out = df.select(*key, *levels)
    for k, (c, table) in enumerate(levels.items()):
        coded = table.select(F.col(c).alias(f"_v{k}"), (F.col("code") - 1 + k * width).alias(f"_i{k}"))
        out = out.join(F.broadcast(coded), F.col(c) == F.col(f"_v{k}"), "left").drop(f"_v{k}")   # width rows at most
    return out.select(*key, F.explode(F.filter(F.array(*[F.col(f"_i{k}") for k in range(len(levels))]),
                                               lambda i: i.isNotNull())).alias("index"))
