"""Joining a per-group table (one row per key) back onto fact rows, skew-safe.

A plain equi-join on the group key shuffles every fact row of a key into one
task; with one key holding a third of the rows that task is the whole job.  When
the group table is known to be small (its key comes from a fixed dimension, e.g.
5 regions or 25 nations) it is broadcast and the fact side is not shuffled at all.
Otherwise heavy keys are found from their counts: at most ``HEAVY_KEYS`` keys can hold
more than a ``1 / HEAVY_KEYS`` part of the rows, so their list has a fixed bound and is
broadcast.  A heavy key's fact rows are dealt to a number of salts in proportion to its
count, and its group rows are copied once a salt; all other keys join plainly and are
copied nowhere.  The salt is a hash of the row's own values, so a retried task (lost
executor) sends every row to the same salt again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are spread; also the most there can be.
HEAVY_KEYS = 1000


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (global bounds, totals) to every row: an
    equi-join on a constant key against the broadcast row (a broadcast hash join; no
    row pairs are formed)."""
    k = "_one"
    return (df.withColumn(k, F.lit(0))
            .join(F.broadcast(one_row.withColumn(k, F.lit(0))), k, "inner").drop(k))


def _row_hash(df: DataFrame, cols: Sequence[str] | None, keys: list[str]):
    flat = list(cols) if cols else [f.name for f in df.schema.fields
                                    if f.dataType.typeName() not in ("map", "array", "struct", "variant")] or keys
    return F.xxhash64(*[F.col(c) for c in flat])


def heavy_keys(counts: DataFrame, keys: Sequence[str], parts: int = HEAVY_KEYS) -> DataFrame:
    """``keys`` and ``_copies`` of each key that holds more than a ``1 / parts`` part of
    the rows, from the rows of each key (``keys``, ``_rows``); fewer than ``parts`` rows.
    Each copy takes about that part of the rows."""
    total = counts.agg(F.sum("_rows").alias("_all"))
    share = F.col("_rows") * F.lit(parts) / F.col("_all")
    return (attach_row(counts, total).where(share > 1)
            .select(*keys, F.ceil(share).cast("int").alias("_copies")))


def spread_join(fact: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner",
                counts: DataFrame | None = None, parts: int = HEAVY_KEYS,
                salt_cols: Sequence[str] | None = None) -> DataFrame:
    """``fact ⋈ groups`` on ``keys`` (``how`` = inner or left), heavy keys of ``fact``
    spread in proportion to their rows.  ``counts``: rows of each key (``keys``,
    ``_rows``) where the caller has them; else they are counted."""
    keys = list(keys)
    if counts is None:
        counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy_keys(counts, keys, parts).toDF(*[f"_heavy_{i}" for i in range(len(keys))], "_copies")

    def with_copies(df: DataFrame) -> DataFrame:
        # a null key is equal to null here, so the unmatched rows of a left join spread too
        same = [df[c].eqNullSafe(heavy[f"_heavy_{i}"]) for i, c in enumerate(keys)]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return df.join(F.broadcast(heavy), on, "left").select(
            *[df[c] for c in df.columns], F.coalesce("_copies", F.lit(1)).alias("_copies"))

    f = with_copies(fact).withColumn(
        "_salt", F.when(F.col("_copies") == 1, F.lit(0)).otherwise(
            F.pmod(_row_hash(fact, salt_cols, keys), F.col("_copies")).cast("int"))).drop("_copies")
    g = with_copies(groups).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return f.join(g, keys + ["_salt"], how).drop("_salt")


def join_groups(fact: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner",
                broadcast: bool = False, counts: DataFrame | None = None,
                salt_cols: Sequence[str] | None = None) -> DataFrame:
    """``fact ⋈ groups`` on ``keys`` (``how`` = inner or left).

    ``broadcast=True`` only when ``groups`` has a proven small bound; otherwise
    ``spread_join``.
    """
    keys = list(keys)
    if not keys:
        return attach_row(fact, groups)
    if broadcast:
        return fact.join(F.broadcast(groups), keys, how)
    return spread_join(fact, groups, keys, how, counts, salt_cols=salt_cols)
