"""Exact, skew-safe grouped quantiles.

Spark's ``percentile``/``median`` aggregates keep every distinct value of a group in
one hash map and merge a group's partial maps in a single task.  ``exact_quantiles``
gives the same exact, linearly interpolated answer (pandas ``quantile``, DuckDB
``quantile_cont``) from plain counts:

1. rows are counted per (group, bucket), where a bucket is an order-preserving number
   of the value (``accuracy`` buckets for each doubling of its size); a running count
   over the buckets names those that hold a wanted rank;
2. a second pass counts the distinct values of these buckets; a running count over them
   gives the values at ranks floor((n-1)p) and ceil((n-1)p).

All counting is by hash aggregation with map-side combine, spread over (group, bucket,
value), so a hot group and a hot value both collapse before the shuffle.  A running
count sees the buckets of one group or the distinct values of one bucket (0.14 % wide by
default), never the rows of a group, and streams over a sort that may spill.  Other
aggregates (avg, min, max, count) ride along in pass 1 as one more grouping set, so the
input is scanned twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.session import ensure_checkpoint_dir

DEFAULT_ACCURACY = 512
#: Most hashes of wanted buckets that are broadcast (16 bytes or so each).
FILTER_HASHES = 2_000_000
#: Above the base-2 exponent of every finite double, and below minus that of the smallest.
_EXPONENTS = 1100


def value_bucket(v: Column, accuracy: int) -> Column:
    """Bucket number of a double: never decreases as the value grows (0 is bucket 0, NaN
    sorts last as in Spark, NULL has none)."""
    size = F.floor(F.log2(F.abs(v)) * F.lit(float(accuracy))) + F.lit(_EXPONENTS * accuracy)
    top = F.lit(3 * _EXPONENTS * accuracy).cast("long")
    return (F.when(v.isNull(), F.lit(None).cast("long")).when(F.isnan(v), top + 1)
            .when(v == float("inf"), top).when(v == float("-inf"), -top)
            .when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size))


def _by(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``names`` where NULL equals NULL."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    return left.join(other, same).drop(*[f"_r_{c}" for c in names])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column | None = None,
                    probs: dict[str, float] | None = None, extra_aggs: Sequence[Column] = (),
                    accuracy: int = DEFAULT_ACCURACY,
                    specs: dict[str, tuple[str | Column, float]] | None = None,
                    broadcast_groups: bool = False, filter_rows: bool = False) -> DataFrame:
    """Per group of ``keys``: exact quantiles as named columns.

    Either ``value`` + ``probs={name: p}`` or ``specs={name: (value_col, p)}``.
    NULL values are ignored (pandas/SQL semantics); NULL keys are a group.  ``extra_aggs``
    are computed over the group's rows of ``df`` in the first pass.  A group whose values
    are all NULL gets NULL quantiles; no rows and no keys give one row of NULLs.
    ``accuracy``: buckets for each doubling of a value; any choice gives the same result.
    ``broadcast_groups``: the number of groups has a proven small bound, so the wanted
    buckets are broadcast and only their rows are shuffled; otherwise the distinct values
    are counted first and joined by (group, bucket).  ``filter_rows``: runs the first pass
    when called and writes the wanted buckets to the checkpoint folder; where their 64-bit
    hashes are few enough (``FILTER_HASHES``) they are broadcast, and the second pass
    shuffles the rows with such a hash only (the join by (group, bucket) stays).
    """
    keys = list(keys)
    if specs is None:
        specs = {n: (value, p) for n, p in (probs or {}).items()}
    # Distinct value expressions -> _v0, _v1, ...
    tags: list[str] = []
    exprs: list[Column] = []
    wanted: list[tuple[str, int, float]] = []
    for name, (v, p) in specs.items():
        tag = v if isinstance(v, str) else str(v)
        if tag not in tags:
            tags.append(tag)
            exprs.append((F.col(v) if isinstance(v, str) else v).cast("double"))
        wanted.append((name, tags.index(tag), float(p)))
    m = range(len(exprs))

    def ranks(p: float, n: Column) -> tuple[Column, Column]:
        h = (n - 1).cast("double") * F.lit(p)
        return F.floor(h), F.ceil(h)

    def holds_rank(before: Column, count: Column, n: Column) -> Column:
        """One of the wanted ranks of value ``_j`` lies in [before, before + count)."""
        return reduce(or_, [(F.col("_j") == j) & reduce(or_, [(r >= before) & (r < before + count)
                                                             for r in ranks(p, n)])
                            for _, j, p in wanted])

    # Pass 1: counts per bucket of each value, and the group's own aggregates.
    numbered = df.withColumns({f"_v{j}": e for j, e in enumerate(exprs)})
    numbered = numbered.withColumns({f"_b{j}": value_bucket(F.col(f"_v{j}"), accuracy) for j in m})
    buckets = [f"_b{j}" for j in m]
    counts = numbered.groupingSets([[*keys, b] for b in buckets] + [keys], *keys, *buckets).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_c"), *extra_aggs)
    made = {"_g", "_c", *keys, *buckets}
    extras = [c for c in counts.columns if c not in made]
    every = 2 ** len(exprs) - 1                       # grouping id of the group's own row

    counts = counts.withColumn("_j", F.coalesce(*[
        F.when(F.col("_g") == (every ^ (1 << (len(exprs) - 1 - j))), F.lit(j)) for j in m], F.lit(-1)))
    counts = (counts.withColumn("_b", F.coalesce(*[F.when(F.col("_j") == j, F.col(f"_b{j}")) for j in m]))
              .where((F.col("_j") == -1) | F.col("_b").isNotNull()))
    # One sort by (keys, _j, _b) serves all three windows.
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    group = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_j", "_b").rowsBetween(*whole)
    one = Window.partitionBy(*keys, "_j").orderBy("_b")
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "_n": F.sum("_c").over(one.rowsBetween(*whole)), "_prev": F.coalesce(F.sum("_c").over(before), F.lit(0)),
        **{c: F.max(F.when(F.col("_j") == -1, F.col(c))).over(group) for c in extras}})
    # ``_j`` = -1 stands for the group itself.
    info = ["_n", "_prev", *extras]
    targets = (counts.where((F.col("_j") == -1) | holds_rank(F.col("_prev"), F.col("_c"), F.col("_n")))
               .select(*keys, "_j", F.coalesce("_b", F.lit(0)).alias("_b"), *info))

    # Pass 2: distinct values of the wanted buckets.  A missing value stands for its group,
    # so a group without values keeps its row.
    entries = [F.when(F.col(f"_v{j}").isNull(), F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("b"),
                                                         F.lit(None).cast("double").alias("v")))
               .otherwise(F.struct(F.lit(j).alias("j"), F.col(f"_b{j}").alias("b"), F.col(f"_v{j}").alias("v")))
               for j in m]
    entry = entries[0] if len(entries) == 1 else F.explode(F.array(*entries))
    rows = (numbered.select(*keys, entry.alias("_e"))
            .select(*keys, F.col("_e.j").alias("_j"), F.col("_e.b").alias("_b"), F.col("_e.v").alias("_v")))
    place = [*keys, "_j", "_b"]
    if filter_rows:
        ensure_checkpoint_dir(df.sparkSession)
        targets = targets.checkpoint(eager=True)
        if targets.count() <= FILTER_HASHES:
            hashes = targets.select(F.xxhash64(*place).alias("_h")).distinct()
            rows = rows.withColumn("_h", F.xxhash64(*place)).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    if broadcast_groups or not keys:
        found = (_by(rows, F.broadcast(targets), place).groupBy(*place, *info, "_v")
                 .agg(F.count(F.lit(1)).alias("_c")))
    else:
        found = _by(rows.groupBy(*place, "_v").agg(F.count(F.lit(1)).alias("_c")), targets, place)
    before = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = found.withColumn("_from", F.col("_prev") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    picked = [F.any_value(c).alias(c) for c in extras]
    for name, j, p in wanted:
        lo, hi = ranks(p, F.col("_n"))
        at_lo, at_hi = ((F.col("_j") == j) & (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c"))
                        for r in (lo, hi))
        share = (F.col("_n") - 1).cast("double") * F.lit(p) - lo
        v_lo, v_hi = F.max(F.when(at_lo, F.col("_v"))), F.max(F.when(at_hi, F.col("_v")))
        picked.append((v_lo + (v_hi - v_lo) * F.max(F.when(F.col("_j") == j, share))).alias(name))
    return values.groupBy(*keys).agg(*picked) if keys else values.agg(*picked)
