"""Market rollups, comparison, dashboard KPIs and top-k queries.

All medians/percentiles go through :func:`exact_quantiles` (exact, bounded
per-task memory).  Every "first/top by" is an aggregate (``min_by``/``max_by``
over a struct ordering key) or a ``TakeOrderedAndProject`` (``orderBy+limit``),
never a global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.numeric import money_avg, round_to
from plotline.operators.joins import attach_row
from plotline.operators.quantiles import exact_quantiles


#: Buckets for each doubling where keys are many and their rows few, so that the buckets of
#: a key are fewer than its rows.
MANY_KEYS_ACCURACY = 64


def _quantile_choice(materialize: bool, bounded_keys: bool) -> dict:
    """How materialized rows of unbounded keys are counted; any choice gives the same result."""
    return {"filter_rows": True, "accuracy": MANY_KEYS_ACCURACY} if materialize and not bounded_keys else {}


def market_stats(df: DataFrame, key: str, value: str = "price", prefix: str = "price",
                 out_key: str | None = None, bounded_keys: bool = False,
                 materialize: bool = False) -> DataFrame:
    """avg / median / max / min / count of ``value`` per ``key`` as truncated BIGINTs.

    Pandas group-by semantics: NULL keys dropped, the count counts non-NULL values,
    the median interpolates; rows sorted by key.  A key whose values are all NULL
    gets NULL stats and count 0.  ``bounded_keys``: the key comes from a fixed-size
    dimension, so per-key statistics may be broadcast.  The mean is an exact sum over the
    count (independent of partitioning and summation order).
    """
    d = df.where(F.col(key).isNotNull())
    if materialize:
        # Expensive inputs (text parsing) are computed once: the narrow (key, value)
        # projection is checkpointed to the shared checkpoint folder and both
        # exact-quantile passes read it.  Runs a job when called.
        d = d.select(key, value)
        from plotline.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(d.sparkSession)
        d = d.checkpoint(eager=True)
    mean = money_avg(value)
    res = exact_quantiles(
        d, [key], value, {"_med": 0.5}, broadcast_groups=bounded_keys, **_quantile_choice(materialize, bounded_keys),
        extra_aggs=[mean.alias("_avg"), F.max(value).alias("_mx"),
                    F.min(value).alias("_mn"), F.count(value).alias("_cnt")])
    return (res.select(F.col(key).alias(out_key or key),
                       F.col("_avg").cast("bigint").alias(f"avg_{prefix}"),
                       F.col("_med").cast("bigint").alias(f"median_{prefix}"),
                       F.col("_mx").cast("bigint").alias(f"max_{prefix}"),
                       F.col("_mn").cast("bigint").alias(f"min_{prefix}"),
                       F.col("_cnt").cast("bigint").alias("listings_count"))
            .orderBy(out_key or key))


def market_extremes(df: DataFrame, key: str, value: str = "price", prefix: str = "price") -> DataFrame:
    """The max, min and count columns of ``market_stats``, for readers that need no
    median: one scan and one hash aggregation."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max(value).cast("bigint").alias(f"max_{prefix}"), F.min(value).cast("bigint").alias(f"min_{prefix}"),
                 F.count(value).alias("listings_count")))


def market_stats_levels(df: DataFrame, levels: Sequence[str], value: str = "price",
                        prefix: str = "price", bounded_keys: bool = False,
                        materialize: bool = False) -> DataFrame:
    """The rollup at several location levels from ONE pass pair over ``df`` (grouping
    sets): each row is emitted once per level as ``(level, key, value)``, rows with a
    NULL key at a level are dropped for that level, and one exact-quantile aggregation
    runs on ``(level, key)``.  Output: level, key + the ``market_stats`` columns.
    ``materialize``: levels and value are checkpointed once for both passes (a job when
    called), for text-parsed inputs."""
    levels = list(levels)
    if materialize:
        from plotline.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.select(*levels, value).checkpoint(eager=True)
    pairs = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).cast("string").alias("key"))
                      for lv in levels])
    x = (df.select(F.explode(pairs).alias("_l"), F.col(value).alias("_val"))
         .select("_l.level", "_l.key", "_val").where(F.col("key").isNotNull()))
    res = exact_quantiles(
        x, ["level", "key"], "_val", {"_med": 0.5}, broadcast_groups=bounded_keys,
        **_quantile_choice(materialize, bounded_keys),
        extra_aggs=[money_avg("_val").alias("_avg"),
                    F.max("_val").alias("_mx"),
                    F.min("_val").alias("_mn"), F.count("_val").alias("_cnt")])
    return (res.select("level", "key",
                       F.col("_avg").cast("bigint").alias(f"avg_{prefix}"),
                       F.col("_med").cast("bigint").alias(f"median_{prefix}"),
                       F.col("_mx").cast("bigint").alias(f"max_{prefix}"),
                       F.col("_mn").cast("bigint").alias(f"min_{prefix}"),
                       F.col("_cnt").cast("bigint").alias("listings_count"))
            .orderBy("level", "key"))


def attach_coords(df: DataFrame, coords: DataFrame, key: str = "district",
                  how: str = "inner") -> DataFrame:
    """Add latitude/longitude by district.  ``inner`` drops districts without a
    coordinate row (sale rollup); ``left`` keeps them with NULLs (yearly rent).
    The coordinate table is a fixed-size dimension, so it is broadcast."""
    return df.join(F.broadcast(coords), key, how)


def market_comparison(df: DataFrame, districts: Sequence[str], key: str = "district",
                      price: str = "price", size: str = "size_m2",
                      bedrooms: str = "bedrooms") -> DataFrame:
    # The requested list bounds the groups (2-5 districts), so stats are broadcast.
    """Per requested district: median price, median price/m², median size, listing
    count, 10th/90th price percentile, median bedrooms (all exact)."""
    d = df.where(F.col(key).isin(list(districts)))
    sqm = F.try_divide(F.col(price).cast("double"), F.nullif(F.col(size).cast("double"), F.lit(0.0)))
    res = exact_quantiles(
        d, [key], specs={"median_price": (price, 0.5), "median_sqm_price": (sqm, 0.5),
                         "median_size_m2": (size, 0.5), "price_p10": (price, 0.1),
                         "price_p90": (price, 0.9), "median_bedrooms": (bedrooms, 0.5)},
        extra_aggs=[F.count(F.lit(1)).alias("number_of_listings")], broadcast_groups=True)
    return res.select(key, *[round_to(c, 4).alias(c) for c in
                             ("median_price", "median_sqm_price", "median_size_m2")],
                      F.col("number_of_listings").cast("bigint").alias("number_of_listings"),
                      round_to("price_p10", 4).alias("price_p10"),
                      round_to("price_p90", 4).alias("price_p90"),
                      round_to("median_bedrooms", 4).alias("median_bedrooms"))


def _top_by(df: DataFrame, what: str, by: str, largest: bool) -> Column:
    """Aggregate picking ``what`` at the max/min of ``by`` (NULLs never win, ties to the
    smallest ``what``)."""
    order = F.struct((-F.col(by)) if largest else F.col(by), F.col(what))
    return F.min_by(F.col(what), F.when(F.col(by).isNotNull(), order))


def kpi_cards(district_rollup: DataFrame, series: DataFrame, most_by: str = "sum",
              district: str = "district", city: str = "city",
              count_col: str = "transaction_number") -> DataFrame:
    """One row: district with the highest max price and that price, district with the
    lowest min price and that price, total listings, and the series city with the
    most transactions (``most_by='sum'``) or the alphabetically first city
    (``most_by='first_city'``, the original dashboard's behaviour) with its total."""
    d = district_rollup.agg(
        _top_by(district_rollup, district, "max_price", True).alias("region_max"),
        F.max("max_price").alias("max_num"),
        _top_by(district_rollup, district, "min_price", False).alias("region_min"),
        F.min("min_price").alias("min_num"),
        F.sum("listings_count").cast("bigint").alias("sum_num"))
    sums = series.groupBy(city).agg(F.sum(count_col).cast("bigint").alias("_s"))
    if most_by == "sum":
        pick = F.min_by(F.struct(F.col(city), F.col("_s")), F.struct(-F.col("_s"), F.col(city)))
    else:
        pick = F.min_by(F.struct(F.col(city), F.col("_s")), F.col(city))
    t = sums.agg(pick.alias("_p")).select(F.col("_p")[city].alias("region_tran"),
                                          F.col("_p._s").alias("high_num"))
    return attach_row(d, t)


def count_by_type(df: DataFrame, key: str = "type") -> DataFrame:
    """Listings per type (a missing type is its own group), most frequent first."""
    return (df.groupBy(F.col(key).alias("name")).agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), F.asc_nulls_first("name")))


def agg_sum_global(df: DataFrame, col: str, alias: str = "sum") -> DataFrame:
    return df.agg(F.sum(col).cast("bigint").alias(alias))


def agg_sum_by_key(df: DataFrame, key: str, col: str, alias: str = "sum") -> DataFrame:
    return df.groupBy(key).agg(F.sum(col).cast("bigint").alias(alias)).orderBy(key)


def top_n(df: DataFrame, by: str, n: int, desc: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Top-n rows by ``by`` (NULLs last), ties broken by ``tiebreak`` ascending.
    Runs as a per-partition top-k then a single n-row merge (TakeOrderedAndProject)."""
    order = [F.col(by).desc_nulls_last() if desc else F.col(by).asc_nulls_last()]
    order += [F.col(c).asc() for c in tiebreak]
    return df.orderBy(*order).limit(n)


def page_range(df: DataFrame, order: str, first: int, last: int, tiebreak: Sequence[str]) -> DataFrame:
    """Rows ``first..last`` *inclusive* (``range(0, 50)`` is 51 rows) in ``order``."""
    return (df.orderBy(F.col(order).asc_nulls_last(), *[F.col(c) for c in tiebreak])
            .offset(first).limit(last - first + 1))


def filter_gt(df: DataFrame, col: str, threshold) -> DataFrame:
    return df.where(F.col(col) > threshold)


def max_by_key(df: DataFrame, what: str, by: str, alias: str) -> DataFrame:
    """Single row: ``what`` at the largest ``by`` (ties: smallest ``what``)."""
    return df.agg(_top_by(df, what, by, True).alias(alias), F.max(by).alias(f"max_{by}"))


def first_per_key(df: DataFrame, key: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` struct.  A grouped
    ``min_by`` (partial aggregation, no sort of the group) instead of a window."""
    pick = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order))
    return df.groupBy(key).agg(pick.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in cols])


def dedupe_by_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Drop duplicate keys keeping the first row by ``order`` (deterministic)."""
    cols = [c for c in df.columns if c != key]
    return first_per_key(df, key, order, cols)
