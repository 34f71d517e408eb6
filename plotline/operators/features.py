"""Feature engineering and evaluation tables (all exact, SQL-checkable).

Group statistics are attached with ``groupBy`` + join (partial aggregation, AQE
broadcast or skew-split join) rather than ``avg().over(partitionBy(k))``, which
would buffer a whole hot group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.functions.dates import calendar_flags, cyclic_month
from plotline.functions.numeric import money_avg, round_to, safe_ratio, zero_to_null
from plotline.operators.joins import attach_row, join_groups
from plotline.operators.quantiles import exact_quantiles
from plotline.operators.series import time_index_global, time_index_series


def attach_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                       broadcast_groups: bool = False) -> DataFrame:
    """Add per-group aggregates to every row (pandas ``groupby().transform``): a
    partial-aggregated ``groupBy`` joined back skew-safely (see ``joins``)."""
    keys = list(keys)
    if not keys:
        return join_groups(df, df.agg(*aggs), keys, "left")
    stats = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    return join_groups(df, stats.drop("_rows"), keys, "left", broadcast=broadcast_groups,
                       counts=stats.select(*keys, "_rows"))


def forecast_features(series: DataFrame, city: str = "city", date: str = "month",
                      value: str = "transaction_value", index_scope: str = "series",
                      avg_scope: str = "series", post_year: int = 2013) -> DataFrame:
    """Calendar, index and average features of a monthly series.

    ``index_scope``: ``series`` = position within the city (serving), ``global`` =
    position over the whole date-sorted table (the original training).
    ``avg_scope``: monthly_avg per city and month (``series``) or over all cities
    (``global``).  city_avg is always the city's mean.
    """
    s = series.select(F.lower(F.col(city)).alias("city"), F.col(date).alias("date"),
                      F.col(value).alias("transaction_value"))
    s = (time_index_series(s, "city", "date") if index_scope == "series"
         else time_index_global(s, "city", "date"))
    month_keys = ["city", "_m"] if avg_scope == "series" else ["_m"]
    s = s.withColumn("_m", F.month("date"))
    # transaction values are money: exact decimal means (order-independent)
    s = attach_group_stats(s, month_keys, [money_avg("transaction_value").alias("monthly_avg")])
    s = attach_group_stats(s, ["city"], [money_avg("transaction_value").alias("city_avg")])
    flags = calendar_flags("date", post_year)
    return s.select("date", "city", "time_index", F.year("date").alias("year"),
                    F.month("date").alias("month"), F.quarter("date").alias("quarter"),
                    *cyclic_month("date"), *flags[:3], "monthly_avg", "city_avg", flags[3],
                    "transaction_value")


def exact_global_quantiles(df: DataFrame, value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row of exact global quantiles (bounded memory, see ``exact_quantiles``)."""
    return exact_quantiles(df, [], value, probs)


def price_features(props: DataFrame, property_type: str = "Apartment",
                   rare_min_rows: int = K.RARE_DISTRICT_MIN_ROWS,
                   trim: tuple[float, float] = K.TRIM_QUANTILES,
                   materialize: bool = True) -> DataFrame:
    """Model table for one property type.

    coerce -> drop missing price/size -> 0 rooms are missing -> size > 0 ->
    price/m² kept inside its exact [1%, 99%] quantiles (inclusive) -> ratio features
    (zero divisor -> NULL) -> district means of price/m² and size -> districts with
    fewer than ``rare_min_rows`` rows become ``Other`` (after the means) -> log1p.

    ``materialize``: the trimmed table feeds both the district statistics and their
    join back; it is written once with ``checkpoint()`` to the shared folder named by
    ``spark.checkpoint.dir`` (lineage cut, survives executor loss) instead of being
    recomputed -- with its two quantile passes -- for each branch.  This runs a job
    when the function is called.
    """
    d = (props.where(F.col("type") == property_type)
         .withColumns({c: F.col(c).try_cast("double")
                       for c in ("bedrooms", "bathrooms", "price", "size_m2")})
         .dropna(subset=["price", "size_m2"])
         .withColumns({"bedrooms": zero_to_null("bedrooms"), "bathrooms": zero_to_null("bathrooms")})
         .where(F.col("size_m2") > 0)
         .withColumn("price_per_m2", F.col("price") / F.col("size_m2")))
    q = exact_global_quantiles(d, "price_per_m2", {"_qlo": trim[0], "_qhi": trim[1]})
    d = (attach_row(d, q)
         .where((F.col("price_per_m2") >= F.col("_qlo")) & (F.col("price_per_m2") <= F.col("_qhi")))
         .drop("_qlo", "_qhi")
         .withColumns({"bed_bath_ratio": safe_ratio("bedrooms", "bathrooms"),
                       "size_per_bedroom": safe_ratio("size_m2", "bedrooms")}))
    if materialize:
        from plotline.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(d.sparkSession)
        d = d.checkpoint(eager=True)
    d = attach_group_stats(d, ["district"], [F.avg("price_per_m2").alias("avg_price_in_district"),
                                             F.avg("size_m2").alias("avg_size_in_district"),
                                             F.count(F.lit(1)).alias("_dn")])
    d = d.withColumn("district", F.when(F.col("_dn") < rare_min_rows, F.lit("Other"))
                     .otherwise(F.col("district")))
    return d.select(*(["listing_id"] if "listing_id" in props.columns else []),
                    F.log1p("size_m2").alias("log_size_m2"), "bedrooms", "bathrooms",
                    "latitude", "longitude", "bed_bath_ratio", "size_per_bedroom",
                    "province", "district", "city", F.log1p("price").alias("log_price"),
                    "price_per_m2", "avg_price_in_district", "avg_size_in_district")


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson r for every ordered pair of ``cols``, the diagonal included
    (pairwise-complete: a row counts for a pair when both values are present); NULL where
    one of the two is constant over those rows or there are none.  A row is spread to its
    pairs and these are summed up by pair, so the plan has the same size for any ``cols``."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    spread = (df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
              .select("_v", F.posexplode("_v").alias("_i", "_x")).where("_x IS NOT NULL")
              .select("_i", "_x", F.posexplode("_v").alias("_j", "_y")).where("_j >= _i AND _y IS NOT NULL"))
    half = spread.groupBy("_i", "_j").agg(F.try_divide(
        F.covar_pop("_x", "_y"), F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0))).alias("r"))
    n = len(cols)
    grid = df.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("_a"), (F.col("id") % n).cast("int").alias("_b"))
    return (grid.join(F.broadcast(half),           # a row for each pair of columns
                      (F.least("_a", "_b") == F.col("_i")) & (F.greatest("_a", "_b") == F.col("_j")), "left")
            .select(F.element_at(names, F.col("_a") + 1).alias("col_a"), F.element_at(names, F.col("_b") + 1).alias("col_b"),
                    round_to("r", digits).alias("r")))


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "y_hat") -> DataFrame:
    """One row: mae, rmse, mape (percent), r2 = 1 − SSE/SST, over rows with both values.
    ``mape`` leaves out rows with y = 0 (NULL if there are no others); ``r2`` is NULL
    where y is constant."""
    d = pred.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = F.col(yhat) - F.col(y)
    share = F.try_divide(F.abs(e), F.nullif(F.abs(F.col(y).cast("double")), F.lit(0.0)))
    sst = F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return d.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                 (F.avg(share) * 100).alias("mape"),
                 (F.lit(1.0) - F.try_divide(F.sum(e * e), sst)).alias("r2"))


def rare_categories(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Values of ``key`` with fewer than ``min_rows`` rows, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_rows)
