"""Monthly transaction series: merge, totals, trend, scenarios, spines and indexes.

Series tables are aggregates (one row per city and month), so per-city windows
here sort at most a few hundred rows each.  Fact-sized inputs are always reduced
with ``groupBy`` first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.dates import month_spine
from plotline.functions.numeric import (EXACT, annual_to_monthly_rate, exact_sum, money_avg, pct_change,
                                        round_to, trend_direction, uniform_noise)
from plotline.operators.ordering import offsets
from plotline.operators.quantiles import exact_quantiles


def join_series(counts: DataFrame, values: DataFrame, keys: Sequence[str] = ("Date", "City"),
                trim_keys: bool = False) -> DataFrame:
    """Counts ⋈ values on (Date, City), inner.  Keys match exactly by default, so a
    city spelled with a trailing blank on one side is lost; ``trim_keys`` trims both."""
    keys = list(keys)
    if trim_keys:
        counts = counts.withColumns({k: F.trim(k) for k in keys if k != "Date"})
        values = values.withColumns({k: F.trim(k) for k in keys if k != "Date"})
    return counts.join(values, keys, "inner")


def monthly_total_by_city(df: DataFrame, city: str, date: str, value: str,
                          date_format: str | None = None) -> DataFrame:
    """Sum of ``value`` per (city, month); values that are no (finite) number count as 0.
    Sums are exact (``EXACT``), so the total does not depend on the summation order; a
    number too large for them raises."""
    d = F.to_date(F.col(date), date_format) if date_format else F.col(date)
    number = F.col(value).try_cast("double")
    known = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    v = F.when(known, F.col(value).cast(EXACT)).otherwise(F.lit(0).cast(EXACT))
    return (df.groupBy(F.col(city).alias("city"), F.trunc(d, "MM").alias("month"))
            .agg(exact_sum(v).alias("total_value"))
            .orderBy("month", "city"))


def yearly_total(df: DataFrame, city: str, date: str, value: str) -> DataFrame:
    return (df.groupBy(F.col(city).alias("city"), F.year(date).alias("year"))
            .agg(exact_sum(value).alias("total_value"))
            .orderBy("city", "year"))


def medians_by_city_year(df: DataFrame, city: str, date: str, value: str,
                         years: Sequence[int]) -> DataFrame:
    """Exact median of ``value`` per city and year, one column ``median_price_<year>``
    per requested year (NULL when the city has no data that year)."""
    d = df.where(F.year(date).isin(list(years))).withColumn("_y", F.year(date))
    m = exact_quantiles(d, [city, "_y"], value, {"_med": 0.5})
    return m.groupBy(F.col(city).alias("city")).agg(*[
        F.max(F.when(F.col("_y") == y, F.col("_med"))).alias(f"median_price_{y}") for y in years])


def city_price_trend(medians: DataFrame, y0: int, y1: int, coords: DataFrame,
                     band: float = 0.5) -> DataFrame:
    """Year-over-year median change per city: percent (2 decimals), direction (on the
    unrounded percent, ±``band``), current price, coordinates.  Cities missing either
    year or a coordinate row are skipped; a zero base year gives a NULL percent."""
    a, b = f"median_price_{y0}", f"median_price_{y1}"
    pct = pct_change(a, b)
    c = F.broadcast(coords.select(F.trim("city").alias("_k"), "latitude", "longitude"))
    return (medians.dropna(subset=[a, b])
            .join(c, F.trim(F.col("city")) == F.col("_k"), "inner")
            .select("city", trend_direction(pct, band).alias("direction"),
                    round_to(pct, 2).alias("change_percent"),
                    F.col(b).alias("current_price"), "latitude", "longitude"))


def scenario_projection(series: DataFrame, rates: DataFrame, default_city: str,
                        scenarios: Sequence[str] = ("boom", "crash"), city: str = "city",
                        date: str = "date", value: str = "price",
                        noise_seed: int | None = None) -> DataFrame:
    """Baseline plus one projected copy per scenario, in one pass.

    Projected value = price + start·(m^(month−1) − 1), where start is the first price
    of that (city, year) in date order and m = (1+annual rate)^(1/12).  The rate is the
    city's, else ``default_city``'s; a year without rates is left unchanged.
    ``noise_seed`` adds the ±1.5% jitter of the source (off by default).
    """
    s = series.select(F.col(city).alias("city"), F.col(date).alias("date"),
                      F.col(value).alias("price")).withColumn("_y", F.year("date"))
    # First price of each (city, year): a grouped min_by, no window over the fact rows.
    start = s.groupBy("city", "_y").agg(F.min_by("price", "date").alias("_start"))
    labels = ["Baseline"] + [x.capitalize() for x in scenarios]
    x = (s.join(start, ["city", "_y"])
         .withColumn("scenario", F.explode(F.array(*[F.lit(v) for v in labels])))
         .withColumn("_sc", F.lower("scenario")))
    # The rate table is a fixed-size dimension (years x cities x scenarios): broadcast.
    own = rates.select(F.col("year").alias("_y"), "city", F.lower("scenario").alias("_sc"),
                       F.col("annual_rate").alias("_own"))
    dflt = rates.where(F.col("city") == default_city).select(
        F.col("year").alias("_y"), F.lower("scenario").alias("_sc"), F.col("annual_rate").alias("_dflt"))
    x = (x.join(F.broadcast(own), ["_y", "city", "_sc"], "left")
         .join(F.broadcast(dflt), ["_y", "_sc"], "left"))
    rate = F.coalesce("_own", "_dflt")
    m = annual_to_monthly_rate(rate)
    trend = F.col("_start") * F.pow(m, (F.month("date") - 1).cast("double")) - F.col("_start")
    projected = F.col("price") + trend
    if noise_seed is not None:
        projected = projected * uniform_noise(noise_seed, "city", "date", "scenario")
    val = F.when((F.col("scenario") == "Baseline") | rate.isNull(), F.col("price")).otherwise(projected)
    return x.select("city", "date", "scenario", val.alias("transaction_value"))


def pivot_scenarios(proj: DataFrame, labels: Sequence[str] = ("Baseline", "Boom", "Crash")) -> DataFrame:
    """One row per (city, date), one column per scenario; 0 or missing -> NULL."""
    return proj.groupBy("city", "date").agg(*[
        F.max(F.when(F.col("scenario") == lab, F.nullif(F.col("transaction_value"), F.lit(0.0))))
        .alias(lab.lower()) for lab in labels])


def time_index_series(series: DataFrame, city: str = "city", date: str = "month") -> DataFrame:
    """0-based position of each month within its city's series."""
    w = Window.partitionBy(city).orderBy(date)
    return series.withColumn("time_index", (F.row_number().over(w) - 1).cast("bigint"))


def time_index_global(series: DataFrame, city: str = "city", date: str = "month") -> DataFrame:
    """0-based position over the whole (date, city)-sorted table, by ranges
    (``ordering.offsets``): a date with many rows may span several."""
    return offsets(series, [date, city], "time_index")


def future_spine(series: DataFrame, months: int, city: str = "city", date: str = "month") -> DataFrame:
    """The ``months`` month starts after each city's last month, with the time index
    continuing after the history (history has indexes 0..n-1)."""
    last = series.groupBy(city).agg(F.max(date).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return (last.select(city, "_n", F.posexplode(month_spine("_last", months)).alias("_k", "date"))
            .select(F.col(city).alias("city"), "date",
                    (F.col("_n") + F.col("_k")).cast("bigint").alias("time_index")))


def mean_by_month(series: DataFrame, value: str, date: str = "month",
                  keys: Sequence[str] = ()) -> DataFrame:
    return (series.groupBy(*keys, F.month(date).alias("month"))
            .agg(money_avg(value).alias("monthly_avg")))


def yearly_forecast_total(pred: DataFrame, city: str = "city", date: str = "date",
                          value: str = "predicted_value") -> DataFrame:
    """Sum of monthly predictions per calendar year (a year with no months is absent)."""
    return (pred.groupBy(F.col(city).alias("city"), F.year(date).alias("year"))
            .agg(F.sum(value).alias("total_value")))


def align_full_outer(hist: DataFrame, fc: DataFrame, keys: Sequence[str] = ("city", "year")) -> DataFrame:
    """History and forecast totals side by side per year; a side without the year is NULL,
    as is a historical total of 0 (a forecast of 0 stays)."""
    h = hist.select(*keys, F.nullif(F.col("total_value"), F.lit(0.0)).alias("historical"))
    f = fc.select(*keys, F.col("total_value").alias("forecast"))
    return h.join(f, list(keys), "full")
