"""Forecasting and price models: regularised boosted trees (``boosting``) on the feature tables.

Fit-time statistics (median imputation, population standard deviation, most frequent
category) are exact aggregates of the rows a model is fitted on -- of the training part of
each fold in a grid search -- and are saved with the model, so serving applies the same
numbers.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.functions.dates import calendar_flags, cyclic_month
from plotline.functions.numeric import money_avg, round_hundreds, safe_ratio, zero_to_null
from plotline.operators import boosting
from plotline.operators.boosting import BoostedTrees, BoostParams
from plotline.operators.features import regression_metrics
from plotline.operators.joins import attach_row
from plotline.operators.ordering import dense_codes, label_encode
from plotline.operators.quantiles import exact_quantiles
from plotline.operators.series import align_full_outer, future_spine, yearly_forecast_total, yearly_total
from plotline.session import ensure_checkpoint_dir

FORECAST_PARAMS = BoostParams(**K.FORECAST_BOOST)
#: One setting of the source's grid (``grid_search`` picks among all).
PRICE_PARAMS = BoostParams(**{name: values[-1] if name in ("rate", "subsample", "colsample") else values[0]
                              for name, values in K.PRICE_GRID.items()})
#: The source ships its predictors fitted; these are the booster's usual values.
PREDICTOR_PARAMS = BoostParams(rounds=100)


# ------------------------------ forecasting --------------------------------------

def forecast_numeric_features(post_year: int) -> list[str]:
    return [c if c != "post_2013" else f"post_{post_year}" for c in K.FORECAST_NUMERIC_FEATURES]


def fit_forecast(features: DataFrame, split_date: str, post_year: int = 2013, params: BoostParams = FORECAST_PARAMS,
                 patience: int = K.FORECAST_PATIENCE) -> tuple[BoostedTrees, DataFrame]:
    """Validate on rows dated >= ``split_date``, then refit on all rows with the full
    number of rounds and no early stop.  Returns (model, metrics on the later rows).

    Every city has its own column.  The validation fit stops ``patience`` rounds after the
    round of the least error on the later rows, and its metrics are those of that round.
    The feature table is checkpointed once for both fits and the metrics.
    """
    ensure_checkpoint_dir(features.sparkSession)
    features = features.checkpoint(eager=True)
    numeric = forecast_numeric_features(post_year)
    later = F.col("date") >= F.lit(split_date).cast("date")
    checked = boosting.fit(features, "transaction_value", numeric, ["city"], params, key=["city", "date"],
                           valid=later, patience=patience)
    scored = checked.predict(features.where(later))
    metrics = regression_metrics(scored.select(F.col("transaction_value").alias("y"), F.col("prediction").alias("y_hat")))
    return boosting.fit(features, "transaction_value", numeric, ["city"], params, key=["city", "date"]), metrics


def serving_features(series: DataFrame, months: int = K.FORECAST_HORIZON_MONTHS, city: str = "city",
                     date: str = "month", value: str = "transaction_value", post_year: int = 2013) -> DataFrame:
    """The features of every city's 48-month spine after its history (index continues per
    city, monthly and overall means of that city's history).  A future month that a city
    never had has no monthly mean."""
    hist = series.select(F.lower(F.col(city)).alias("city"), F.col(date).alias("month"),
                         F.col(value).alias("transaction_value"))
    spine = future_spine(hist, months, "city", "month")
    month_avg = hist.groupBy("city", F.month("month").alias("_m")).agg(
        money_avg("transaction_value").alias("monthly_avg"))
    city_avg = hist.groupBy("city").agg(money_avg("transaction_value").alias("city_avg"))
    flags = calendar_flags("date", post_year)
    return (spine.withColumn("_m", F.month("date"))
            .join(month_avg, ["city", "_m"], "left").join(city_avg, "city", "left")
            .select("city", "date", "time_index", F.year("date").alias("year"),
                    F.month("date").alias("month"), F.quarter("date").alias("quarter"),
                    *cyclic_month("date"), *flags[:3], "monthly_avg", "city_avg", flags[3]))


def forecast_cities(series: DataFrame, model: BoostedTrees, months: int = K.FORECAST_HORIZON_MONTHS,
                    city: str = "city", date: str = "month", value: str = "transaction_value",
                    post_year: int = 2013) -> DataFrame:
    """Every city at once: prediction from its ``serving_features``.  Columns: city, date,
    predicted_value.  A missing monthly mean stays missing, as the source's booster received
    it.  A city the model was not fitted on raises."""
    feats = serving_features(series, months, city, date, value, post_year)
    return model.predict(feats, known=True).select("city", "date", F.col("prediction").alias("predicted_value"))


def forecast_report(series: DataFrame, model: BoostedTrees, post_year: int = 2013,
                    months: int = K.FORECAST_HORIZON_MONTHS) -> DataFrame:
    """Yearly history and forecast totals side by side per city (full outer by year)."""
    pred = forecast_cities(series, model, months, post_year=post_year)
    hist = yearly_total(series.withColumn("city", F.lower("city")), "city", "month", "transaction_value")
    fc = yearly_forecast_total(pred)
    return align_full_outer(hist, fc)


# ------------------------------ price model --------------------------------------

def random_split_flag(key_cols: Sequence[str], train_pct: int = 70, seed: int = 42):
    """Deterministic train flag from a hash of the key: stable under repartitioning
    and executor loss (``randomSplit`` is not)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]), F.lit(100)) < train_pct


def fold_number(key_cols: Sequence[str], folds: int, seed: int = 43):
    """Fold of a row, from a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class Preparation:
    """Imputation and scaling with the statistics of the rows it was fitted on: a missing
    number becomes the median, numbers are centred and divided by their population standard
    deviation (1 where that is 0), a missing category becomes the most frequent (ties: the
    first by name)."""

    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, str]

    @staticmethod
    def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preparation:
        medians = exact_quantiles(train, [], specs={f"m_{c}": (c, 0.5) for c in numeric}).first()
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(medians[f"m_{c}"] or 0.0))).alias(c)
                                for c in numeric])
        moments = filled.agg(*[F.avg(c).alias(f"a_{c}") for c in numeric],
                             *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
        modes = {}
        for c in categorical:
            top = (train.where(F.col(c).isNotNull()).groupBy(c).count()
                   .orderBy(F.desc("count"), F.asc(c)).limit(1).collect())
            modes[c] = str(top[0][0]) if top else ""
        return Preparation({c: (float(medians[f"m_{c}"] or 0.0), float(moments[f"a_{c}"] or 0.0),
                                float(moments[f"s_{c}"] or 1.0)) for c in numeric}, modes)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with ``n_<number>`` and ``c_<category>`` columns."""
        return df.withColumns({f"n_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(s)
                               for c, (m, a, s) in self.numeric.items()}
                              | {f"c_{c}": F.coalesce(F.col(c), F.lit(v)) for c, v in self.categorical.items()})


@dataclass
class PriceModel:
    """A preparation and the trees fitted on what it makes."""

    preparation: Preparation
    trees: BoostedTrees

    def predict(self, df: DataFrame) -> DataFrame:
        made = [f"n_{c}" for c in self.preparation.numeric] + [f"c_{c}" for c in self.preparation.categorical]
        return self.trees.predict(self.preparation.apply(df)).drop(*made)

    def save(self, spark: SparkSession, path: str) -> None:
        p = self.preparation
        spark.createDataFrame([(json.dumps({"numeric": p.numeric, "categorical": p.categorical}),)], "value string") \
            .coalesce(1).write.text(f"{path}/preparation")
        self.trees.save(spark, f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PriceModel:
        p = json.loads(spark.read.text(f"{path}/preparation", wholetext=True).first().value)
        return PriceModel(Preparation({c: tuple(v) for c, v in p["numeric"].items()}, p["categorical"]),
                          BoostedTrees.load(spark, f"{path}/trees"))


def fit_price_model(train: DataFrame, params: BoostParams = PRICE_PARAMS, key: Sequence[str] = ("listing_id",),
                    numeric: Sequence[str] = K.PRICE_NUMERIC_FEATURES,
                    categorical: Sequence[str] = K.PRICE_CATEGORICAL_FEATURES) -> PriceModel:
    """Trees on log price.  Every level of a category has its column; unseen ones are all zeros."""
    preparation = Preparation.fit(train, numeric, categorical)
    return PriceModel(preparation, boosting.fit(preparation.apply(train), "log_price", [f"n_{c}" for c in numeric],
                                                [f"c_{c}" for c in categorical], params, key=list(key)))


def fit_price(features: DataFrame, key: Sequence[str] = ("listing_id",), train_pct: int = 70,
              params: BoostParams = PRICE_PARAMS) -> tuple[PriceModel, DataFrame]:
    """Fit on the hashed 70% split; return (model, test-split metrics on log price and the
    mean absolute error in dollars)."""
    ensure_checkpoint_dir(features.sparkSession)
    flagged = features.withColumn("_train", random_split_flag(list(key), train_pct)).checkpoint(eager=True)
    model = fit_price_model(flagged.where("_train"), params, key)
    pred = model.predict(flagged.where(~F.col("_train")))
    m = regression_metrics(pred.select(F.col("log_price").alias("y"), F.col("prediction").alias("y_hat")))
    dollars = pred.agg(F.avg(F.abs(F.expm1("log_price") - F.expm1("prediction"))).alias("mae_dollars"))
    return model, attach_row(m, dollars)


def grid_settings(grid: dict[str, Sequence] = K.PRICE_GRID, base: BoostParams = PRICE_PARAMS) -> list[BoostParams]:
    return [replace(base, **dict(zip(grid, values))) for values in itertools.product(*grid.values())]


def grid_search(features: DataFrame, settings: Sequence[BoostParams] | None = None, folds: int = K.PRICE_FOLDS,
                key: Sequence[str] = ("listing_id",)) -> tuple[PriceModel, list[tuple[BoostParams, float]]]:
    """Mean R² over ``folds`` hashed folds of each setting (default: the source's 32), and
    the best setting (ties: the first) refitted on all rows.  Imputation, scaling and levels
    come from each fold's training rows alone."""
    ensure_checkpoint_dir(features.sparkSession)
    rows = features.withColumn("_fold", fold_number(list(key), folds)).checkpoint(eager=True)
    settings = list(settings or grid_settings())
    scores = []
    for params in settings:
        r2 = []
        for k in range(folds):
            model = fit_price_model(rows.where(F.col("_fold") != k), params, key)
            pred = model.predict(rows.where(F.col("_fold") == k))
            r2.append(regression_metrics(pred.select(F.col("log_price").alias("y"), F.col("prediction").alias("y_hat"))).first().r2)
        scores.append(sum(r2) / folds)
    best = settings[max(range(len(settings)), key=lambda i: (scores[i], -i))]
    return fit_price_model(rows, best, key), list(zip(settings, scores))


def request_features(requests: DataFrame) -> DataFrame:
    """Serving features from a request table (same rules as training: numbers coerced,
    0 rooms are missing, zero divisors give NULL ratios)."""
    r = requests.withColumns({c: F.col(c).try_cast("double") for c in ("size_m2", "bedrooms", "bathrooms")})
    r = r.withColumns({"bedrooms": zero_to_null("bedrooms"), "bathrooms": zero_to_null("bathrooms")})
    return r.withColumns({"log_size_m2": F.log1p("size_m2"),
                          "bed_bath_ratio": safe_ratio("bedrooms", "bathrooms"),
                          "size_per_bedroom": safe_ratio("size_m2", "bedrooms")})


def estimate_price(model: PriceModel, requests: DataFrame, spread: float = K.ESTIMATE_RANGE) -> DataFrame:
    """Batch fair-price estimates: dollars rounded to hundreds (ties to even) with a
    ±``spread`` range.  A request table without every required field is rejected."""
    missing = [c for c in K.ESTIMATE_REQUIRED if c not in requests.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    p = model.predict(request_features(requests)).withColumn("_usd", F.expm1("prediction"))
    keep = [c for c in requests.columns]
    return p.select(*keep, round_hundreds("_usd").alias("estimated_price"),
                    round_hundreds(F.col("_usd") * (1 - spread)).alias("price_range_low"),
                    round_hundreds(F.col("_usd") * (1 + spread)).alias("price_range_high"))


def feature_importance(spark: SparkSession, trees: BoostedTrees, top: int = 20) -> DataFrame:
    """The ``top`` columns by their share of the mean gain."""
    return spark.createDataFrame(trees.importance()[:top], "feature string, importance double")


# ------------------------------ label-encoded predictors -------------------------

@dataclass
class LabelEncodedModel:
    """Sorted-label codes as ordinary numbers, other numbers, and trees on both."""

    codes: dict[str, DataFrame]
    trees: BoostedTrees
    #: rows of each label in the table that the codes are from
    counts: dict[str, DataFrame] | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with its prediction; a label without a code raises."""
        made = [f"{c}_code" for c in self.codes]
        return self.trees.predict(label_encode(df, self.codes, counts=self.counts)).drop(*made)


def fit_label_encoded(labels: DataFrame, train: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                      target: str, params: BoostParams = PREDICTOR_PARAMS,
                      key: Sequence[str] | None = None) -> LabelEncodedModel:
    """``labels``: the table whose values get codes.  The codes enter as numbers, so the
    number of levels has no bound.  ``labels`` is read once a column: its labels are counted,
    and these counts give the codes and the heavy labels of both fit and prediction."""
    ensure_checkpoint_dir(labels.sparkSession)
    counts = {c: labels.groupBy(c).agg(F.count(F.lit(1)).alias("_rows")).checkpoint(eager=True) for c in categorical}
    codes = {c: dense_codes(counts[c], c).checkpoint(eager=True) for c in categorical}
    coded = label_encode(train, codes, counts=counts)
    return LabelEncodedModel(codes, boosting.fit(coded, target, [f"{c}_code" for c in categorical] + list(numeric), [],
                                                 params, key=key), counts)
