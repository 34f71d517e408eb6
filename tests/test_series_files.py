"""Monthly count and value series given as three CSV files (counts with ``MMM-yy``
dates, values with ``MM/yyyy`` dates, and their expected merge): our operators must
reproduce the merge and the year-over-year trend it implies.  The file paths come
from PLOTLINE_SERIES_COUNTS / PLOTLINE_SERIES_VALUES / PLOTLINE_SERIES_MERGED; the
test is skipped when they are not set."""

import os

import pytest
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.operators import series as S
from plotline.sources import files as SRC

COUNTS = os.environ.get("PLOTLINE_SERIES_COUNTS", "")
VALUES = os.environ.get("PLOTLINE_SERIES_VALUES", "")
MERGED = os.environ.get("PLOTLINE_SERIES_MERGED", "")

pytestmark = pytest.mark.skipif(not all(p and os.path.exists(p) for p in (COUNTS, VALUES, MERGED)),
                                reason="series files not configured")


@pytest.fixture(scope="module")
def frames(spark):
    counts = SRC.scan_csv(spark, COUNTS, "Date string, Transaction_Number int, City string")
    # count dates are 'Jan-11'; the merged file uses the value file's 'MM/yyyy'
    counts = counts.withColumn("Date", F.date_format(F.to_date("Date", "MMM-yy"), "MM/yyyy"))
    values = SRC.scan_csv(spark, VALUES, "Date string, Transaction_Value double, City string")
    merged = SRC.scan_csv(spark, MERGED,
                          "Date string, Transaction_Number int, City string, Transaction_Value double")
    return counts, values, merged


def test_row_counts_and_merge(frames):
    counts, values, merged = frames
    assert counts.count() == 648 and values.count() == 504 and merged.count() == 360
    j = S.join_series(counts, values).select("Date", "Transaction_Number", "City", "Transaction_Value")
    assert j.count() == 360
    assert j.exceptAll(merged).count() == 0 and merged.exceptAll(j).count() == 0
    assert S.join_series(counts, values, trim_keys=True).count() == 504


def test_trend_from_merged(spark, frames):
    _, _, merged = frames
    m = merged.withColumn("date", F.to_date("Date", "MM/yyyy"))
    med = S.medians_by_city_year(m, "City", "date", "Transaction_Value", [2015, 2016])
    coords = spark.createDataFrame(K.REGION_COORDS, "city string, latitude double, longitude double")
    got = {r.city: (r.direction, r.change_percent) for r in S.city_price_trend(med, 2015, 2016, coords).collect()}
    # the facts derived from the merged file
    assert got == {"Baabda, Aley, Chouf": ("up", 15.67), "Beirut": ("up", 15.62), "Bekaa": ("up", 4.73),
                   "Kesrouan, Jbeil": ("down", -15.88), "Tripoli, Akkar": ("up", 4.33)}
