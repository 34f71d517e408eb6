"""Registered queries: op_id -> Spark DataFrame builder, plus the DuckDB oracle SQL.

Every query reads the whole driver tables (through the views in ``views.py``) so
its work grows with the data.  Parameters that pick a branch (thresholds, the
district list, trend years) are chosen so that both sides of the branch occur
on the test tables; they are parameters of the operators, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.functions.numeric import money_avg, price_per_m2, radius_bucket, round_to
from plotline.functions.text import canonical_contains_ci, clean_room_count, contains_arabic
from plotline.operators import features as FE
from plotline.operators import listings as L
from plotline.operators import rollups as R
from plotline.operators import series as S
from plotline.plans import views as V
from plotline.plans.views import with_views
from plotline.sources import files as SRC
from plotline.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Rollups over text-parsed inputs pass ``materialize=True``: the parsed (key, value)
# projection is checkpointed once instead of re-parsing for each quantile pass.

# Parameters for the driver tables -------------------------------------------------
# Rollups keyed by province (region, 5 rows) or district (nation, 25 rows; or a
# fixed list of names) pass ``bounded_keys=True``: their per-key statistics are
# broadcast.  City (supplier) and free-text keys grow with the data: their distinct
# values are counted, then joined by (key, bucket).
PROVINCES = V.REGIONS
DISTRICTS = [f"NATION_{i}" for i in range(23)]          # NATION_23/24 are not valid districts
# The comparison request as it arrives (a comma list with a repeat and an empty item).
COMPARE_PARAM = "NATION_1, NATION_7,NATION_13,, NATION_22, NATION_1"
COMPARE = ["NATION_1", "NATION_7", "NATION_13", "NATION_22"]
HOT_MIN = 2000                                          # reference value 400; see README
TREND_YEARS = (1999, 2000)
PRICE_TYPE = "STANDARD"
RARE_MIN = 200
POST_YEAR = 1998
SPLIT_DATE = "1999-01-01"
DEFAULT_RATE_CITY = V.RATE_CITY_MAP[K.DEFAULT_RATE_CITY]
CITY_NEEDLES = [("nation_1", "north"), ("nation_2", "south"), ("nation_3", "east")]
SYSTEM_PROMPT = "You are a property-market assistant."


def _in_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _stats_sql(src: str, key: str, value: str = "price", prefix: str = "price",
               out_key: str | None = None, scale: int = 2) -> str:
    ok = out_key or key
    mean = (f"CAST(sum(CAST({value} AS DECIMAL(38,{scale}))) AS DOUBLE) "
            f"/ CAST(count({value}) AS DOUBLE)")
    return (f"SELECT {key} AS {ok}, CAST(trunc({mean}) AS BIGINT) AS avg_{prefix}, "
            f"CAST(trunc(median({value})) AS BIGINT) AS median_{prefix}, "
            f"CAST(trunc(max({value})) AS BIGINT) AS max_{prefix}, "
            f"CAST(trunc(min({value})) AS BIGINT) AS min_{prefix}, "
            f"CAST(count({value}) AS BIGINT) AS listings_count "
            f"FROM {src} WHERE {key} IS NOT NULL GROUP BY {key}")


def _listing(spark, d, with_part=True):
    return V.listing(Tables(spark, d), with_part=with_part)


def district_rollup(spark, d) -> DataFrame:
    return R.market_stats(_listing(spark, d, False), "district", bounded_keys=True)


def district_extremes(spark, d) -> DataFrame:
    return R.market_extremes(_listing(spark, d, False), "district")


# Parsed-text CTEs (oracle side) ----------------------------------------------------
_PROV_RX = "(" + "|".join(PROVINCES) + ")"
_CLEAN_RENT_SQL = f""", rent_clean AS (
  SELECT listing_id, Address AS address, Type AS type,
         TRY_CAST(regexp_replace(Price, '\\$| /Year|,', '', 'g') AS DOUBLE) AS price,
         TRY_CAST(regexp_replace(Size, ' m²|,', '', 'g') AS DOUBLE) AS size_m2,
         TRY_CAST(trunc(TRY_CAST(Bedrooms AS DOUBLE)) AS INTEGER) AS bedrooms,
         TRY_CAST(trunc(TRY_CAST(Bathrooms AS DOUBLE)) AS INTEGER) AS bathrooms
  FROM raw_rent),
rent_parsed AS (
  SELECT *, NULLIF(regexp_extract(address, '{_PROV_RX}', 1), '') AS province,
         CASE WHEN trim(split_part(address, ',', 2)) IN ({_in_list(DISTRICTS)})
              THEN trim(split_part(address, ',', 2)) END AS district,
         trim(split_part(address, ',', 1)) AS city
  FROM rent_clean),
rent_prov AS (SELECT * FROM rent_parsed WHERE province IS NOT NULL)
"""
_CLEAN_BUY_SQL = f""", buy_clean AS (
  SELECT listing_id, Address AS address, Type AS type,
         TRY_CAST(regexp_replace(Price, '[$,]', '', 'g') AS DOUBLE) AS price,
         TRY_CAST(regexp_replace(Size, ' m²|,', '', 'g') AS DOUBLE) AS size_m2,
         TRY_CAST(trunc(TRY_CAST(Bedrooms AS DOUBLE)) AS INTEGER) AS bedrooms,
         TRY_CAST(trunc(TRY_CAST(Bathrooms AS DOUBLE)) AS INTEGER) AS bathrooms
  FROM raw_buy WHERE NOT contains(lower(Address), 'france')),
buy_parsed AS (
  SELECT *, NULLIF(regexp_extract(address, '{_PROV_RX}', 1), '') AS province,
         CASE WHEN trim(split_part(address, ',', 2)) IN ({_in_list(DISTRICTS)})
              THEN trim(split_part(address, ',', 2)) END AS district,
         trim(split_part(address, ',', 1)) AS city
  FROM buy_clean),
buy_prov AS (SELECT * FROM buy_parsed WHERE province IS NOT NULL)
"""


def _night_case(col: str = "Address") -> str:
    parts = " ".join(f"WHEN contains({col}, '{n}') THEN '{V.NIGHT_ALIASES.get(n, n)}'"
                     for n in V.NIGHT_REGIONS)
    return f"CASE {parts} END"


# ============================ market rollups ======================================

@query("rollup_price_by_province", with_views("listing") + _stats_sql("listing", "province"))
def q_rollup_price_by_province(spark, d):
    return R.market_stats(_listing(spark, d, False), "province", bounded_keys=True)


@query("rollup_price_by_district", with_views("listing", "coords") +
       f"SELECT s.*, c.latitude, c.longitude FROM ({_stats_sql('listing', 'district')}) s "
       f"JOIN coords c USING (district)")
def q_rollup_price_by_district(spark, d):
    t = Tables(spark, d)
    return R.attach_coords(district_rollup(spark, d), V.coords(t), "district", "inner").orderBy("district")


@query("rollup_price_by_city", with_views("listing") + _stats_sql("listing", "city"))
def q_rollup_price_by_city(spark, d):
    return R.market_stats(_listing(spark, d, False), "city")


def _rent_parsed(spark, d):
    t = Tables(spark, d)
    return L.priced(L.clean_rent(V.raw_listing(t, "rent")), "rent_year", PROVINCES, DISTRICTS)


@query("rollup_rent_year_by_province", with_views("raw_rent") + _CLEAN_RENT_SQL +
       _stats_sql("rent_prov", "province", prefix="rent", scale=4))
def q_rollup_rent_year_by_province(spark, d):
    return R.market_stats(_rent_parsed(spark, d), "province", "price", "rent", bounded_keys=True,
                          materialize=True)


@query("rollup_rent_year_by_district", with_views("raw_rent", "coords") + _CLEAN_RENT_SQL +
       f"SELECT s.*, c.latitude, c.longitude FROM ("
       f"{_stats_sql('rent_prov', 'district', prefix='rent', scale=4)}"
       f") s LEFT JOIN coords c USING (district)")
def q_rollup_rent_year_by_district(spark, d):
    t = Tables(spark, d)
    r = R.market_stats(_rent_parsed(spark, d), "district", "price", "rent", bounded_keys=True,
                       materialize=True)
    return R.attach_coords(r, V.coords(t), "district", "left").orderBy("district")


@query("rollup_rent_year_by_city", with_views("raw_rent") + _CLEAN_RENT_SQL +
       _stats_sql("rent_prov", "city", prefix="rent", scale=4))
def q_rollup_rent_year_by_city(spark, d):
    return R.market_stats(_rent_parsed(spark, d), "city", "price", "rent", materialize=True)


@query("rollup_rent_year_levels", with_views("raw_rent") + _CLEAN_RENT_SQL +
       " UNION ALL ".join(f"SELECT '{lv}' AS level, s.* FROM ({_stats_sql('rent_prov', lv, prefix='rent', out_key='key', scale=4)}) s"
                          for lv in ("province", "district", "city")))
def q_rollup_rent_year_levels(spark, d):
    """The three yearly-rent rollups from text parsed once."""
    return R.market_stats_levels(_rent_parsed(spark, d), ["province", "district", "city"], prefix="rent", materialize=True)


def _night(spark, d):
    t = Tables(spark, d)
    return L.night_provinces(V.night_listing(t), V.NIGHT_REGIONS, V.NIGHT_ALIASES)


@query("rollup_rent_night_by_province", with_views("night") +
       f", np AS (SELECT *, {_night_case()} AS province FROM night) " +
       _stats_sql("np", "province", "rent_night", "rent", scale=4))
def q_rollup_rent_night_by_province(spark, d):
    return R.market_stats(_night(spark, d), "province", "rent_night", "rent", bounded_keys=True,
                          materialize=True)


@query("rollup_rent_night_other", with_views("night") +
       f", np AS (SELECT *, {_night_case()} AS province FROM night WHERE ({_night_case()}) IS NULL) " +
       _stats_sql("np", "Address", "rent_night", "rent", out_key="address", scale=4))
def q_rollup_rent_night_other(spark, d):
    n = _night(spark, d).where(F.col("province").isNull())
    return R.market_stats(n, "Address", "rent_night", "rent", out_key="address",
                          materialize=True)


@query("market_comparison", with_views("listing") + f"""
SELECT district, round(median(price), 4) AS median_price,
       round(median(price / NULLIF(CAST(size_m2 AS DOUBLE), 0)), 4) AS median_sqm_price,
       round(median(CAST(size_m2 AS DOUBLE)), 4) AS median_size_m2,
       CAST(count(*) AS BIGINT) AS number_of_listings,
       round(quantile_cont(price, 0.1), 4) AS price_p10, round(quantile_cont(price, 0.9), 4) AS price_p90,
       round(median(CAST(bedrooms AS DOUBLE)), 4) AS median_bedrooms
FROM listing WHERE district IN ({_in_list(COMPARE)}) GROUP BY district""")
def q_market_comparison(spark, d):
    from plotline.functions.text import split_param_list
    return R.market_comparison(_listing(spark, d), split_param_list(COMPARE_PARAM))


@query("rollup_price_levels", with_views("listing") +
       " UNION ALL ".join(f"SELECT '{lv}' AS level, s.* FROM ({_stats_sql('listing', lv, out_key='key')}) s"
                          for lv in ("province", "district", "city")))
def q_rollup_price_levels(spark, d):
    """The province, district and city rollups of one listing table in a single plan
    (grouping sets: one scan pair instead of three)."""
    return R.market_stats_levels(_listing(spark, d, False), ["province", "district", "city"])


# ============================ dashboard ===========================================

_DSTATS = f", d AS ({_stats_sql('listing', 'district')})\n"


@query("kpi_cards", with_views("listing", "transactions") + _DSTATS + """
, t AS (SELECT city, CAST(sum(transaction_number) AS BIGINT) AS s FROM transactions GROUP BY city)
SELECT (SELECT district FROM d WHERE max_price IS NOT NULL ORDER BY max_price DESC, district LIMIT 1) AS region_max,
       (SELECT max(max_price) FROM d) AS max_num,
       (SELECT district FROM d WHERE min_price IS NOT NULL ORDER BY min_price, district LIMIT 1) AS region_min,
       (SELECT min(min_price) FROM d) AS min_num,
       (SELECT CAST(sum(listings_count) AS BIGINT) FROM d) AS sum_num,
       (SELECT city FROM t ORDER BY s DESC, city LIMIT 1) AS region_tran,
       (SELECT s FROM t ORDER BY s DESC, city LIMIT 1) AS high_num""")
def q_kpi_cards(spark, d):
    return R.kpi_cards(district_extremes(spark, d), V.transactions(Tables(spark, d)))


@query("count_by_type", with_views("listing") +
       "SELECT type AS name, CAST(count(*) AS BIGINT) AS value FROM listing GROUP BY type")
def q_count_by_type(spark, d):
    return R.count_by_type(_listing(spark, d))


@query("agg_sum_global", with_views("listing") + _DSTATS +
       "SELECT CAST(sum(listings_count) AS BIGINT) AS total_listings FROM d")
def q_agg_sum_global(spark, d):
    return R.agg_sum_global(district_extremes(spark, d), "listings_count", "total_listings")


@query("agg_sum_by_city", with_views("transactions") +
       "SELECT city, CAST(sum(transaction_number) AS BIGINT) AS total_transactions FROM transactions GROUP BY city")
def q_agg_sum_by_city(spark, d):
    return R.agg_sum_by_key(V.transactions(Tables(spark, d)), "city", "transaction_number", "total_transactions")


@query("top1_max", with_views("listing") + _DSTATS +
       "SELECT district, max_price FROM d ORDER BY max_price DESC NULLS LAST, district LIMIT 1")
def q_top1_max(spark, d):
    return R.top_n(district_extremes(spark, d), "max_price", 1, True, ["district"]).select("district", "max_price")


@query("top1_min", with_views("listing") + _DSTATS +
       "SELECT district, min_price FROM d ORDER BY min_price ASC NULLS LAST, district LIMIT 1")
def q_top1_min(spark, d):
    return R.top_n(district_extremes(spark, d), "min_price", 1, False, ["district"]).select("district", "min_price")


@query("top20_districts", with_views("listing") + _DSTATS +
       f"SELECT * FROM d ORDER BY max_price DESC NULLS LAST, district LIMIT {K.TOP_DISTRICTS}")
def q_top20_districts(spark, d):
    return R.top_n(district_rollup(spark, d), "max_price", K.TOP_DISTRICTS, True, ["district"])


_PROPS_SQL = ", props AS (SELECT l.*, c.latitude, c.longitude FROM listing l JOIN coords c USING (district) WHERE type IS NOT NULL)\n"


def _props(spark, d):
    t = Tables(spark, d)
    return R.attach_coords(_listing(spark, d), V.coords(t), "district", "inner").where(F.col("type").isNotNull())


@query("page_range", with_views("listing", "coords") + _PROPS_SQL + f"""
SELECT listing_id, city, province, type, price, size_m2, bedrooms, bathrooms,
       CASE WHEN size_m2 > 0 THEN round(price / size_m2, 2) ELSE 0.0 END AS price_per_m2
FROM props ORDER BY type, {V.TIEBREAK_SQL} LIMIT {K.PAGE_LAST_INDEX + 1}""")
def q_page_range(spark, d):
    p = R.page_range(_props(spark, d), "type", 0, K.PAGE_LAST_INDEX, V.TIEBREAK)
    return p.select("listing_id", "city", "province", "type", "price", "size_m2", "bedrooms", "bathrooms",
                    price_per_m2("price", "size_m2").alias("price_per_m2"))


@query("sort_price_asc", with_views("raw_buy") + _CLEAN_BUY_SQL +
       "SELECT listing_id, address, price FROM buy_clean ORDER BY price ASC NULLS LAST, listing_id, address")
def q_sort_price_asc(spark, d):
    """Listings from the cheapest up; those without a price last."""
    clean = L.clean_buy(V.raw_listing(Tables(spark, d), "buy"))
    return clean.select("listing_id", "address", "price").orderBy(
        F.col("price").asc_nulls_last(), "listing_id", "address")


@query("hot_areas", with_views("listing", "coords") + _DSTATS +
       f"SELECT district, listings_count, latitude, longitude FROM d JOIN coords USING (district) "
       f"WHERE listings_count > {HOT_MIN}")
def q_hot_areas(spark, d):
    r = R.attach_coords(district_extremes(spark, d), V.coords(Tables(spark, d)), "district", "inner")
    return R.filter_gt(r, "listings_count", HOT_MIN).select("district", "listings_count", "latitude", "longitude")


@query("city_circles", with_views("listing", "coords") + _DSTATS + """
SELECT district, listings_count, latitude, longitude,
       CASE WHEN listings_count <= 100 THEN 1400 WHEN listings_count <= 500 THEN 2000
            WHEN listings_count <= 1000 THEN 3000 WHEN listings_count <= 2000 THEN 4000 ELSE 7000 END AS radius
FROM d JOIN coords USING (district) WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def q_city_circles(spark, d):
    r = R.attach_coords(district_extremes(spark, d), V.coords(Tables(spark, d)), "district", "inner")
    return (r.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .select("district", "listings_count", "latitude", "longitude",
                    radius_bucket("listings_count", K.RADIUS_STEPS, K.RADIUS_DEFAULT, K.RADIUS_SCALE)
                    .alias("radius")))


@query("max_listings_district", with_views("listing") + _DSTATS +
       "SELECT (SELECT district FROM d ORDER BY listings_count DESC, district LIMIT 1) AS district_most, "
       "(SELECT max(listings_count) FROM d) AS max_listings_count")
def q_max_listings_district(spark, d):
    return R.max_by_key(district_extremes(spark, d), "district", "listings_count", "district_most")


@query("max_price_per_m2", with_views("listing") +
       "SELECT max(CASE WHEN size_m2 > 0 THEN round(price / size_m2, 2) ELSE 0.0 END) AS max_price_per_m2 FROM listing")
def q_max_price_per_m2(spark, d):
    return _listing(spark, d).agg(F.max(price_per_m2("price", "size_m2")).alias("max_price_per_m2"))


@query("first_per_city", with_views("listing") + f"""
SELECT city, listing_id, size_m2, price FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY size_m2 DESC, price ASC NULLS FIRST, {V.TIEBREAK_SQL}) AS rn
  FROM listing) WHERE rn = 1""")
def q_first_per_city(spark, d):
    return R.first_per_key(_listing(spark, d), "city",
                           [-F.col("size_m2"), F.col("price")] + [F.col(c) for c in V.TIEBREAK],
                           ["listing_id", "size_m2", "price"])


@query("dedupe_by_key", with_views("listing") + f"""
SELECT listing_id, city, price, suppkey, partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {V.TIEBREAK_SQL}) AS rn FROM listing) WHERE rn = 1""")
def q_dedupe_by_key(spark, d):
    lst = _listing(spark, d, False).select("listing_id", "city", "price", *V.TIEBREAK[1:])
    return R.dedupe_by_key(lst, "listing_id", [F.col(c) for c in V.TIEBREAK[1:]]).select(
        "listing_id", "city", "price", "suppkey", "partkey")


@query("chart_projection", with_views("listing") +
       f"SELECT province AS name, median_price, avg_price, min_price FROM ({_stats_sql('listing', 'province')}) "
       f"UNION ALL SELECT district, median_price, avg_price, min_price FROM ({_stats_sql('listing', 'district')})")
def q_chart_projection(spark, d):
    # One scan pair for both levels (grouping sets) instead of one per rollup.
    both = R.market_stats_levels(_listing(spark, d, False), ["province", "district"], bounded_keys=True)
    return both.select(F.col("key").alias("name"), "median_price", "avg_price", "min_price")


# ============================ listing ETL =========================================

@query("listing_clean_buy", with_views("raw_buy") + _CLEAN_BUY_SQL +
       "SELECT listing_id, address, type, price, size_m2, bedrooms, bathrooms FROM buy_clean")
def q_listing_clean_buy(spark, d):
    return L.clean_buy(V.raw_listing(Tables(spark, d), "buy"))


@query("listing_clean_rent", with_views("raw_rent") + _CLEAN_RENT_SQL +
       "SELECT listing_id, address, type, price AS rent_year, size_m2, bedrooms, bathrooms FROM rent_clean")
def q_listing_clean_rent(spark, d):
    return L.clean_rent(V.raw_listing(Tables(spark, d), "rent"))


@query("listing_build_properties", with_views("raw_buy", "coords") + _CLEAN_BUY_SQL + """
SELECT listing_id, city, district, province, type, size_m2, COALESCE(bedrooms, 0) AS bedrooms,
       COALESCE(bathrooms, 0) AS bathrooms, price, latitude, longitude
FROM buy_prov JOIN coords USING (district) WHERE type IS NOT NULL""")
def q_listing_build_properties(spark, d):
    t = Tables(spark, d)
    p = L.priced(L.clean_buy(V.raw_listing(t, "buy")), "price", PROVINCES, DISTRICTS)
    return L.build_properties(p, V.coords(t)).select(
        "listing_id", "city", "district", "province", "type", "size_m2", "bedrooms", "bathrooms",
        "price", "latitude", "longitude")


# Names lose the suffix of their own level only; room text counts when it is a number.
_ID_SQL = """
, names AS (SELECT id, arg_max(name_en, seq) AS name FROM location_dim GROUP BY id)
, resolved AS (
  SELECT i.listing_id, i.Title AS title,
         COALESCE(c.name, '') || ', ' || COALESCE(replace(dn.name, ' district', ''), '') || ', '
           || COALESCE(replace(p.name, ' Governorate', ''), '') AS address,
         i.Price AS price, i.Area_sqm AS size_m2, TRY_CAST(i.Bedroom AS DOUBLE) AS bed,
         TRY_CAST(i.Bathroom AS DOUBLE) AS bath, i.Furnished AS furnished
  FROM id_listing i
  LEFT JOIN names p ON p.id = 'p' || CAST(i.ProvinceID AS VARCHAR)
  LEFT JOIN names dn ON dn.id = 'd' || CAST(i.DistrictID AS VARCHAR)
  LEFT JOIN names c ON c.id = 'c' || CAST(i.CommunityID AS VARCHAR))
"""


@query("listing_resolve_location", with_views("id_listing", "location_dim") + _ID_SQL + """
SELECT listing_id, title, address, price, size_m2,
       regexp_replace(CAST(bed AS VARCHAR), '\\.0$', '') AS bedrooms,
       regexp_replace(CAST(bath AS VARCHAR), '\\.0$', '') AS bathrooms, furnished FROM resolved""")
def q_listing_resolve_location(spark, d):
    t = Tables(spark, d)
    return L.resolve_location(V.id_listing(t), V.location_dim(t))


_SOURCES_SQL = with_views("raw_buy", "id_listing", "location_dim", "coords") + _CLEAN_BUY_SQL + _ID_SQL + """
, sources AS (
  SELECT listing_id, address, type, price, size_m2, bedrooms, bathrooms, 'html' AS source FROM buy_clean
  UNION ALL BY NAME
  SELECT listing_id, title, address, price, CAST(size_m2 AS DOUBLE) AS size_m2, CAST(bed AS INTEGER) AS bedrooms,
         CAST(bath AS INTEGER) AS bathrooms, furnished, 'json' AS source FROM resolved)
"""


def _sources(spark, d) -> DataFrame:
    """Both cleaned listing sources, stacked by column name: ``title`` and ``furnished``
    exist only in the JSON source, ``type`` only in the HTML one; elsewhere they are NULL."""
    t = Tables(spark, d)
    a = L.clean_buy(V.raw_listing(t, "buy")).withColumn("source", F.lit("html"))
    b = (L.resolve_location(V.id_listing(t), V.location_dim(t))
         .withColumns({"size_m2": F.col("size_m2").cast("double"), "bedrooms": clean_room_count("bedrooms"),
                       "bathrooms": clean_room_count("bathrooms"), "source": F.lit("json")}))
    return L.union_sources(a, b)


@query("union_sources", _SOURCES_SQL + "SELECT * FROM sources")
def q_union_sources(spark, d):
    return _sources(spark, d)


# Raw text of both sources to the three sale rollups: stack, parse, keep what has a province, roll up.
_SALE_SQL = _SOURCES_SQL + f"""
, sale AS (
  SELECT *, NULLIF(regexp_extract(address, '{_PROV_RX}', 1), '') AS province,
         CASE WHEN trim(split_part(address, ',', 2)) IN ({_in_list(DISTRICTS)})
              THEN trim(split_part(address, ',', 2)) END AS district,
         trim(split_part(address, ',', 1)) AS city
  FROM sources)
, sale_prov AS (SELECT * FROM sale WHERE province IS NOT NULL)
"""


def _sale_rollup(spark, d, key: str, bounded: bool) -> DataFrame:
    sale = L.priced(_sources(spark, d), "price", PROVINCES, DISTRICTS)
    return R.market_stats(sale, key, bounded_keys=bounded, materialize=True)


@query("sale_rollup_by_province", _SALE_SQL + _stats_sql("sale_prov", "province"))
def q_sale_rollup_by_province(spark, d):
    return _sale_rollup(spark, d, "province", True)


@query("sale_rollup_by_district", _SALE_SQL + f"SELECT * FROM ({_stats_sql('sale_prov', 'district')}) "
       "JOIN coords USING (district)")
def q_sale_rollup_by_district(spark, d):
    return R.attach_coords(_sale_rollup(spark, d, "district", True), V.coords(Tables(spark, d)))


@query("sale_rollup_by_city", _SALE_SQL + _stats_sql("sale_prov", "city"))
def q_sale_rollup_by_city(spark, d):
    return _sale_rollup(spark, d, "city", False)


@query("sale_rollup_levels", _SALE_SQL +
       " UNION ALL ".join(f"SELECT '{lv}' AS level, s.* FROM ({_stats_sql('sale_prov', lv, out_key='key')}) s"
                          for lv in ("province", "district", "city")))
def q_sale_rollup_levels(spark, d):
    """The three sale rollups of both sources from text parsed once."""
    return R.market_stats_levels(L.priced(_sources(spark, d), "price", PROVINCES, DISTRICTS),
                                 ["province", "district", "city"], materialize=True)


@query("province_extraction", with_views("night") +
       f"SELECT listing_id, NULLIF(regexp_extract(Address, '(AFRICA|AMERICA|ASIA|EUROPE|MIDDLE EAST|MIDEAST)', 1), '') AS leftmost, "
       f"{_night_case()} AS priority FROM night")
def q_province_extraction(spark, d):
    from plotline.functions.text import extract_by_priority, extract_first_match
    n = V.night_listing(Tables(spark, d))
    return n.select("listing_id", extract_first_match("Address", V.NIGHT_REGIONS).alias("leftmost"),
                    extract_by_priority("Address", V.NIGHT_REGIONS, V.NIGHT_ALIASES).alias("priority"))


@query("canonical_city", with_views("transactions") + f"""
SELECT DISTINCT city, CASE {' '.join(f"WHEN contains(lower(city), '{a}') THEN '{b}'" for a, b in CITY_NEEDLES)}
       ELSE lower(city) END AS canonical FROM transactions""")
def q_canonical_city(spark, d):
    tr = V.transactions(Tables(spark, d))
    return tr.select("city").distinct().select("city", canonical_contains_ci("city", CITY_NEEDLES).alias("canonical"))


@query("contains_arabic", "SELECT doc_id, lang, regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AS has_arabic FROM documents")
def q_contains_arabic(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", "lang", contains_arabic("text").alias("has_arabic"))


# ============================ transaction series ==================================

@query("join_series_inner", with_views("series_counts", "series_values") +
       "SELECT Date AS date, City AS city, Transaction_Number AS transaction_number, "
       "Transaction_Value AS transaction_value FROM series_counts JOIN series_values USING (Date, City)")
def q_join_series_inner(spark, d):
    t = Tables(spark, d)
    j = S.join_series(V.series_counts(t), V.series_values(t))
    return j.select(F.col("Date").alias("date"), F.col("City").alias("city"),
                    F.col("Transaction_Number").alias("transaction_number"),
                    F.col("Transaction_Value").alias("transaction_value"))


@query("join_series_trimmed", with_views("series_counts", "series_values") +
       "SELECT c.Date AS date, trim(c.City) AS city, c.Transaction_Number AS transaction_number, "
       "v.Transaction_Value AS transaction_value FROM series_counts c JOIN series_values v "
       "ON c.Date = v.Date AND trim(c.City) = trim(v.City)")
def q_join_series_trimmed(spark, d):
    t = Tables(spark, d)
    j = S.join_series(V.series_counts(t), V.series_values(t), trim_keys=True)
    return j.select(F.col("Date").alias("date"), F.col("City").alias("city"),
                    F.col("Transaction_Number").alias("transaction_number"),
                    F.col("Transaction_Value").alias("transaction_value"))


def _order_rows(spark, d):
    t = Tables(spark, d)
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    return (t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
            .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("city"),
                    F.date_format("o_orderdate", "MM/yyyy").alias("date_text"),
                    F.when(F.col("o_orderkey") % 17 == 0, F.lit("n/a"))
                     .otherwise(F.col("o_totalprice").cast("string")).alias("value_text")))


@query("monthly_total_by_city", """
WITH o AS (SELECT n.n_name AS city, strftime(o_orderdate, '%m/%Y') AS date_text,
                  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS value_text
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey)
SELECT city, CAST(strptime(date_text, '%m/%Y') AS DATE) AS month,
       CAST(sum(COALESCE(TRY_CAST(value_text AS DECIMAL(38,3)), 0)) AS DOUBLE) AS total_value
FROM o GROUP BY 1, 2""")
def q_monthly_total_by_city(spark, d):
    return S.monthly_total_by_city(_order_rows(spark, d), "city", "date_text", "value_text", "MM/yyyy")


@query("yearly_total", with_views("transactions") +
       "SELECT city, CAST(year(month) AS INTEGER) AS year, "
       "CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) AS total_value FROM transactions GROUP BY 1, 2")
def q_yearly_total(spark, d):
    return S.yearly_total(V.transactions(Tables(spark, d)), "city", "month", "transaction_value")


_MED_SQL = (f"SELECT city, " + ", ".join(
    f"median(transaction_value) FILTER (WHERE year(month) = {y}) AS median_price_{y}" for y in TREND_YEARS) +
    f" FROM transactions WHERE year(month) IN ({', '.join(map(str, TREND_YEARS))}) GROUP BY city")


@query("median_by_city_year", with_views("transactions") +
       f"SELECT city, " + ", ".join(f"round(median_price_{y}, 4) AS median_price_{y}" for y in TREND_YEARS) +
       f" FROM ({_MED_SQL})")
def q_median_by_city_year(spark, d):
    m = S.medians_by_city_year(V.transactions(Tables(spark, d)), "city", "month", "transaction_value",
                               list(TREND_YEARS))
    return m.select("city", *[round_to(f"median_price_{y}", 4).alias(f"median_price_{y}") for y in TREND_YEARS])


@query("city_price_trend", with_views("transactions", "coords") + f"""
, m AS ({_MED_SQL}), p AS (
  SELECT city, (median_price_{TREND_YEARS[1]} - median_price_{TREND_YEARS[0]}) / NULLIF(median_price_{TREND_YEARS[0]}, 0) * 100 AS pct,
         median_price_{TREND_YEARS[1]} AS cur
  FROM m WHERE median_price_{TREND_YEARS[0]} IS NOT NULL AND median_price_{TREND_YEARS[1]} IS NOT NULL)
SELECT p.city, CASE WHEN pct > 0.5 THEN 'up' WHEN pct < -0.5 THEN 'down' ELSE 'neutral' END AS direction,
       round(pct, 2) AS change_percent, round(cur, 4) AS current_price, c.latitude, c.longitude
FROM p JOIN coords c ON trim(p.city) = trim(c.district)""")
def q_city_price_trend(spark, d):
    t = Tables(spark, d)
    m = S.medians_by_city_year(V.transactions(t), "city", "month", "transaction_value", list(TREND_YEARS))
    out = S.city_price_trend(m, TREND_YEARS[0], TREND_YEARS[1], V.coords(t).withColumnRenamed("district", "city"))
    return out.withColumn("current_price", round_to("current_price", 4))


_SCEN_SQL = with_views("transactions") + ", " + V.rates_sql() + f"""
, s AS (SELECT city, month AS date, transaction_value AS price, year(month) AS y FROM transactions)
, st AS (SELECT city, y, arg_min(price, date) AS start FROM s GROUP BY city, y)
, x AS (SELECT s.*, st.start, sc.scenario, lower(sc.scenario) AS scl FROM s JOIN st USING (city, y)
        CROSS JOIN (VALUES ('Baseline'), ('Boom'), ('Crash')) sc(scenario))
, r AS (SELECT x.*, COALESCE(o.annual_rate, dr.annual_rate) AS rate FROM x
        LEFT JOIN rates o ON o.year = x.y AND o.city = x.city AND o.scenario = x.scl
        LEFT JOIN rates dr ON dr.year = x.y AND dr.city = '{DEFAULT_RATE_CITY}' AND dr.scenario = x.scl)
, proj AS (SELECT city, date, scenario,
       CASE WHEN scenario = 'Baseline' OR rate IS NULL THEN price
            ELSE price + (start * pow(pow(1 + rate, 1.0 / 12), month(date) - 1) - start) END AS transaction_value
       FROM r)
"""


def _projection(spark, d):
    t = Tables(spark, d)
    tr = V.transactions(t)
    return S.scenario_projection(tr, V.rates(spark), DEFAULT_RATE_CITY, date="month", value="transaction_value")


@query("scenario_projection", _SCEN_SQL +
       "SELECT city, date, scenario, round(transaction_value, 4) AS transaction_value FROM proj")
def q_scenario_projection(spark, d):
    return _projection(spark, d).withColumn("transaction_value", round_to("transaction_value", 4))


# Selection labels of the scenario page, re-keyed to the driver's nations.
SCENARIO_LABELS = [("NATION_2, NATION_7", "NATION_2"), ("NATION_3, NATION_13", "NATION_3"),
                   ("NATION_4, NATION_9", "NATION_4")]
SCENARIO_SELECTION = "NATION_3, NATION_13"


@query("scenario_selection", _SCEN_SQL +
       "SELECT city, date, scenario, round(transaction_value, 4) AS transaction_value FROM proj "
       "WHERE city = 'NATION_3'")
def q_scenario_selection(spark, d):
    """The page's request: a region label is mapped to its series city (exact,
    case-sensitive containment; otherwise the label itself), then the baseline and
    scenario rows of that city are returned."""
    from plotline.functions.text import canonical_contains
    # The request label is a parameter: map it once, then filter with a literal so the
    # predicate is pushed below the monthly aggregation.
    city = spark.range(1).select(canonical_contains(F.lit(SCENARIO_SELECTION), SCENARIO_LABELS)).first()[0]
    p = _projection(spark, d).where(F.col("city") == city)
    return p.select("city", "date", "scenario", round_to("transaction_value", 4).alias("transaction_value"))


@query("pivot_scenarios", _SCEN_SQL + """
SELECT city, date,
  round(max(CASE WHEN scenario = 'Baseline' THEN NULLIF(transaction_value, 0) END), 4) AS baseline,
  round(max(CASE WHEN scenario = 'Boom' THEN NULLIF(transaction_value, 0) END), 4) AS boom,
  round(max(CASE WHEN scenario = 'Crash' THEN NULLIF(transaction_value, 0) END), 4) AS crash
FROM proj GROUP BY city, date""")
def q_pivot_scenarios(spark, d):
    p = S.pivot_scenarios(_projection(spark, d))
    return p.select("city", "date", *[round_to(c, 4).alias(c) for c in ("baseline", "boom", "crash")])


@query("future_spine", with_views("transactions") + f"""
, l AS (SELECT city, max(month) AS last, count(*) AS n FROM transactions GROUP BY city)
SELECT city, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS date, CAST(n + k - 1 AS BIGINT) AS time_index
FROM l, range(1, {K.FORECAST_HORIZON_MONTHS + 1}) r(k)""")
def q_future_spine(spark, d):
    return S.future_spine(V.transactions(Tables(spark, d)), K.FORECAST_HORIZON_MONTHS)


@query("time_index_series", with_views("transactions") +
       "SELECT city, month, CAST(row_number() OVER (PARTITION BY city ORDER BY month) - 1 AS BIGINT) AS time_index "
       "FROM transactions")
def q_time_index_series(spark, d):
    return S.time_index_series(V.transactions(Tables(spark, d))).select("city", "month", "time_index")


@query("time_index_global", with_views("transactions") +
       "SELECT city, month, CAST(row_number() OVER (ORDER BY month, city) - 1 AS BIGINT) AS time_index "
       "FROM transactions")
def q_time_index_global(spark, d):
    return S.time_index_global(V.transactions(Tables(spark, d))).select("city", "month", "time_index")


@query("time_index_by_day", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) "
       "AS time_index FROM orders")
def q_time_index_by_day(spark, d):
    """The global index over a table that grows with the data."""
    orders = Tables(spark, d).orders.select("o_orderkey", "o_orderdate")
    return S.time_index_global(orders, "o_orderkey", "o_orderdate").select("o_orderkey", "time_index")


@query("label_encode", with_views("listing") + """
SELECT listing_id, city, CAST(dense_rank() OVER (ORDER BY city) - 1 AS BIGINT) AS city_code,
       CAST(dense_rank() OVER (ORDER BY district) - 1 AS BIGINT) AS district_code FROM listing""")
def q_label_encode(spark, d):
    from plotline.operators import ordering as O
    rows = _listing(spark, d).select("listing_id", "city", "district")
    return O.label_encode(rows, {c: O.dense_codes(rows, c) for c in ("city", "district")}).select(
        "listing_id", "city", "city_code", "district_code")


#: Levels that get a column each; small enough that the test tables hold rarer ones too.
ONE_HOT_WIDTH = 8


@query("one_hot_indices", with_views("listing") + f"""
, fit AS (SELECT * FROM listing WHERE province <> 'ASIA'),
c AS (SELECT city, CAST(row_number() OVER (ORDER BY city) - 1 AS BIGINT) AS i FROM (
    SELECT city FROM fit GROUP BY city ORDER BY count(*) DESC, city LIMIT {ONE_HOT_WIDTH})),
p AS (SELECT province, CAST(row_number() OVER (ORDER BY province) - 1 AS BIGINT) AS i FROM (
    SELECT province FROM fit GROUP BY province ORDER BY count(*) DESC, province LIMIT {ONE_HOT_WIDTH}))
SELECT listing_id, i AS "index" FROM listing JOIN c USING (city)
UNION ALL SELECT listing_id, {ONE_HOT_WIDTH} + i AS "index" FROM listing JOIN p USING (province)""")
def q_one_hot_indices(spark, d):
    """Levels of all provinces but one, whose rows have none set."""
    from plotline.operators import ordering as O
    rows = _listing(spark, d).select("listing_id", "city", "province")
    fit = rows.where("province <> 'ASIA'")
    levels = {c: O.frequent_levels(fit, c, ONE_HOT_WIDTH) for c in ("city", "province")}
    return O.one_hot_indices(rows, ["listing_id"], levels, ONE_HOT_WIDTH)


@query("mean_by_month", with_views("transactions") +
       "SELECT CAST(month(month) AS INTEGER) AS month, round(CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) / CAST(count(transaction_value) AS DOUBLE), 4) AS monthly_avg "
       "FROM transactions GROUP BY 1")
def q_mean_by_month(spark, d):
    m = S.mean_by_month(V.transactions(Tables(spark, d)), "transaction_value")
    return m.select("month", round_to("monthly_avg", 4).alias("monthly_avg"))


@query("mean_by_city", with_views("transactions") +
       "SELECT city, round(CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) / CAST(count(transaction_value) AS DOUBLE), 4) AS city_avg FROM transactions GROUP BY city")
def q_mean_by_city(spark, d):
    return (V.transactions(Tables(spark, d)).groupBy("city")
            .agg(round_to(money_avg("transaction_value"), 4).alias("city_avg")))


@query("distinct_cities", with_views("transactions") + "SELECT DISTINCT city FROM transactions")
def q_distinct_cities(spark, d):
    return V.transactions(Tables(spark, d)).select("city").distinct()


@query("union_distinct_years", with_views("transactions") + f"""
, l AS (SELECT city, max(month) AS last FROM transactions GROUP BY city)
SELECT DISTINCT y AS year FROM (
  SELECT CAST(year(month) AS INTEGER) AS y FROM transactions
  UNION ALL SELECT CAST(year(last + to_months(CAST(k AS INTEGER))) AS INTEGER) FROM l, range(1, {K.FORECAST_HORIZON_MONTHS + 1}) r(k))""")
def q_union_distinct_years(spark, d):
    tr = V.transactions(Tables(spark, d))
    hist = tr.select(F.year("month").alias("year"))
    fut = S.future_spine(tr, K.FORECAST_HORIZON_MONTHS).select(F.year("date").alias("year"))
    return hist.union(fut).distinct()


@query("filter_ilike", with_views("transactions") +
       "SELECT city, month, transaction_value FROM transactions WHERE city ILIKE 'nation_1%'")
def q_filter_ilike(spark, d):
    """Case-insensitive city match; ``%``/``_`` in the pattern act as wildcards."""
    return V.transactions(Tables(spark, d)).where(F.col("city").ilike("nation_1%")).select(
        "city", "month", "transaction_value")


@query("scenario_records", _SCEN_SQL +
       "SELECT strftime(date, '%Y-%m-%d') AS date, city, round(transaction_value, 4) AS transaction_value, "
       "scenario FROM proj")
def q_scenario_records(spark, d):
    from plotline.sources.sinks import scenario_records
    p = _projection(spark, d).withColumn("transaction_value", round_to("transaction_value", 4))
    return scenario_records(p).select("date", "city", "transaction_value", "scenario")


# FIXED-LIST analogue of the saved forecast column list for the driver tables.
MODEL_COLUMNS = (["time_index", "year", "month", "transaction_value"] +
                 [f"city_nation_{i}" for i in range(5)] + ["city_beirut"])


@query("align_model_columns", with_views("transactions") + f"""
, s AS (SELECT lower(city) AS city, month, transaction_value,
               CAST(row_number() OVER (PARTITION BY city ORDER BY month) - 1 AS BIGINT) AS time_index FROM transactions)
SELECT time_index, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month, transaction_value,
       {", ".join(f"CAST(city = 'nation_{i}' AS INTEGER) AS city_nation_{i}" for i in range(5))},
       0 AS city_beirut
FROM s""")
def q_align_model_columns(spark, d):
    """Dummy-encode the city, then align to the saved column list: levels absent from
    the data are all-zero columns, columns not in the list are dropped."""
    from plotline.operators import projections as P
    tr = V.transactions(Tables(spark, d)).select(F.lower("city").alias("city"), "month", "transaction_value")
    tr = S.time_index_series(tr, "city", "month").withColumns(
        {"year": F.year("month"), "month_n": F.month("month")})
    levels = [f"nation_{i}" for i in range(25)]
    wide = P.one_hot_columns(tr, "city", levels).drop("month").withColumnRenamed("month_n", "month")
    wide = P.drop_if_all_present(wide, ["city", "nonexistent_column"])     # guarded: not dropped
    return P.align_columns(wide, MODEL_COLUMNS)


@query("format_dates", with_views("transactions") + """
SELECT DISTINCT month, strftime(month, '%Y-%m-%d') AS iso, strftime(month, '%b %y') AS mon_yy,
       strftime(month, '%y-%b') AS yy_mon, CAST(strptime(strftime(month, '%y-%b'), '%y-%b') AS DATE) AS parsed,
       CAST(strptime(strftime(month, '%m/%Y'), '%m/%Y') AS DATE) AS parsed_mm_yyyy
FROM transactions""")
def q_format_dates(spark, d):
    """Output formats and the two text encodings of a month, parsed back to a DATE
    (``yy`` pivots like C/pandas: 95 -> 1995, 01 -> 2001)."""
    from plotline.functions import dates as DT
    m = V.transactions(Tables(spark, d)).select("month").distinct()
    return m.select("month", DT.format_iso("month").alias("iso"), DT.format_mon_yy("month").alias("mon_yy"),
                    F.date_format("month", "yy-MMM").alias("yy_mon"),
                    DT.parse_yy_mon(F.date_format("month", "yy-MMM")).alias("parsed"),
                    DT.parse_mm_yyyy(F.date_format("month", "MM/yyyy")).alias("parsed_mm_yyyy"))


@query("sort_multi", with_views("transactions") +
       "SELECT city, month, transaction_value FROM transactions ORDER BY city, month")
def q_sort_multi(spark, d):
    """City, then date order (a range-partitioned global sort)."""
    return V.transactions(Tables(spark, d)).select("city", "month", "transaction_value").orderBy("city", "month")


# ============================ features / evaluation ===============================

_FF_SQL = f"""
, f AS (SELECT lower(city) AS city, month AS date, transaction_value FROM transactions)
SELECT date, city, CAST(row_number() OVER (PARTITION BY city ORDER BY date) - 1 AS BIGINT) AS time_index,
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter,
       round(sin(2 * pi() * month(date) / 12.0), 6) AS month_sin,
       round(cos(2 * pi() * month(date) / 12.0), 6) AS month_cos,
       CAST(month(date) = 12 AS INTEGER) AS is_december,
       CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer,
       CAST(date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end,
       round(CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) OVER (PARTITION BY city, month(date)) AS DOUBLE)
             / CAST(count(transaction_value) OVER (PARTITION BY city, month(date)) AS DOUBLE), 4) AS monthly_avg,
       round(CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) OVER (PARTITION BY city) AS DOUBLE)
             / CAST(count(transaction_value) OVER (PARTITION BY city) AS DOUBLE), 4) AS city_avg,
       CAST(year(date) > {POST_YEAR} AS INTEGER) AS post_{POST_YEAR},
       transaction_value
FROM f"""


@query("forecast_features", with_views("transactions") + _FF_SQL)
def q_forecast_features(spark, d):
    f = FE.forecast_features(V.transactions(Tables(spark, d)), post_year=POST_YEAR)
    return f.withColumns({"month_sin": round_to("month_sin", 6), "month_cos": round_to("month_cos", 6),
                          "monthly_avg": round_to("monthly_avg", 4), "city_avg": round_to("city_avg", 4)})


@query("forecast_baseline_metrics", with_views("transactions") + f"""
, tr AS (SELECT city, month(month) AS m, CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) / CAST(count(transaction_value) AS DOUBLE) AS yhat FROM transactions
         WHERE month < DATE '{SPLIT_DATE}' GROUP BY 1, 2)
, te AS (SELECT t.transaction_value AS y, tr.yhat FROM transactions t JOIN tr ON t.city = tr.city AND month(t.month) = tr.m
         WHERE t.month >= DATE '{SPLIT_DATE}')
SELECT round(avg(abs(yhat - y)), 2) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 2) AS rmse,
       round(avg(abs(yhat - y) / abs(y)) * 100, 4) AS mape,
       round(1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(y)), 4) AS r2
FROM te""")
def q_forecast_baseline_metrics(spark, d):
    tr = V.transactions(Tables(spark, d))
    train = (tr.where(F.col("month") < F.lit(SPLIT_DATE).cast("date"))
             .groupBy("city", F.month("month").alias("_m")).agg(money_avg("transaction_value").alias("y_hat")))
    test = (tr.where(F.col("month") >= F.lit(SPLIT_DATE).cast("date"))
            .withColumn("_m", F.month("month")).join(train, ["city", "_m"])
            .select(F.col("transaction_value").alias("y"), "y_hat"))
    m = FE.regression_metrics(test)
    # mae/rmse are ~1e6 sums of doubles in partition order: 2 decimals; mape/r2: 4
    return m.select(round_to("mae", 2).alias("mae"), round_to("rmse", 2).alias("rmse"),
                    round_to("mape", 4).alias("mape"), round_to("r2", 4).alias("r2"))


_PRICE_FEAT_SQL = with_views("listing", "coords") + _PROPS_SQL + f"""
, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {V.TIEBREAK_SQL}) AS rn FROM props)
           WHERE rn = 1)
, a AS (SELECT listing_id, district, province, city, NULLIF(CAST(bedrooms AS DOUBLE), 0) AS bedrooms,
               NULLIF(CAST(bathrooms AS DOUBLE), 0) AS bathrooms, price, CAST(size_m2 AS DOUBLE) AS size_m2,
               latitude, longitude, price / CAST(size_m2 AS DOUBLE) AS ppm
        FROM once WHERE type = '{PRICE_TYPE}' AND price IS NOT NULL AND size_m2 IS NOT NULL AND size_m2 > 0)
, q AS (SELECT quantile_cont(ppm, {K.TRIM_QUANTILES[0]}) AS lo, quantile_cont(ppm, {K.TRIM_QUANTILES[1]}) AS hi FROM a)
, b AS (SELECT a.*, bedrooms / NULLIF(bathrooms, 0) AS bed_bath_ratio, size_m2 / NULLIF(bedrooms, 0) AS size_per_bedroom
        FROM a, q WHERE ppm >= lo AND ppm <= hi)
, g AS (SELECT district, avg(ppm) AS apd, avg(size_m2) AS asd, count(*) AS dn FROM b GROUP BY district)
"""


def _price_props(spark, d):
    """Properties, each id once (the source drops repeated ids before the features)."""
    return R.dedupe_by_key(_props(spark, d), "listing_id", [F.col(c) for c in V.TIEBREAK[1:]])


@query("price_features", _PRICE_FEAT_SQL + f"""
SELECT listing_id, round(ln(1 + size_m2), 6) AS log_size_m2, bedrooms, bathrooms, latitude, longitude,
       bed_bath_ratio, size_per_bedroom,
       province, CASE WHEN dn < {RARE_MIN} THEN 'Other' ELSE district END AS district, city,
       round(ln(1 + price), 6) AS log_price, ppm AS price_per_m2,
       round(apd, 4) AS avg_price_in_district, round(asd, 4) AS avg_size_in_district
FROM b JOIN g USING (district)""")
def q_price_features(spark, d):
    f = FE.price_features(_price_props(spark, d), PRICE_TYPE, RARE_MIN)
    r6 = ["log_size_m2", "log_price"]
    return f.withColumns({**{c: round_to(c, 6) for c in r6},
                          "avg_price_in_district": round_to("avg_price_in_district", 4),
                          "avg_size_in_district": round_to("avg_size_in_district", 4)})


@query("rare_districts", _PRICE_FEAT_SQL +
       f"SELECT district, CAST(dn AS BIGINT) AS n FROM g WHERE dn < {RARE_MIN}")
def q_rare_districts(spark, d):
    # Rows per district in the trimmed model table, before folding.
    p = _price_props(spark, d)
    f = FE.price_features(p, PRICE_TYPE, rare_min_rows=0)
    return FE.rare_categories(f, "district", RARE_MIN)


_CORR_COLS = ["price", "size_m2", "bedrooms", "bathrooms", "latitude", "longitude", "avg_size_in_district",
              "avg_price_in_district", "price_per_m2", "size_per_bedroom", "bed_bath_ratio"]


@query("correlation_matrix", _PRICE_FEAT_SQL + """
, x AS (SELECT size_m2, bedrooms, bathrooms, latitude, longitude, bed_bath_ratio,
               size_per_bedroom, price, ppm AS price_per_m2,
               apd AS avg_price_in_district, asd AS avg_size_in_district FROM b JOIN g USING (district))
, c AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM x"
                                for a in _CORR_COLS for b in _CORR_COLS) + """)
SELECT col_a, col_b, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS r FROM c""")
def q_correlation_matrix(spark, d):
    """Every pair of the numeric columns of the price-feature table (price and size unlogged)."""
    feats = FE.price_features(_price_props(spark, d), PRICE_TYPE, RARE_MIN)
    return FE.correlation_matrix(feats.withColumns({"price": F.expm1("log_price"), "size_m2": F.expm1("log_size_m2")}),
                                 _CORR_COLS)


# ============================ sessions ============================================

def _turns(spark, d):
    return Tables(spark, d).conversations.select("conv_id", "turn", "role", "text")


# Session queries run on the long turn table (operators/turns.py): grouped
# aggregates only, so no session's messages are gathered into one array or task.
# The array forms (operators/sessions.py) are covered by tests/test_fixtures.py.

@query("session_system_flags", with_views("sessions") +
       "SELECT id, list_bool_or([m.role = 'system' FOR m IN messages]) AS has_system, "
       "CAST(len(messages) AS INTEGER) AS n_messages FROM sessions")
def q_session_system_flags(spark, d):
    from plotline.operators import turns as TU
    return TU.flags(_turns(spark, d))


@query("session_with_system_prompt", with_views("sessions") + f"""
, s2 AS (SELECT id, CASE WHEN list_bool_or([m.role = 'system' FOR m IN messages]) THEN messages
                ELSE list_prepend({{'role': 'system', 'content': '{SYSTEM_PROMPT}'}}, messages) END AS messages
         FROM sessions)
SELECT id, CAST(len(messages) AS INTEGER) AS n_messages, messages[1].role AS first_role,
       messages[1].content AS first_content FROM s2""")
def q_session_with_system_prompt(spark, d):
    from plotline.operators import turns as TU
    s = TU.summary(TU.with_system_prompt(_turns(spark, d), SYSTEM_PROMPT))
    return s.select("id", "n_messages", "first_role", "first_content")


@query("explode_messages", """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role, text
FROM conversations WHERE role <> 'system'""")
def q_explode_messages(spark, d):
    from plotline.operators import turns as TU
    return TU.explode(_turns(spark, d))


@query("latest_session", with_views("sessions") +
       "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM sessions "
       "ORDER BY created_at DESC, id DESC LIMIT 1")
def q_latest_session(spark, d):
    from plotline.operators import turns as TU
    meta = (_turns(spark, d).select("conv_id").distinct()
            .select(F.col("conv_id").alias("id"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp")
                     + F.make_interval(mins=F.col("conv_id").cast("int"))).alias("created_at")))
    return TU.latest(meta).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("session_upsert", with_views("sessions") + """
, new AS (SELECT id, list_concat(messages, [{'role': 'user', 'content': 'next question'},
                                           {'role': 'assistant', 'content': 'next answer'}]) AS messages
          FROM sessions WHERE list_bool_or([m.role = 'system' FOR m IN messages]))
, merged AS (SELECT id, messages FROM new
             UNION ALL SELECT id, messages FROM sessions WHERE id NOT IN (SELECT id FROM new))
SELECT id, CAST(len(messages) AS INTEGER) AS n_messages, messages[len(messages)].role AS last_role,
       messages[len(messages)].content AS last_content FROM merged""")
def q_session_upsert(spark, d):
    from plotline.operators import turns as TU
    t = _turns(spark, d)
    with_sys = TU.flags(t).where("has_system").select(F.col("id").alias("conv_id"))
    new = TU.append_turn(t, with_sys, "next question", "next answer")
    return TU.summary(TU.upsert(t, new)).select("id", "n_messages", "last_role", "last_content")


@query("append_messages", """
WITH s AS (SELECT conv_id, max(turn) AS last, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text, CAST(NULL AS BIGINT) AS prompt_chars FROM conversations
UNION ALL SELECT conv_id, last + 1, 'user', 'How long was this?', NULL FROM s
UNION ALL SELECT conv_id, last + 2, 'assistant', n || ' characters', CASE WHEN conv_id % 3 <> 0 THEN n END FROM s""")
def q_append_messages(spark, d):
    """Every session gets a question and its own reply; two in three replies carry metadata."""
    from plotline.operators import turns as TU
    t = _turns(spark, d)
    n = F.sum(F.char_length("text"))
    meta = F.when(F.col("conv_id") % 3 != 0, F.parse_json(F.to_json(F.struct(F.col("n").alias("prompt_chars")))))
    replies = t.groupBy("conv_id").agg(n.alias("n")).select(
        "conv_id", F.lit("How long was this?").alias("question"),
        F.concat(F.col("n").cast("string"), F.lit(" characters")).alias("reply"), meta.alias("metadata"))
    return TU.append_replies(t, replies).select(
        "conv_id", "turn", "role", "text", F.variant_get("metadata", "$.prompt_chars", "bigint").alias("prompt_chars"))


@query("session_messages", """
SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id IN (SELECT max(conv_id) FROM conversations)""")
def q_session_messages(spark, d):
    """The messages of the newest session (one id, found by a partial maximum)."""
    from plotline.operators import turns as TU
    t = _turns(spark, d)
    return TU.session_messages(t, t.agg(F.max("conv_id").alias("conv_id")))


def _scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid
    from plotline.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_upsert", """
WITH late AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders
              WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY o_custkey),
new AS (SELECT id, v FROM late UNION ALL SELECT -id, v FROM late)
SELECT id, v AS balance FROM new
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM new)""")
def q_sink_upsert(spark, d):
    """Customers written as a keyed table; late orders replace balances and add new keys."""
    from plotline.sources import sinks as SK
    t = Tables(spark, d)
    path = _scratch(spark, "keyed")
    SK.create_keyed_table(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), path, "id", 16)
    late = t.orders.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")) \
        .groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("balance"))
    SK.upsert_keyed_table(late.select(F.explode(F.array(F.col("k"), -F.col("k"))).alias("id"), "balance"), path)
    return SK.read_keyed_table(spark, path)


# ============================ document sources ====================================

@query("page_links", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS arr FROM pages),
e AS (SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS a FROM a)
SELECT page_id, pos, regexp_extract(a, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS href,
       regexp_extract(a, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS label FROM e""")
def q_page_links(spark, d):
    return SRC.page_links(Tables(spark, d).pages)


@query("scan_json_props", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_scan_json_props(spark, d):
    ev = Tables(spark, d).events
    return ev.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("scalar_rounding", with_views("listing") + """
SELECT listing_id, CAST(round_even(price / 100, 0) * 100 AS BIGINT) AS hundreds, CAST(floor(price + 0.5) AS BIGINT) AS half_up,
       round(price, 4) AS back, TRY_CAST(replace(CAST(bedrooms AS VARCHAR) || '+', '+', '') AS INTEGER) AS rooms,
       CAST(strftime(list_date, '%Y-%m-%d') AS DATE) AS listed FROM listing""")
def q_scalar_rounding(spark, d):
    """``round_hundreds``, ``round_half_up``, ``expm1`` of ``log1p``, ``strip_plus``, ``parse_iso``."""
    from plotline.functions.dates import format_iso, parse_iso
    from plotline.functions.numeric import round_half_up, round_hundreds
    from plotline.functions.text import strip_plus
    return _listing(spark, d).select(
        "listing_id", round_hundreds("price").alias("hundreds"), round_half_up("price").alias("half_up"),
        round_to(F.expm1(F.log1p("price")), 4).alias("back"),
        strip_plus(F.concat(F.col("bedrooms").cast("string"), F.lit("+"))).alias("rooms"),
        parse_iso(format_iso("list_date")).alias("listed"))


@query("yearly_totals_aligned", with_views("transactions") + f"""
, h AS (SELECT city, CAST(year(month) AS INTEGER) AS year, round(CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE), 3) AS t
        FROM transactions WHERE month < DATE '{SPLIT_DATE}' GROUP BY ALL),
f AS (SELECT city, CAST(year(month) AS INTEGER) AS year, round(sum(CAST(transaction_value AS DOUBLE)), 3) AS t
      FROM transactions WHERE month >= DATE '{SPLIT_DATE}' GROUP BY ALL)
SELECT city, year, NULLIF(h.t, 0) AS historical, f.t AS forecast FROM h FULL JOIN f USING (city, year)""")
def q_yearly_totals_aligned(spark, d):
    """``yearly_forecast_total`` and ``align_full_outer`` with the later months as forecast."""
    tr = V.transactions(Tables(spark, d))
    later = F.col("month") >= F.lit(SPLIT_DATE).cast("date")
    hist = S.yearly_total(tr.where(~later), "city", "month", "transaction_value")
    fc = S.yearly_forecast_total(tr.where(later), "city", "month", "transaction_value")
    both = S.align_full_outer(hist, fc)
    return both.select("city", "year", round_to("historical", 3).alias("historical"), round_to("forecast", 3).alias("forecast"))


@query("scan_html_listings", with_views("raw_buy") + f"""
SELECT CAST(floor(listing_id / {V.PAGE_IDS}) AS BIGINT) AS page_id, Address, NULLIF(Price, 'N/A') AS Price, Type, Size,
       NULLIF(Bedrooms, 'N/A') AS Bedrooms, NULLIF(Bathrooms, 'N/A') AS Bathrooms FROM raw_buy""")
def q_scan_html_listings(spark, d):
    """Sale listings rendered in the source's markup and read back from the pages."""
    return SRC.scan_html_listings(V.html_pages(Tables(spark, d))).drop("pos")


@query("scan_json_listings", with_views("id_listing") + f"""
SELECT CAST(floor(listing_id / {V.PAGE_IDS}) AS BIGINT) AS page, Title,
       coalesce(CAST(CAST(Price AS DECIMAL(15,2)) AS VARCHAR), '') AS "Price", coalesce(Bedroom, '') AS "Bedroom",
       coalesce(Bathroom, '') AS "Bathroom", coalesce(CAST(Area_sqm AS VARCHAR), '') AS "Area sqm",
       coalesce(Furnished, '') AS "Furnished", coalesce(CAST(DistrictID AS VARCHAR), '') AS "DistrictID",
       coalesce(CAST(ProvinceID AS VARCHAR), '') AS "ProvinceID", coalesce(CAST(CommunityID AS VARCHAR), '') AS "CommunityID"
FROM id_listing""")
def q_scan_json_listings(spark, d):
    return SRC.scan_json_listings(V.json_pages(Tables(spark, d))).drop("item_pos")


@query("scan_json_locations", with_views("location_dim") +
       "SELECT id, '' AS province_id, name_en, '' AS name_ar, '' AS copy_field_en, '' AS copy_field_ar FROM location_dim")
def q_scan_json_locations(spark, d):
    return SRC.scan_json_locations(V.location_pages(Tables(spark, d)))


@query("scan_csv", with_views("raw_buy") + """
SELECT listing_id, Address, NULLIF(Price, 'N/A') AS Price, Type, Size,
       NULLIF(Bedrooms, 'N/A') AS Bedrooms, NULLIF(Bathrooms, 'N/A') AS Bathrooms FROM raw_buy""")
def q_scan_csv(spark, d):
    """Sale listings written as headered CSV, a folder a region, and all folders read as
    one table (``sink_csv``, ``scan_csv``, ``union_region_files``)."""
    from plotline.sources import sinks as SK
    path = _scratch(spark, "csv")
    region = F.pmod("listing_id", F.lit(5)).cast("int")
    SK.write_csv(V.raw_listing(Tables(spark, d)).withColumn("region", region), path, partition_by=["region"])
    return SRC.scan_csv(spark, [f"{path}/region={r}" for r in range(5)], "listing_id bigint, " + SRC.RAW_LISTING_SCHEMA)


@query("join_month_avg", with_views("transactions") + f"""
, l AS (SELECT lower(city) AS city, max(month) AS last, count(*) AS n FROM transactions GROUP BY ALL),
s AS (SELECT city, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS date, CAST(n + k - 1 AS BIGINT) AS time_index
      FROM l, range(1, {K.FORECAST_HORIZON_MONTHS + 1}) r(k)),
m AS (SELECT lower(city) AS city, month(month) AS month, CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) / count(transaction_value) AS v
      FROM transactions GROUP BY ALL),
a AS (SELECT lower(city) AS city, CAST(sum(CAST(transaction_value AS DECIMAL(38,3))) AS DOUBLE) / count(transaction_value) AS v
      FROM transactions GROUP BY ALL)
SELECT s.city, s.date, s.time_index, round(m.v, 4) AS monthly_avg, round(a.v, 4) AS city_avg
FROM s LEFT JOIN m ON s.city = m.city AND month(s.date) = m.month LEFT JOIN a ON s.city = a.city""")
def q_join_month_avg(spark, d):
    """Serving-time features of the forecast: the spine with its city's monthly means."""
    from plotline.operators import models as M
    f = M.serving_features(V.transactions(Tables(spark, d)), post_year=POST_YEAR)
    return f.select("city", "date", "time_index", round_to("monthly_avg", 4).alias("monthly_avg"),
                    round_to("city_avg", 4).alias("city_avg"))


@query("impute_standardize", with_views("listing") + """
, m AS (SELECT median(price) AS mp, median(CAST(CASE WHEN bathrooms > 0 THEN bathrooms END AS DOUBLE)) AS mb FROM listing),
x AS (SELECT listing_id, coalesce(price, mp) AS p, coalesce(CASE WHEN bathrooms > 0 THEN bathrooms END, mb) AS b, type
      FROM listing, m),
s AS (SELECT avg(p) AS ap, stddev_pop(p) AS sp, avg(b) AS ab, stddev_pop(b) AS sb FROM x),
t AS (SELECT type FROM listing WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)
SELECT listing_id, round((p - ap) / sp, 6) AS price, round((b - ab) / sb, 6) AS bathrooms,
       coalesce(x.type, (SELECT type FROM t)) AS type FROM x, s""")
def q_impute_standardize(spark, d):
    """``impute_median``, ``impute_mode`` and ``standardize``, fitted on the listings."""
    from plotline.operators import models as M
    lst = _listing(spark, d).select("listing_id", "price", "type", F.when(F.col("bathrooms") > 0, F.col("bathrooms")).alias("bathrooms"))
    made = M.Preparation.fit(lst, ["price", "bathrooms"], ["type"]).apply(lst)
    return made.select("listing_id", round_to("n_price", 6).alias("price"), round_to("n_bathrooms", 6).alias("bathrooms"),
                       F.col("c_type").alias("type"))


# ============================ models (rows-only checks) ===========================
# Fitted trees have no SQL; tests/test_boosting.py holds them against a written-out brute
# force.  The features and metrics feeding them are oracle-checked above.

_FITS: dict = {}


def _fitted(spark, d, name: str, fit):
    """A model is fitted once a session and folder."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _FITS:
        _FITS[at] = fit()
    return _FITS[at]


def _forecast_model(spark, d):
    from plotline.operators import models as M
    tr = V.transactions(Tables(spark, d))

    def fit():
        return M.fit_forecast(FE.forecast_features(tr, post_year=POST_YEAR), SPLIT_DATE, POST_YEAR)
    return tr, _fitted(spark, d, "forecast", fit)


@query("forecast_city")
def q_forecast_city(spark, d):
    from plotline.operators import models as M
    tr, (model, _) = _forecast_model(spark, d)
    return M.forecast_report(tr, model, POST_YEAR)


@query("forecast_monthly")
def q_forecast_monthly(spark, d):
    from plotline.operators import models as M
    tr, (model, _) = _forecast_model(spark, d)
    return M.forecast_cities(tr, model, post_year=POST_YEAR)


@query("forecast_validation_metrics")
def q_forecast_validation_metrics(spark, d):
    _, (_, metrics) = _forecast_model(spark, d)
    return metrics


def _price_model(spark, d):
    from plotline.operators import models as M
    return _fitted(spark, d, "price", lambda: M.fit_price(FE.price_features(_price_props(spark, d), PRICE_TYPE, RARE_MIN)))


@query("price_model_metrics")
def q_price_model_metrics(spark, d):
    return _price_model(spark, d)[1]


@query("estimate_price")
def q_estimate_price(spark, d):
    from plotline.operators import models as M
    req = _props(spark, d).where(F.col("type") == PRICE_TYPE).select(
        "listing_id", "province", "district", "city", "size_m2", "bedrooms", "bathrooms", "latitude", "longitude")
    return M.estimate_price(_price_model(spark, d)[0], req)


@query("feature_importance")
def q_feature_importance(spark, d):
    from plotline.operators import models as M
    return M.feature_importance(spark, _price_model(spark, d)[0].trees)


@query("predict_property")
def q_predict_property(spark, d):
    from plotline.operators import models as M
    props = _props(spark, d)
    model = _fitted(spark, d, "property", lambda: M.fit_label_encoded(
        props, props.where(F.col("price").isNotNull()), ["city", "district", "province", "type"],
        ["size_m2", "bedrooms", "bathrooms"], "price", key=["listing_id"]))
    return model.predict(props).select(
        "listing_id", "city", "district", "type", F.col("prediction").alias("predicted_price"))


@query("predict_transaction")
def q_predict_transaction(spark, d):
    from plotline.operators import models as M
    tr = V.transactions(Tables(spark, d)).select(
        "city", F.year("month").alias("year"), F.month("month").alias("month"),
        F.col("transaction_number").cast("double").alias("transaction_number"), "transaction_value")
    model = _fitted(spark, d, "transaction", lambda: M.fit_label_encoded(
        tr, tr, ["city"], ["year", "month", "transaction_number"], "transaction_value", key=["city", "year", "month"]))
    return model.predict(tr).select("city", "year", "month", F.col("prediction").alias("predicted_value"))
