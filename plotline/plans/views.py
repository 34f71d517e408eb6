"""Logical property-market tables built from the driver's parquet tables.

Each view exists twice: a lazy Spark builder (``listing(t)``) and the equivalent
DuckDB CTE text (``SQL["listing"]``) used by the correctness oracle.  The mapping
(see README) is deterministic; NULLs and dirty text are introduced with fixed
``CASE`` rules so every cleaning branch fires on real table data.

Scale notes: ``region`` (5 rows) and ``nation`` (25 rows) are bounded by the
schema and broadcast explicitly.  ``supplier`` and ``part`` grow with the data,
so they are plain joins: Catalyst broadcasts them only under
``spark.sql.autoBroadcastJoinThreshold`` (checked against file statistics), AQE
re-plans from the real shuffle sizes, otherwise sort-merge join with skew splits.
``part`` is joined only when a query needs type or size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.sources.tables import Tables

# Monthly rates are mapped onto the driver's 1995-2001 order dates: source year y
# becomes y - RATE_YEAR_SHIFT, and the five rate cities become NATION_0..NATION_4.
RATE_YEAR_SHIFT = 25
RATE_CITY_MAP = {"Beirut": "NATION_0", "Bekaa": "NATION_1", "Tripoli": "NATION_2",
                 "Baabda": "NATION_3", "Kesrouan": "NATION_4"}


def _geo_join(fact: DataFrame, t: Tables, suppkey: str = "l_suppkey") -> DataFrame:
    """fact -> supplier (city) -> nation (district) -> region (province).

    Joined in this order so every build side is a dimension: joining supplier to
    nation first would make Catalyst (without table statistics) estimate that side
    as the product of both sizes and pick the *fact* as the broadcast side.
    """
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    reg = F.broadcast(t.region.select("r_regionkey", "r_name"))
    return (fact.join(t.supplier.select("s_suppkey", "s_name", "s_nationkey"),
                      F.col(suppkey) == F.col("s_suppkey"))
            .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))


def _lineitem(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             "l_quantity", "l_extendedprice", "l_shipdate")


def listing(t: Tables, with_part: bool = True) -> DataFrame:
    """One row per line item: a property listing.

    listing_id, province, district, city, type, size_m2, price, bedrooms,
    bathrooms, list_date (+ nationkey, regionkey, suppkey for id lookups).
    ``listing_id`` (order, line) repeats in the driver data, like a scraped id
    seen twice; (listing_id, suppkey, partkey, amount, quantity, list_date) is unique
    and is the tiebreak wherever an order must be total (``TIEBREAK``).
    """
    li = _geo_join(_lineitem(t), t)
    if with_part:
        li = li.join(t.part.select("p_partkey", "p_type", "p_size"),
                     F.col("l_partkey") == F.col("p_partkey"))
    cols = [
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("listing_id"),
        F.col("r_name").alias("province"), F.col("n_name").alias("district"),
        F.col("s_name").alias("city"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_linenumber").alias("bedrooms"),
        (F.col("l_quantity").cast("int") % 5).alias("bathrooms"),
        F.col("l_shipdate").cast("date").alias("list_date"),
        F.col("n_nationkey").alias("nationkey"), F.col("r_regionkey").alias("regionkey"),
        F.col("s_suppkey").alias("suppkey"), F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"), F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
    ]
    if with_part:
        cols += [F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string"))
                  .otherwise(F.col("p_type")).alias("type"),
                 F.col("p_size").alias("size_m2")]
    return li.select(*cols)


TIEBREAK = ["listing_id", "suppkey", "partkey", "amount", "quantity", "list_date"]
TIEBREAK_SQL = ", ".join(TIEBREAK)


def _money_text(x) -> F.Column:
    """Integer dollars with thousands separators, e.g. 1234567 -> '1,234,567'."""
    v = x.cast("bigint")
    return (F.when(v >= 1000000, F.concat(
                (v.cast("long") / 1000000).cast("bigint").cast("string"), F.lit(","),
                F.lpad(((v / 1000).cast("bigint") % 1000).cast("string"), 3, "0"), F.lit(","),
                F.lpad((v % 1000).cast("string"), 3, "0")))
            .when(v >= 1000, F.concat(
                (v / 1000).cast("bigint").cast("string"), F.lit(","),
                F.lpad((v % 1000).cast("string"), 3, "0")))
            .otherwise(v.cast("string")))


def raw_listing(t: Tables, kind: str = "buy") -> DataFrame:
    """Scraped-text form of ``listing``: Address, Price, Type, Size, Bedrooms, Bathrooms.

    ``kind='buy'``: price ``$1,234``; ``kind='rent'``: yearly rent ``$1,234 /Year``
    (price / 20).  ``N/A`` marks missing values; every 13th order's address names
    FRANCE instead of the province; some prices are non-numeric text.
    """
    lst = listing(t)
    amount = F.col("price") if kind == "buy" else F.col("price") / 20
    price_txt = F.concat(F.lit("$"), _money_text(amount))
    if kind == "rent":
        price_txt = F.concat(price_txt, F.lit(" /Year"))
    return lst.select(
        "listing_id",
        F.concat(F.col("city"), F.lit(", "), F.col("district"), F.lit(", "),
                 F.when(F.col("orderkey") % 13 == 0, F.lit("FRANCE"))
                  .otherwise(F.col("province"))).alias("Address"),
        F.when(F.col("price").isNull(), F.lit("N/A"))
         .when((F.col("bedrooms") == 5) & (F.col("orderkey") % 4 == 0), F.lit("Call for price"))
         .otherwise(price_txt).alias("Price"),
        F.col("type").alias("Type"),
        F.concat(F.col("size_m2").cast("string"), F.lit(" m²")).alias("Size"),
        F.when(F.col("bedrooms") == 6, F.lit("N/A"))
         .otherwise(F.col("bedrooms").cast("string")).alias("Bedrooms"),
        F.col("bathrooms").cast("string").alias("Bathrooms"),
    )


def night_listing(t: Tables) -> DataFrame:
    """Nightly rentals with free-text addresses naming up to two regions.

    Address = ``<city> near <other region> in <region>``; MIDDLE EAST is written
    with the alias MIDEAST on even line numbers; line 4 names no region at all.
    """
    lst = listing(t, with_part=False)
    other = F.broadcast(t.region.select(F.col("r_regionkey").alias("o_key"),
                                        F.col("r_name").alias("o_name")))
    lst = lst.join(other, ((F.col("regionkey") + F.col("bedrooms")) % 5) == F.col("o_key"))
    own = (F.when((F.col("province") == "MIDDLE EAST") & (F.col("bedrooms") % 2 == 0),
                  F.lit("MIDEAST")).otherwise(F.col("province")))
    addr = (F.when(F.col("bedrooms") == 4, F.concat(F.col("city"), F.lit(" - "), F.col("district")))
            .otherwise(F.concat(F.col("city"), F.lit(" near "), F.col("o_name"), F.lit(" in "), own)))
    return lst.select("listing_id", addr.alias("Address"),
                      (F.col("price") / 100).alias("rent_night"))


NIGHT_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "MIDEAST"]
NIGHT_ALIASES = {"MIDEAST": "MIDDLE EAST"}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def coords(t: Tables) -> DataFrame:
    """District coordinates for nations 0-19 (20-24 have none: inner vs left join)."""
    return (t.nation.where(F.col("n_nationkey") < 20)
            .select(F.col("n_name").alias("district"),
                    (F.lit(30.0) + F.col("n_nationkey") * F.lit(0.25)).alias("latitude"),
                    (F.lit(35.0) + F.col("n_nationkey") * F.lit(0.125)).alias("longitude")))


def location_dim(t: Tables) -> DataFrame:
    """Location dimension: id ``p<region>``, ``d<nation>``, ``c<supplier>``; seq orders
    duplicates (nations with key % 5 == 0 are listed twice; the later name wins).  A
    province and some communities bear words that are suffixes on another level."""
    p = t.region.select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("id"),
                        F.concat(F.col("r_name"), F.when(F.col("r_name") == "ASIA", " district").otherwise(""),
                                 F.lit(" Governorate")).alias("name_en"),
                        F.lit(0).alias("seq"))
    d = t.nation.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"),
                        F.concat(F.col("n_name"), F.lit(" district")).alias("name_en"),
                        F.lit(0).alias("seq"))
    d2 = (t.nation.where(F.col("n_nationkey") % 5 == 0)
          .select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"),
                  F.concat(F.col("n_name"), F.lit("-new district")).alias("name_en"),
                  F.lit(1).alias("seq")))
    c = t.supplier.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"),
                          F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 7 == 0, " district")
                                   .when(F.col("s_suppkey") % 7 == 1, " Governorate").otherwise("")).alias("name_en"),
                          F.lit(0).alias("seq"))
    return p.unionByName(d).unionByName(d2).unionByName(c)


def id_listing(t: Tables) -> DataFrame:
    """JSON-source listings keyed by location ids (community missing on line 3, room
    text that is no number on line 5, no property type)."""
    lst = listing(t, with_part=True)
    return lst.select(
        "listing_id",
        F.concat(F.lit("Listing "), F.col("listing_id").cast("string")).alias("Title"),
        F.col("price").alias("Price"),
        F.when(F.col("bedrooms") == 5, F.lit("studio"))
         .when(F.col("bedrooms") % 3 == 0, F.col("bedrooms").cast("double").cast("string"))
         .otherwise(F.col("bedrooms").cast("string")).alias("Bedroom"),
        F.col("bathrooms").cast("double").cast("string").alias("Bathroom"),
        F.col("size_m2").alias("Area_sqm"),
        F.when(F.col("partkey") % 3 == 0, "Furnished").when(F.col("partkey") % 3 == 1, "Unfurnished").alias("Furnished"),
        F.col("nationkey").alias("DistrictID"), F.col("regionkey").alias("ProvinceID"),
        F.when(F.col("bedrooms") == 3, F.lit(None).cast("bigint"))
         .otherwise(F.col("suppkey")).alias("CommunityID"),
    )


#: Listings (by id) that share a rendered page.
PAGE_IDS = 40


def html_pages(t: Tables) -> DataFrame:
    """``raw_listing`` as listing pages: cards nested in a section, with other markup in and
    around them, and a card outside of the section that is no listing."""
    def element(spec, content, inner=""):
        return F.concat(F.lit(f'<{spec[0]} class="{spec[1]}">{inner}'), content, F.lit(f"</{spec[0]}>"))

    def given(spec, name):
        return F.when(F.col(name).isNotNull() & (F.col(name) != "N/A"), element(spec, F.col(name))).otherwise("")

    rooms = F.concat(*[element(K.HTML_ROOMS, F.when(F.col(c) == "N/A", F.lit(" ")).otherwise(F.concat(F.lit("\n "), c, F.lit(f" {c}"))),
                               '<img src="i.svg"/>') for c in ("Bedrooms", "Bathrooms")])
    card = element(K.HTML_CARD, F.concat(
        F.lit('<div class="photo"><img src="a.jpg"><div class="tag">new</div></div><div class="body">'),
        element(K.HTML_ADDRESS, F.concat(F.lit("<span></span> "), "Address", F.lit(" "))),
        given(K.HTML_PRICE, "Price"), F.lit('<div class="row">'), given(K.HTML_TYPE, "Type"), rooms,
        F.lit("<div>plot</div><div><b>"), F.col("Size"), F.lit("</b></div></div><br></div>")))
    cards = raw_listing(t).select(F.floor(F.col("listing_id") / PAGE_IDS).alias("page_id"), "listing_id", card.alias("card"))
    page = F.concat(F.lit(f"<html><!-- <section class='{K.HTML_SECTION[1]}'> --><body><script>var a = '<div>';</script>"),
                    F.lit(f'<div class="{K.HTML_CARD[1]}"><address class="{K.HTML_ADDRESS[1]}">not listed</address></div>'),
                    F.lit(f'<section class="{K.HTML_SECTION[1]}">'), F.array_join("cards.card", "<hr>"),
                    F.lit(f'</section><div class="{K.HTML_CARD[1]}">neither</div></body></html>'))
    return (cards.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("listing_id", "card"))).alias("cards"))
            .select("page_id", page.alias("html")))


def json_pages(t: Tables) -> DataFrame:
    """``id_listing`` as API pages; every fourth listing is a boosted one, a missing field
    is absent."""
    def text(c):
        return F.col(c).cast("string")

    doc = F.struct(F.col("Title").alias("title_en"), F.col("Price").cast("decimal(15,2)").cast("string").alias("price"),
                   F.col("Bathroom").alias("bathroom_value"), F.col("Bedroom").alias("bedroom_value"),
                   text("Area_sqm").alias("area"), F.col("Furnished").alias("furnished"), text("DistrictID").alias("district_id"),
                   text("ProvinceID").alias("province_id"), text("CommunityID").alias("community_id"))
    boosted = F.col("listing_id") % 4 == 0
    return (id_listing(t).select(F.floor(F.col("listing_id") / PAGE_IDS).alias("page"), boosted.alias("b"), doc.alias("doc"))
            .groupBy("page").agg(F.collect_list(F.when(F.col("b"), F.col("doc"))).alias("x"),
                                 F.collect_list(F.when(~F.col("b"), F.col("doc"))).alias("y"))
            .select("page", F.to_json(F.struct(F.struct(F.col("x").alias("boostedProperties"), F.col("y").alias("docs"))
                                               .alias("data"))).alias("json")))


def location_pages(t: Tables) -> DataFrame:
    """``location_dim`` as API pages of up to 40 locations of one level."""
    return (location_dim(t).groupBy(F.substring("id", 1, 1), F.floor(F.substring("id", 2, 20).cast("bigint") / PAGE_IDS))
            .agg(F.collect_list(F.struct("id", "name_en")).alias("locations"))
            .select(F.to_json(F.struct(F.struct("locations").alias("pageProps"))).alias("json")))


def transactions(t: Tables) -> DataFrame:
    """Monthly series per nation from orders: city, month (DATE), nationkey,
    transaction_number, transaction_value (exact decimal sum, as double)."""
    nat = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    # thousandths from the order key, as the source's series has three decimals
    value = F.expr("cast(o_totalprice as decimal(18,2)) + cast(o_orderkey % 10 as decimal(4,0)) * cast(0.001 as decimal(4,3))")
    o = t.orders.select("o_custkey", value.alias("_value"), "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("city"), F.col("n_nationkey").alias("nationkey"),
                     F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("transaction_number"),
                 F.sum("_value").cast("double").alias("transaction_value")))


def series_counts(t: Tables) -> DataFrame:
    """Count file form: Date ``MM/yyyy``, Transaction_Number, City."""
    return transactions(t).select(F.date_format("month", "MM/yyyy").alias("Date"),
                                  F.col("transaction_number").alias("Transaction_Number"),
                                  F.col("city").alias("City"))


def series_values(t: Tables) -> DataFrame:
    """Value file form; cities with key % 8 == 7 have no values, key % 6 == 5 carry a
    trailing blank in the name."""
    return (transactions(t).where(F.col("nationkey") % 8 != 7)
            .select(F.date_format("month", "MM/yyyy").alias("Date"),
                    F.col("transaction_value").alias("Transaction_Value"),
                    F.when(F.col("nationkey") % 6 == 5, F.concat(F.col("city"), F.lit(" ")))
                     .otherwise(F.col("city")).alias("City")))


def rates(spark) -> DataFrame:
    """The fixed scenario-rate table, long form, re-keyed onto the driver's years/cities:
    year, city, scenario ('crash'/'boom'), annual_rate."""
    rows = []
    for y, city, crash, boom in K.SCENARIO_RATES:
        rows.append((y - RATE_YEAR_SHIFT, RATE_CITY_MAP[city], "crash", float(crash)))
        rows.append((y - RATE_YEAR_SHIFT, RATE_CITY_MAP[city], "boom", float(boom)))
    return spark.createDataFrame(rows, "year int, city string, scenario string, annual_rate double")


# ---------------------------------------------------------------------------
# DuckDB CTE text for the same views (oracle side).  Compose with ``with_views``.
# ---------------------------------------------------------------------------

SQL = {
    "listing": """listing AS (
  SELECT l.l_orderkey * 8 + l.l_linenumber AS listing_id, r.r_name AS province,
         n.n_name AS district, s.s_name AS city,
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_extendedprice END AS price,
         l.l_linenumber AS bedrooms, CAST(trunc(l.l_quantity) AS INTEGER) % 5 AS bathrooms,
         CAST(l.l_shipdate AS DATE) AS list_date, n.n_nationkey AS nationkey,
         r.r_regionkey AS regionkey, s.s_suppkey AS suppkey, l.l_orderkey AS orderkey,
         l.l_partkey AS partkey, l.l_extendedprice AS amount, l.l_quantity AS quantity,
         CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE p.p_type END AS type,
         p.p_size AS size_m2
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)""",
    "raw_buy": """raw_buy AS (
  SELECT listing_id,
         city || ', ' || district || ', ' || CASE WHEN orderkey % 13 = 0 THEN 'FRANCE' ELSE province END AS Address,
         CASE WHEN price IS NULL THEN 'N/A'
              WHEN bedrooms = 5 AND orderkey % 4 = 0 THEN 'Call for price'
              ELSE '$' || {money_price} END AS Price,
         type AS Type, CAST(size_m2 AS VARCHAR) || ' m²' AS Size,
         CASE WHEN bedrooms = 6 THEN 'N/A' ELSE CAST(bedrooms AS VARCHAR) END AS Bedrooms,
         CAST(bathrooms AS VARCHAR) AS Bathrooms
  FROM listing)""",
    "raw_rent": """raw_rent AS (
  SELECT listing_id,
         city || ', ' || district || ', ' || CASE WHEN orderkey % 13 = 0 THEN 'FRANCE' ELSE province END AS Address,
         CASE WHEN price IS NULL THEN 'N/A'
              WHEN bedrooms = 5 AND orderkey % 4 = 0 THEN 'Call for price'
              ELSE '$' || {money_rent} || ' /Year' END AS Price,
         type AS Type, CAST(size_m2 AS VARCHAR) || ' m²' AS Size,
         CASE WHEN bedrooms = 6 THEN 'N/A' ELSE CAST(bedrooms AS VARCHAR) END AS Bedrooms,
         CAST(bathrooms AS VARCHAR) AS Bathrooms
  FROM listing)""",
    "night": """night AS (
  SELECT listing_id,
         CASE WHEN bedrooms = 4 THEN city || ' - ' || district
              ELSE city || ' near ' || o.r_name || ' in ' ||
                   CASE WHEN province = 'MIDDLE EAST' AND bedrooms % 2 = 0 THEN 'MIDEAST' ELSE province END
         END AS Address,
         price / 100 AS rent_night
  FROM listing JOIN region o ON (regionkey + bedrooms) % 5 = o.r_regionkey)""",
    "coords": """coords AS (
  SELECT n_name AS district, CAST(30.0 AS DOUBLE) + n_nationkey * CAST(0.25 AS DOUBLE) AS latitude,
         CAST(35.0 AS DOUBLE) + n_nationkey * CAST(0.125 AS DOUBLE) AS longitude
  FROM nation WHERE n_nationkey < 20)""",
    "location_dim": """location_dim AS (
  SELECT 'p' || CAST(r_regionkey AS VARCHAR) AS id,
         r_name || CASE WHEN r_name = 'ASIA' THEN ' district' ELSE '' END || ' Governorate' AS name_en, 0 AS seq FROM region
  UNION ALL SELECT 'd' || CAST(n_nationkey AS VARCHAR), n_name || ' district', 0 FROM nation
  UNION ALL SELECT 'd' || CAST(n_nationkey AS VARCHAR), n_name || '-new district', 1 FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'c' || CAST(s_suppkey AS VARCHAR),
         s_name || CASE s_suppkey % 7 WHEN 0 THEN ' district' WHEN 1 THEN ' Governorate' ELSE '' END, 0 FROM supplier)""",
    "id_listing": """id_listing AS (
  SELECT listing_id, 'Listing ' || CAST(listing_id AS VARCHAR) AS Title, price AS Price,
         CASE WHEN bedrooms = 5 THEN 'studio'
              WHEN bedrooms % 3 = 0 THEN CAST(CAST(bedrooms AS DOUBLE) AS VARCHAR)
              ELSE CAST(bedrooms AS VARCHAR) END AS Bedroom,
         CAST(CAST(bathrooms AS DOUBLE) AS VARCHAR) AS Bathroom, size_m2 AS Area_sqm,
         CASE partkey % 3 WHEN 0 THEN 'Furnished' WHEN 1 THEN 'Unfurnished' END AS Furnished,
         nationkey AS DistrictID, regionkey AS ProvinceID,
         CASE WHEN bedrooms = 3 THEN NULL ELSE suppkey END AS CommunityID
  FROM listing)""",
    "transactions": """transactions AS (
  SELECT n.n_name AS city, n.n_nationkey AS nationkey,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
         CAST(count(*) AS BIGINT) AS transaction_number,
         CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))
                  + CAST(o.o_orderkey % 10 AS DECIMAL(4,0)) * CAST(0.001 AS DECIMAL(4,3))) AS DOUBLE) AS transaction_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)""",
    "series_counts": """series_counts AS (
  SELECT strftime(month, '%m/%Y') AS Date, transaction_number AS Transaction_Number, city AS City
  FROM transactions)""",
    "series_values": """series_values AS (
  SELECT strftime(month, '%m/%Y') AS Date, transaction_value AS Transaction_Value,
         CASE WHEN nationkey % 6 = 5 THEN city || ' ' ELSE city END AS City
  FROM transactions WHERE nationkey % 8 <> 7)""",
    "sessions": """sessions AS (
  SELECT conv_id AS id,
         list({{'role': role, 'content': text}} ORDER BY turn) AS messages,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS INTEGER)) AS created_at
  FROM conversations GROUP BY conv_id)""",
}


def _money_sql(x: str) -> str:
    v = f"CAST(trunc({x}) AS BIGINT)"
    return (f"(CASE WHEN {v} >= 1000000 THEN CAST({v} // 1000000 AS VARCHAR) || ',' || "
            f"lpad(CAST(({v} // 1000) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST({v} % 1000 AS VARCHAR), 3, '0') "
            f"WHEN {v} >= 1000 THEN CAST({v} // 1000 AS VARCHAR) || ',' || lpad(CAST({v} % 1000 AS VARCHAR), 3, '0') "
            f"ELSE CAST({v} AS VARCHAR) END)")


SQL["raw_buy"] = SQL["raw_buy"].replace("{money_price}", _money_sql("price"))
SQL["raw_rent"] = SQL["raw_rent"].replace("{money_rent}", _money_sql("price / 20"))
SQL["sessions"] = SQL["sessions"].replace("{{", "{").replace("}}", "}")

# Views each CTE depends on (so ``with_views`` can emit them in order).
SQL_DEPS = {"raw_buy": ["listing"], "raw_rent": ["listing"], "night": ["listing"],
            "id_listing": ["listing"], "series_counts": ["transactions"],
            "series_values": ["transactions"]}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views and their dependencies."""
    order: list[str] = []

    def add(n):
        for d in SQL_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n"


def rates_sql() -> str:
    """VALUES list of the re-keyed rate table (DuckDB)."""
    rows = []
    for y, city, crash, boom in K.SCENARIO_RATES:
        rows.append(f"({y - RATE_YEAR_SHIFT}, '{RATE_CITY_MAP[city]}', 'crash', CAST({crash!r} AS DOUBLE))")
        rows.append(f"({y - RATE_YEAR_SHIFT}, '{RATE_CITY_MAP[city]}', 'boom', CAST({boom!r} AS DOUBLE))")
    return ("rates AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS v(year, city, scenario, annual_rate))")
