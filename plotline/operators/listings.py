"""Listing ETL: clean scraped text, parse addresses, resolve location ids, union sources.

Raw listings carry the scraped text columns ``Address, Price, Type, Size,
Bedrooms, Bathrooms``; every operator here returns snake_case columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.numeric import null_to_zero
from plotline.functions.text import clean_rent as clean_rent_text
from plotline.functions.text import (address_part, clean_price, clean_room_count, clean_size,
                                     coerce_numeric, extract_by_priority, extract_first_match,
                                     format_address, not_contains_ci, strip_decimal_zero,
                                     strip_suffix_words)
from plotline.operators.joins import join_groups


def _keep_id(df: DataFrame) -> list[str]:
    return ["listing_id"] if "listing_id" in df.columns else []


def clean_buy(raw: DataFrame, exclude: str = "france") -> DataFrame:
    """Sale listings: drop addresses naming ``exclude`` (any case); price and size text
    to numbers (NULL when not a number); room counts to INT."""
    return raw.where(not_contains_ci("Address", exclude)).select(
        *_keep_id(raw), F.col("Address").alias("address"), F.col("Type").alias("type"),
        coerce_numeric(clean_price("Price")).alias("price"),
        coerce_numeric(clean_size("Size")).alias("size_m2"),
        clean_room_count("Bedrooms").alias("bedrooms"),
        clean_room_count("Bathrooms").alias("bathrooms"))


def clean_rent(raw: DataFrame) -> DataFrame:
    """Yearly rentals: ``$24,000 /Year`` -> 24000.0 as ``rent_year``; size and rooms as
    for sales (no address filter)."""
    return raw.select(
        *_keep_id(raw), F.col("Address").alias("address"), F.col("Type").alias("type"),
        coerce_numeric(clean_rent_text("Price")).alias("rent_year"),
        coerce_numeric(clean_size("Size")).alias("size_m2"),
        clean_room_count("Bedrooms").alias("bedrooms"),
        clean_room_count("Bathrooms").alias("bathrooms"))


def parse_address(df: DataFrame, provinces: Sequence[str], districts: Sequence[str],
                  address: str = "address") -> DataFrame:
    """province = listed name occurring first *by position in the text*;
    district = 2nd comma part when it is a known district, else NULL;
    city = 1st comma part."""
    part1 = address_part(address, 1)
    return df.withColumns({
        "province": extract_first_match(address, provinces),
        "district": F.when(part1.isin(list(districts)), part1),
        "city": address_part(address, 0),
    })


def priced(df: DataFrame, value: str, provinces: Sequence[str], districts: Sequence[str]) -> DataFrame:
    """Parsed listings that have a province, with ``value`` as the numeric ``price``.
    The province filter runs before every rollup, as in the source pipeline, so a
    listing with a district but no province is counted nowhere."""
    out = parse_address(df, provinces, districts).where(F.col("province").isNotNull())
    return out.withColumn("price", F.col(value)) if value != "price" else out


def build_properties(listings: DataFrame, coords: DataFrame) -> DataFrame:
    """Property table: listings with coordinates (inner join on district), a known
    type, missing room counts as 0."""
    return (listings.join(F.broadcast(coords), "district")
            .where(F.col("type").isNotNull())
            .select(*_keep_id(listings), "city", "district", "province", "type", "size_m2",
                    null_to_zero("bedrooms").alias("bedrooms"),
                    null_to_zero("bathrooms").alias("bathrooms"),
                    "price", "latitude", "longitude"))


def night_provinces(df: DataFrame, names: Sequence[str], aliases: dict,
                    address: str = "Address") -> DataFrame:
    """Nightly rentals: province = first name *in list order* found in the text
    (aliases mapped), NULL when none is found."""
    return df.withColumn("province", extract_by_priority(address, names, aliases))


#: Word that the id source appends to names of a level.
PROVINCE_SUFFIX = " Governorate"
DISTRICT_SUFFIX = " district"


def resolve_location(listings: DataFrame, dim: DataFrame) -> DataFrame:
    """JSON-source listings: look up ``p<ProvinceID>``, ``d<DistrictID>`` and
    ``c<CommunityID>`` names (a miss gives ``''``; for a duplicated id the entry with
    the highest ``seq`` wins), strip the province's and the district's own suffix (a
    community keeps its name), build ``community, district, province`` and turn room
    texts into whole-number texts (``2.0`` -> ``2``; text that is no number is NULL).
    ``Furnished`` is carried; the source has no property type.

    The dimension is reduced to one name per id with a grouped ``max_by``.  Every
    listing of a province shares one lookup key, so province and district names
    (fixed-size levels) are broadcast; community names grow with the data, so a community
    with many listings is spread over several tasks (``spread_join``).
    """
    names = dim.groupBy("id").agg(F.max_by("name_en", "seq").alias("name"))
    out = listings
    for prefix, col, alias, suffixes, bounded in (
            ("p", "ProvinceID", "province_name", [PROVINCE_SUFFIX], True),
            ("d", "DistrictID", "district_name", [DISTRICT_SUFFIX], True),
            ("c", "CommunityID", "community_name", [], False)):
        n = (names.where(F.col("id").startswith(prefix))
             .select(F.col("id").alias(f"_{alias}_id"), strip_suffix_words("name", suffixes).alias(alias)))
        out = out.withColumn(f"_{alias}_id", F.concat(F.lit(prefix), F.col(col).cast("string")))
        # names are one an id, so the rows of an id are counted before the joins
        counts = None if bounded else listings.groupBy(
            F.concat(F.lit(prefix), F.col(col).cast("string")).alias(f"_{alias}_id")).agg(F.count(F.lit(1)).alias("_rows"))
        out = (join_groups(out, n, [f"_{alias}_id"], "left", broadcast=bounded, counts=counts)
               .drop(f"_{alias}_id")
               .withColumn(alias, F.coalesce(F.col(alias), F.lit(""))))

    def rooms(c):
        return strip_decimal_zero(coerce_numeric(F.col(c)).cast("string"))

    return out.select(
        *_keep_id(listings), F.col("Title").alias("title"),
        format_address("community_name", "district_name", "province_name").alias("address"),
        F.col("Price").alias("price"), F.col("Area_sqm").alias("size_m2"),
        rooms("Bedroom").alias("bedrooms"), rooms("Bathroom").alias("bathrooms"),
        F.col("Furnished").alias("furnished"))


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two sources by column name; columns missing on one side are NULL."""
    return a.unionByName(b, allowMissingColumns=True)
