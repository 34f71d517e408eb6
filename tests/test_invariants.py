"""Rollup invariants on the driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_MID

LEVELS = ["rollup_rent_year_by_province", "rollup_rent_year_by_district", "rollup_rent_year_by_city"]


@pytest.fixture(scope="module")
def rollups(spark):
    return {n: E.queries()[n](spark, SF_MID).collect() for n in LEVELS}


def test_totals_agree(rollups):
    prov = sum(r.listings_count for r in rollups["rollup_rent_year_by_province"])
    dist = sum(r.listings_count for r in rollups["rollup_rent_year_by_district"])
    city = sum(r.listings_count for r in rollups["rollup_rent_year_by_city"])
    assert prov == city          # every listing with a province has a city
    assert dist <= prov          # unknown districts are dropped at the district level


@pytest.mark.parametrize("name", LEVELS)
def test_stat_order_and_keys(rollups, name):
    rows = rollups[name]
    key = rows[0].__fields__[0]
    keys = [r[key] for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    for r in rows:
        if r.listings_count:
            assert r.min_rent <= r.median_rent <= r.max_rent
            assert r.min_rent <= r.avg_rent <= r.max_rent
