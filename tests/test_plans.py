"""Physical-plan checks for the registered queries."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from plotline.plans import catalog

ML = {"forecast_city", "forecast_monthly", "forecast_validation_metrics", "price_model_metrics",
      "estimate_price", "feature_importance", "predict_property", "predict_transaction"}
NAMES = sorted(n for n in catalog.QUERIES if n not in ML)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_udf(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF", p)


@pytest.mark.parametrize("name", NAMES)
def test_fact_table_never_broadcast(spark, name):
    """A BroadcastExchange may sit above dimension scans or per-group aggregates,
    never directly above lineitem/orders rows."""
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        sub = []
        for nxt in lines[i + 1:]:
            if len(nxt) - len(nxt.lstrip(" :+-")) <= indent:
                break
            sub.append(nxt)
        text = "\n".join(sub)
        if "Aggregate" in text:
            continue          # a per-group aggregate of the facts, bounded by its keys
        assert "lineitem.parquet" not in text and "orders.parquet" not in text, (name, line)


def test_rollup_scan_is_pruned_and_exact_percentile_not_used(spark):
    df = E.queries()["rollup_price_by_province"](spark, SF_SMALL)
    p = plan_of(df)
    scan = [ln for ln in p.splitlines() if "lineitem.parquet" in ln][0]
    for unused in ("l_discount", "l_tax", "l_returnflag", "l_linestatus"):
        assert unused not in scan
    # neither the unbounded value map of percentile/median nor a digest is in the plan
    assert not re.search(r"percentile\(|\bmedian\(", p)
    assert "SortAggregate" not in p
    assert len(re.findall(r"FileScan parquet \[l_", p)) == 2


def test_dimension_joins_are_broadcast(spark):
    p = plan_of(E.queries()["rollup_price_by_district"](spark, SF_SMALL))
    assert p.count("BroadcastHashJoin") >= 3


def _bracket_groups(text: str) -> int:
    """Top-level ``[...]`` groups of a plan node's argument list: a Window prints
    [functions], [partition keys], [order] -- two groups when it has no partition."""
    depth, groups = 0, 0
    for ch in text:
        if ch in "[(":
            if depth == 0 and ch == "[":
                groups += 1
            depth += 1
        elif ch in "])":
            depth -= 1
    return groups


@pytest.mark.parametrize("name", NAMES)
def test_no_unpartitioned_window(spark, name):
    """Every Window node has a partition spec."""
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    unpartitioned = [ln for ln in p.splitlines()
                     if re.search(r"\bWindow \[", ln) and _bracket_groups(ln.split("Window ", 1)[1]) < 3]
    assert not unpartitioned, unpartitioned


def test_unpartitioned_window_is_seen(spark):
    """The detector sees one where there is one."""
    p = plan_of(spark.range(5).selectExpr("sum(id) OVER (ORDER BY id) AS s"))
    assert [ln for ln in p.splitlines() if re.search(r"\bWindow \[", ln) and _bracket_groups(ln.split("Window ", 1)[1]) < 3]


def test_group_join_policy(spark):
    """Unbounded keys (city) count distinct values before they join the wanted buckets;
    bounded keys (province) broadcast these buckets and shuffle only their rows."""
    city = plan_of(E.queries()["rollup_price_by_city"](spark, SF_SMALL))
    prov = plan_of(E.queries()["rollup_price_by_province"](spark, SF_SMALL))
    joined = r"BroadcastHashJoin \[coalesce\(province#\d+, \), isnull\(province#\d+\), coalesce\(_j#\d+, 0\)"
    assert re.search(joined, prov)
    assert re.search(r"Exchange hashpartitioning\(city#\d+, _j#\d+, _b#\d+L, _v#\d+", city)


@pytest.mark.parametrize("name", ["kpi_cards", "agg_sum_global", "top1_max", "top1_min", "hot_areas", "city_circles",
                                  "max_listings_district"])
def test_dashboard_reads_no_median(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "approx_percentile" not in p
    assert len(re.findall(r"FileScan parquet \[l_", p)) == 1
