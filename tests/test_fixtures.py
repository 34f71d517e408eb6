"""Hand-made fixtures for the non-obvious semantics (FIXTURES.md F1-F15)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plotline import constants as K
from plotline.functions import numeric as N
from plotline.functions import text as T
from plotline.functions.dates import is_quarter_end, parse_mm_yyyy, parse_yy_mon
from plotline.operators import features as FE
from plotline.operators import listings as L
from plotline.operators import rollups as R
from plotline.operators import series as S
from plotline.operators import sessions as SE
from plotline.sources import files as SRC

RAW = "listing_id long, Address string, Price string, Type string, Size string, Bedrooms string, Bathrooms string"


def test_f1_sale_cleaning_and_parsing(spark):
    raw = spark.createDataFrame([
        (1, "Hamra, Beirut, Beirut", "$1,250,000", "Apartment", "1,200 m²", "3", "2"),
        (2, "Nice, Alpes, FRANCE", "$9", "Villa", "10 m²", "1", "1"),
        (3, "Jounieh, Kesrouane, Mount Lebanon near North", "$500", "Apartment", "0 m²", "0", "N/A"),
        (4, "Nowhere", "Call", None, "N/A", "N/A", "studio"),
        (5, "Zahle, Unknownistan, Bekaa", "N/A", "Land", "300 m²", "2.0", "1"),
    ], RAW)
    c = {r.listing_id: r for r in L.clean_buy(raw).collect()}
    assert 2 not in c                                    # France, any case
    assert c[1].price == 1250000.0 and c[1].size_m2 == 1200.0 and c[1].bedrooms == 3
    assert c[3].size_m2 == 0.0 and c[3].bedrooms == 0 and c[3].bathrooms is None
    assert c[4].price is None and c[4].bathrooms is None
    assert c[5].price is None and c[5].bedrooms == 2
    p = {r.listing_id: r for r in L.parse_address(L.clean_buy(raw), K.PROVINCES, K.DISTRICTS).collect()}
    assert p[3].province == "Mount Lebanon"              # leftmost of two province names
    assert p[3].district == "Kesrouane"
    assert p[4].province is None and p[4].district is None and p[4].city == "Nowhere"
    assert p[5].district is None                         # not a known district


def test_f1_rollup_semantics(spark):
    df = spark.createDataFrame([
        ("A", 1.0), ("A", 2.0), ("A", 4.0), ("A", None), ("B", None), (None, 100.0),
    ], "province string, price double")
    r = {x.province: x for x in R.market_stats(df, "province").collect()}
    assert set(r) == {"A", "B"}                           # NULL key dropped
    assert (r["A"].avg_price, r["A"].median_price, r["A"].max_price, r["A"].min_price,
            r["A"].listings_count) == (2, 2, 4, 1, 3)     # 2.33 truncated; count non-null only
    assert r["B"].listings_count == 0 and r["B"].median_price is None
    assert [x.province for x in R.market_stats(df, "province").collect()] == ["A", "B"]


def test_f3_night_priority_and_alias(spark):
    df = spark.createDataFrame([("Villa in Jabal Lubnan",), ("Beirut flat, South view",),
                                ("Chalet somewhere",)], "Address string")
    out = [r.province for r in L.night_provinces(df, K.NIGHT_PROVINCES, K.PROVINCE_ALIASES).collect()]
    assert out == ["Mount Lebanon", "South", None]        # list order, not text order
    left = [r.p for r in df.select(T.extract_first_match("Address", K.NIGHT_PROVINCES).alias("p")).collect()]
    assert left == ["Jabal Lubnan", "Beirut", None]


def test_f4_resolve_location(spark):
    lst = spark.createDataFrame([
        ("t1", 100.0, "10", "2.0", 50, "Yes", 7, 1, 42),
        ("t2", 200.0, "10.0", None, 60, None, 7, 1, None),
        ("t3", 300.0, "studio", "1.5", 70, "No", 8, 2, 43),
    ], "Title string, Price double, Bedroom string, Bathroom string, Area_sqm int, Furnished string, "
       "DistrictID int, ProvinceID int, CommunityID int")
    dim = spark.createDataFrame([
        ("p1", "Beirut Governorate", 0), ("d7", "Old district", 0), ("d7", "Metn district", 1),
        ("c42", "Dbayeh", 0), ("p2", "North district Governorate", 0), ("c43", "Old district", 0),
        ("d8", "Zgharta Governorate district", 0)], "id string, name_en string, seq int")
    r = {x.title: x for x in L.resolve_location(lst, dim).collect()}
    assert r["t1"].address == "Dbayeh, Metn, Beirut"      # last entry wins, suffixes stripped
    assert r["t2"].address == ", Metn, Beirut"            # missing community -> ''
    assert r["t3"].address == "Old district, Zgharta Governorate, North district"   # own level's suffix only
    assert r["t1"].bedrooms == "10" and r["t2"].bedrooms == "10" and r["t1"].bathrooms == "2"
    assert r["t2"].bathrooms is None
    assert r["t3"].bedrooms is None and r["t3"].bathrooms == "1.5"
    assert [r[t].furnished for t in ("t1", "t2", "t3")] == ["Yes", None, "No"]


def test_f5_json_listings(spark):
    pages = spark.createDataFrame([
        (1, json.dumps({"data": {"boostedProperties": [{"title_en": "A", "price": "10"}],
                                 "docs": [{"title_en": "B", "district_id": "3"}]}})),
        (2, json.dumps({"data": {"docs": [{"title_en": "C"}]}})),
        (3, json.dumps({"other": 1})),
        (4, json.dumps({"data": {"boostedProperties": [], "docs": []}})),
    ], "page long, json string")
    rows = SRC.scan_json_listings(pages).orderBy("page", "item_pos").collect()
    assert [(r.page, r.Title) for r in rows] == [(1, "A"), (1, "B"), (2, "C")]
    assert rows[0].Price == "10" and rows[1].Price == "" and rows[1].DistrictID == "3"


def test_f5_json_locations(spark):
    pages = spark.createDataFrame([
        (json.dumps({"pageProps": {"locations": [{"id": "1", "name_en": "Beirut"}]}}),),
        (json.dumps({"pageProps": {"locations": []}}),), (json.dumps({}),)], "json string")
    rows = SRC.scan_json_locations(pages).collect()
    assert [(r.id, r.name_en) for r in rows] == [("1", "Beirut")]


def test_f6_html_listings(spark):
    from plotline import constants as K

    def el(spec, inner):
        return f'<{spec[0]} class="{spec[1]}">{inner}</{spec[0]}>'
    card = el(K.HTML_CARD, "<div class='x'><div><img src=a></div></div>" + el(K.HTML_ADDRESS, "<i></i> Hamra, Beirut, Beirut\n")
              + el(K.HTML_PRICE, "<b>$1,</b>000") + el(K.HTML_TYPE, " Apartment &amp; roof ") + "<div>x<div> 120 m² </div></div>"
              + el(K.HTML_ROOMS, "<br> 3 Beds") + el(K.HTML_ROOMS, "2 Baths") + "<div>90 m²</div>")
    no_price = el(K.HTML_CARD, el(K.HTML_ADDRESS, "Zahle, Zahle, Bekaa") + el(K.HTML_TYPE, "Land") + el(K.HTML_ROOMS, "4 Beds"))
    no_bed = el(K.HTML_CARD, el(K.HTML_ROOMS, "  ") + el(K.HTML_ROOMS, "1 Bath"))
    outside = el(K.HTML_CARD, el(K.HTML_ADDRESS, "elsewhere"))
    pages = spark.createDataFrame([
        (1, "u1", "<html>" + outside + el(K.HTML_SECTION, card + "<hr>" + no_price) + outside + "</html>"),
        (2, "u2", "<html><p>nothing here</p></html>"), (3, "u3", None), (4, "u4", outside),
        (5, "u5", el(K.HTML_SECTION, "<!-- " + card + " -->" + no_bed) + el(K.HTML_SECTION, card))],
        "page_id long, url string, html string")
    rows = SRC.scan_html_listings(pages).orderBy("page_id", "pos").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "Hamra, Beirut, Beirut", "$1,000", "Apartment & roof", "x120 m²", "3", "2"),
        (1, 1, "Zahle, Zahle, Bekaa", None, "Land", None, "4", None),
        (5, 0, None, None, None, None, None, "1")]


def test_html_pages_read_where_they_lie(spark):
    from plotline import constants as K

    def page(*names):
        cards = "".join(f'<div class="{K.HTML_CARD[1]}"><address class="{K.HTML_ADDRESS[1]}">{n}</address></div>' for n in names)
        return f'<section class="{K.HTML_SECTION[1]}">{cards}</section>'
    pages = spark.createDataFrame([(1, page("a", "b")), (1, page("c")), (None, page("d > e"))], "page_id long, html string")
    read = SRC.scan_html_listings(pages)
    # pages with the same id, or none, are not mixed; no tag is sorted or sent anywhere
    assert sorted((str(r.page_id), r.pos, r.Address) for r in read.collect()) == [
        ("1", 0, "a"), ("1", 0, "c"), ("1", 1, "b"), ("None", 0, "d > e")]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_f7_coords_inner_vs_left(spark):
    roll = spark.createDataFrame([("Baalbeck", 1), ("Zahle", 2)], "district string, listings_count int")
    coords = spark.createDataFrame([(n, a, b) for n, a, b in K.DISTRICT_COORDS],
                                   "district string, latitude double, longitude double")
    assert [r.district for r in R.attach_coords(roll, coords, how="inner").collect()] == ["Zahle"]
    left = {r.district: r.latitude for r in R.attach_coords(roll, coords, how="left").collect()}
    assert left["Baalbeck"] is None and left["Zahle"] == 33.8461


def test_f8_series_join_exact_vs_trimmed(spark):
    counts = spark.createDataFrame([("01/2016", 5, "Saida"), ("01/2016", 7, "Beirut")],
                                   "Date string, Transaction_Number int, City string")
    values = spark.createDataFrame([("01/2016", 1.5, "Saida "), ("01/2016", 2.5, "Beirut")],
                                   "Date string, Transaction_Value double, City string")
    assert S.join_series(counts, values).count() == 1
    assert S.join_series(counts, values, trim_keys=True).count() == 2


def test_dates(spark):
    df = spark.createDataFrame([("11-Jan", "03/2017", dt.date(2020, 3, 31)), ("99-Dec", "12/1999", dt.date(2020, 3, 1))],
                               "a string, b string, d date")
    r = df.select(parse_yy_mon("a").alias("a"), parse_mm_yyyy("b").alias("b"), is_quarter_end("d").alias("q")).collect()
    assert r[0].a == dt.date(2011, 1, 1) and r[0].b == dt.date(2017, 3, 1) and r[0].q == 1
    assert r[1].a == dt.date(1999, 12, 1) and r[1].q == 0          # month start is never quarter end


def _series(spark, rows):
    return spark.createDataFrame(rows, "city string, date date, price double")


def test_f10_scenario_projection(spark):
    rates = spark.createDataFrame([(2020, "Beirut", "boom", 0.12), (2020, "Beirut", "crash", -0.12),
                                   (2020, "Bekaa", "boom", 0.24), (2020, "Bekaa", "crash", -0.24)],
                                  "year int, city string, scenario string, annual_rate double")
    s = _series(spark, [("Bekaa", dt.date(2020, 1, 1), 100.0), ("Bekaa", dt.date(2020, 3, 1), 110.0),
                        ("Tyre", dt.date(2020, 2, 1), 50.0), ("Tyre", dt.date(2020, 4, 1), 60.0),
                        ("Bekaa", dt.date(2018, 5, 1), 70.0)])
    out = {(r.city, r.date, r.scenario): r.transaction_value
           for r in S.scenario_projection(s, rates, "Beirut").collect()}
    assert len(out) == 15
    assert out[("Bekaa", dt.date(2020, 1, 1), "Boom")] == 100.0          # January unchanged
    m = (1.24) ** (1 / 12)
    assert out[("Bekaa", dt.date(2020, 3, 1), "Boom")] == pytest.approx(110 + 100 * (m ** 2 - 1))
    # Tyre has no rates -> Beirut's; its year starts in February (start = 50), month index is calendar
    mb = (1.12) ** (1 / 12)
    assert out[("Tyre", dt.date(2020, 2, 1), "Boom")] == pytest.approx(50 + 50 * (mb - 1))
    assert out[("Tyre", dt.date(2020, 4, 1), "Crash")] == pytest.approx(60 + 50 * ((0.88) ** (3 / 12) - 1))
    assert out[("Bekaa", dt.date(2018, 5, 1), "Crash")] == 70.0          # year without rates
    assert out[("Bekaa", dt.date(2020, 3, 1), "Baseline")] == 110.0
    piv = S.pivot_scenarios(S.scenario_projection(s, rates, "Beirut")).count()
    assert piv == 5


def test_spine_and_indexes(spark):
    s = spark.createDataFrame([("a", dt.date(2020, m, 1), float(m)) for m in range(1, 13)] +
                              [("b", dt.date(2020, m, 1), float(m)) for m in range(5, 9)],
                              "city string, month date, v double")
    sp = S.future_spine(s, 48).where("city = 'a'").orderBy("date").collect()
    assert len(sp) == 48 and sp[0].date == dt.date(2021, 1, 1) and sp[0].time_index == 12
    assert sp[-1].date == dt.date(2024, 12, 1) and sp[-1].time_index == 59
    g = S.time_index_global(s).orderBy("time_index").collect()
    want = sorted(s.collect(), key=lambda r: (r.month, r.city))
    assert [(r.city, r.month) for r in g] == [(r.city, r.month) for r in want]
    assert [r.time_index for r in g] == list(range(16))


def test_f12_price_features(spark):
    rows = []
    for i in range(10):
        rows.append((i, "D10", "P", "C", "Apartment", 100.0, 2, 1, 1000.0 + i * 10, 1.0, 2.0))
    for i in range(9):
        rows.append((100 + i, "D9", "P", "C", "Apartment", 50.0, 0, 0, 500.0 + i * 5, 1.0, 2.0))
    rows += [(200, "D10", "P", "C", "Apartment", 0.0, 1, 1, 10.0, 1.0, 2.0),     # size 0
             (201, "D10", "P", "C", "Land", 100.0, 1, 1, 10.0, 1.0, 2.0),        # other type
             (202, "D10", "P", "C", "Apartment", 100.0, 1, 1, None, 1.0, 2.0)]   # no price
    props = spark.createDataFrame(rows, "listing_id long, district string, province string, city string, "
                                        "type string, size_m2 double, bedrooms int, bathrooms int, price double, "
                                        "latitude double, longitude double")
    f = {r.listing_id: r for r in FE.price_features(props, "Apartment", 10, (0.0, 1.0)).collect()}
    assert set(f) == set(range(10)) | set(range(100, 109))
    assert f[100].district == "Other" and f[0].district == "D10"          # 9 rows rare, 10 kept
    assert f[100].bedrooms is None and f[100].bed_bath_ratio is None      # 0 rooms -> missing
    assert f[0].bed_bath_ratio == 2.0 and f[0].size_per_bedroom == 50.0
    assert f[100].avg_size_in_district == 50.0                            # mean before folding


def test_f13_sessions(spark):
    schema = "id string, messages array<struct<role:string,content:string>>, created_at timestamp"
    s = spark.createDataFrame([
        ("a", [("user", "hi")], dt.datetime(2024, 1, 1)),
        ("b", [("system", "sys"), ("user", "مرحبا")], dt.datetime(2024, 1, 2)),
        ("c", [], dt.datetime(2024, 1, 3)),
    ], schema)
    w = {r.id: r.messages for r in SE.with_system_prompt(s, "P").collect()}
    assert w["a"][0].role == "system" and len(w["a"]) == 2
    assert len(w["b"]) == 2 and w["b"][0].content == "sys"
    assert len(w["c"]) == 1
    ex = SE.explode_messages(s).collect()
    assert [(r.conv_id, r.pos, r.role) for r in ex] == [("a", 0, "user"), ("b", 0, "user")]
    assert SE.latest_session(s).first().id == "c"
    assert SE.session_messages(s, "zzz").first().messages == []
    new = SE.append_turn(s.where("id = 'a'").select("id", "messages"), "q", "r")
    up = SE.upsert(s.select("id", "messages"), new)
    again = SE.upsert(up, new)
    assert sorted((r.id, len(r.messages)) for r in up.collect()) == [("a", 3), ("b", 2), ("c", 0)]
    assert sorted((r.id, len(r.messages)) for r in again.collect()) == \
        sorted((r.id, len(r.messages)) for r in up.collect())           # idempotent
    ar = s.select(F.exists("messages", lambda m: T.contains_arabic(m["content"])).alias("x")).collect()
    assert [r.x for r in ar] == [False, True, False]


def test_f14_dashboard(spark):
    roll = spark.createDataFrame(
        [(f"D{i:02d}", 100 + i, 1000 + i, 10 + i, 400 + i) for i in range(22)] +
        [("DZZ", 100, None, 5, 400), ("DAA", 100, 1021, 50, 1)],
        "district string, avg_price long, max_price long, min_price long, listings_count long")
    top = R.top_n(roll, "max_price", 20, True, ["district"]).collect()
    assert len(top) == 20 and [r.district for r in top[:2]] == ["D21", "DAA"]  # tie on 1021 -> name order
    hot = {r.district for r in R.filter_gt(roll, "listings_count", 400).collect()}
    assert "D00" not in hot and "DZZ" not in hot and "D01" in hot         # exactly 400 is not hot
    series = spark.createDataFrame([("Beirut", 5), ("Aley", 1), ("Beirut", 5)],
                                   "city string, transaction_number int")
    k = R.kpi_cards(roll, series).first()
    assert (k.region_max, k.max_num, k.region_min, k.min_num) == ("D21", 1021, "DZZ", 5)
    assert (k.region_tran, k.high_num) == ("Beirut", 10)
    assert R.kpi_cards(roll, series, most_by="first_city").first().region_tran == "Aley"
    types = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,), (None,)], "type string")
    assert [(r.name, r.value) for r in R.count_by_type(types).collect()] == [(None, 3), ("b", 2), ("a", 1)]
    page = R.page_range(spark.range(100).withColumn("type", F.lit("x")), "type", 0, 50, ["id"])
    assert page.count() == 51


def test_f15_metrics(spark):
    exact = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "y double, y_hat double")
    m = FE.regression_metrics(exact).first()
    assert (m.mae, m.rmse, m.mape, m.r2) == (0.0, 0.0, 0.0, 1.0)
    off = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, y_hat double")
    m = FE.regression_metrics(off).first()
    assert m.mae == 1.0 and m.rmse == 1.0 and m.r2 == 0.0 and m.mape == pytest.approx(200 / 3)


def test_scalar_traps(spark):
    df = spark.createDataFrame([(12250.0, "10", "5+", 5116.235)], "x double, s string, p string, r double")
    r = df.select(N.round_hundreds("x").alias("a"), T.strip_decimal_zero("s").alias("b"),
                  T.strip_plus("p").alias("c"), N.round_to("r", 2).alias("d"),
                  N.safe_ratio(F.lit(1), F.lit(0)).alias("e"),
                  N.pct_change(F.lit(0.0), F.lit(5.0)).alias("f"),
                  N.trend_direction(F.lit(0.5)).alias("g"),
                  N.radius_bucket(F.lit(2001), K.RADIUS_STEPS, K.RADIUS_DEFAULT, K.RADIUS_SCALE).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (12200, "10", 5, 5116.23, None, None, "neutral", 7000)
    assert T.split_param_list(" a, b,a, ,") == ["a", "b"]
    with pytest.raises(ValueError):
        T.split_param_list("a,,a")


def test_turns_long_form(spark):
    from plotline.operators import turns as TU
    t = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "c")] +
        [(3, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(5000)],
        "conv_id long, turn long, role string, text string")
    f = {r.id: r for r in TU.flags(t).collect()}
    assert (f[1].has_system, f[1].n_messages, f[2].has_system, f[3].n_messages) == (False, 2, True, 5000)
    s = {r.id: r for r in TU.summary(TU.with_system_prompt(t, "P")).collect()}
    assert (s[1].first_role, s[1].first_content, s[1].n_messages) == ("system", "P", 3)
    assert (s[2].first_content, s[2].n_messages) == ("s", 2)
    ids = TU.flags(t).where("has_system").select(F.col("id").alias("conv_id"))
    up = {r.id: r for r in TU.summary(TU.upsert(t, TU.append_turn(t, ids, "q", "r"))).collect()}
    assert (up[2].n_messages, up[2].last_content, up[1].n_messages, up[3].n_messages) == (4, "r", 2, 5000)
    ex = TU.explode(t).where("conv_id = 2").collect()
    assert [(r.pos, r.role) for r in ex] == [(0, "user")]


def test_rounding_noise_and_iso(spark):
    from plotline.functions.dates import parse_iso
    df = spark.createDataFrame([(2.5, "2024-02-29"), (-2.5, "2023-12-31"), (2.4999, "2020-01-01")],
                               "x double, s string")
    r = df.select(N.round_half_up("x").alias("u"), parse_iso("s").alias("d")).collect()
    assert [x.u for x in r] == [3, -2, 2]                     # browser Math.round: half up
    assert r[0].d == dt.date(2024, 2, 29)
    rates = spark.createDataFrame([(2020, "X", "boom", 0.12), (2020, "X", "crash", -0.12)],
                                  "year int, city string, scenario string, annual_rate double")
    s = _series(spark, [("X", dt.date(2020, m, 1), 100.0) for m in range(1, 13)])
    a = S.scenario_projection(s, rates, "X", noise_seed=7).where("scenario = 'Boom'").orderBy("date").collect()
    b = S.scenario_projection(s, rates, "X", noise_seed=7).where("scenario = 'Boom'").orderBy("date").collect()
    plain = S.scenario_projection(s, rates, "X").where("scenario = 'Boom'").orderBy("date").collect()
    assert [x.transaction_value for x in a] == [x.transaction_value for x in b]     # seeded: repeatable
    for x, p in zip(a, plain):
        assert abs(x.transaction_value / p.transaction_value - 1) <= 0.015 + 1e-12


def test_turn_positions_across_buckets(spark):
    from plotline.operators import turns as TU
    rows = [(7, i, "system" if i % 50 == 0 else "user", f"m{i}") for i in range(0, 3000, 3)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [(r[1], r[2]) for r in rows if r[2] != "system"]
    for b in (7, 100, 10_000):
        got = sorted((r.pos, r.text) for r in TU.explode(t, bucket=b).collect())
        assert [p for p, _ in got] == list(range(len(want)))
        assert [x for _, x in got] == [f"m{turn}" for turn, _ in want]


def test_series_values_keep_three_decimals(spark):
    df = spark.createDataFrame([("a", "2020-01-05", "179.672"), ("a", "2020-01-09", "0.004"), ("a", "2020-01-20", "n/a"),
                                ("a", "2020-02-01", "1e17"), ("a", "2020-02-02", None)], "city string, d string, v string")
    got = {str(r.month): r.total_value for r in S.monthly_total_by_city(df, "city", "d", "v", "yyyy-MM-dd").collect()}
    assert got == {"2020-01-01": 179.676, "2020-02-01": 1e17}
    num = spark.createDataFrame([("a", 0.004), ("a", 0.002)], "city string, v double")
    assert num.agg(N.money_avg("v").alias("m")).first().m == 0.003


def test_metrics_and_correlation_are_total(spark):
    zero = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, y_hat double")
    m = FE.regression_metrics(zero).first()
    assert m.mape == 50.0 and m.r2 == 0.0
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "y double, y_hat double")
    m = FE.regression_metrics(flat).first()
    assert m.mape is None and m.r2 is None and m.mae == 1.0
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0)], "a double, b double, c double")
    r = {(x.col_a, x.col_b): x.r for x in FE.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(r) == 9 and r["a", "a"] == 1.0 and r["a", "c"] == 1.0 and r["b", "b"] is None and r["a", "b"] is None


def test_noise_does_not_depend_on_the_layout(spark):
    from plotline.functions.numeric import uniform_noise
    df = spark.range(500)
    one = {r.id: r.f for r in df.coalesce(1).select("id", uniform_noise(7, "id").alias("f")).collect()}
    many = {r.id: r.f for r in df.repartition(7).select("id", uniform_noise(7, "id").alias("f")).collect()}
    assert one == many and all(0.985 <= f < 1.015 for f in one.values()) and len(set(one.values())) > 400


def test_append_replies_with_metadata(spark):
    from plotline.operators import turns as TU
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")],
                              "conv_id long, turn long, role string, text string")
    replies = spark.createDataFrame(
        [(1, "q1", "r1", '{"total_tokens": 7}'), (9, "q9", "r9", None)],
        "conv_id long, question string, reply string, metadata string").withColumn("metadata", F.parse_json("metadata"))
    new = TU.append_replies(t, replies)
    tokens = F.variant_get("metadata", "$.total_tokens", "int")
    got = sorted(map(tuple, new.select("conv_id", "turn", "role", "text", tokens).collect()))
    assert got == [(1, 0, "user", "a", None), (1, 1, "assistant", "b", None), (1, 2, "user", "q1", None),
                   (1, 3, "assistant", "r1", 7), (9, 0, "user", "q9", None), (9, 1, "assistant", "r9", None)]
    again = TU.append_replies(new, replies.where("conv_id = 1"))  # earlier metadata is kept
    assert sorted(r[0] for r in again.select(tokens).collect() if r[0]) == [7, 7] and again.count() == 6
    assert TU.append_replies(t, replies.limit(0)).count() == 0
