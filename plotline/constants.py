"""Fixed values whose exact text the results depend on.

FIXED VALUES -- these must equal the source application's lists and tables for
right results; they are stated here plainly, in their natural order.
"""

from __future__ import annotations

# FIXED VALUES: provinces, in the order the sale/yearly-rent parser tries them.
PROVINCES = ["Mount Lebanon", "South", "Bekaa", "North", "Beirut", "Nabatieh"]

# FIXED VALUES: nightly-rent parser: same list plus one alias, tried in this order.
NIGHT_PROVINCES = ["Mount Lebanon", "South", "Bekaa", "North", "Beirut", "Nabatieh",
                   "Jabal Lubnan"]
PROVINCE_ALIASES = {"Jabal Lubnan": "Mount Lebanon"}

# FIXED VALUES: districts accepted from the second comma part of an address.
DISTRICTS = [
    "Hasbaya", "Marjaayoun", "Nabatieh", "Bint Jbeil", "Beirut", "Minieh-danniyeh",
    "Bcharre", "Tripoli", "Koura", "Akkar", "Zgharta", "Batroun", "Hermel", "West Bekaa",
    "Zahle", "Baalbeck", "Rachaiya", "Jezzine", "Tyre", "Saida", "Aley", "Baabda", "Chouf",
    "El Metn", "Jbeil", "Kesrouane",
]

# FIXED VALUES: district coordinates (District, latitude N, longitude E).
DISTRICT_COORDS = [
    ("Akkar", 34.5394, 36.0780), ("Baalbek", 34.0059, 36.2181),
    ("Batroun", 34.2556, 35.6586), ("Beirut", 33.8886, 35.4955),
    ("Bint Jbeil", 33.1184, 35.4331), ("Bsharri", 34.2508, 36.0100),
    ("Chouf", 33.6947, 35.5792), ("Hasbaya", 33.3979, 35.6852),
    ("Hermel", 34.3954, 36.3845), ("Jezzine", 33.5338, 35.5848),
    ("Kesrouane", 33.9808, 35.6856), ("Koura", 34.3294, 35.7931),
    ("Marjeyoun", 33.3616, 35.5914), ("Matn", 33.9006, 35.6178),
    ("Minieh-Danniyeh", 34.4864, 36.0163), ("Nabatieh", 33.3772, 35.4824),
    ("Rachaiya", 33.4932, 35.8504), ("Saida", 33.5631, 35.3689),
    ("Tyre", 33.2731, 35.2032), ("West Bekaa", 33.5786, 35.7448),
    ("Zahle", 33.8461, 35.9042), ("Zgharta", 34.3314, 35.8958),
    ("Aley", 33.8056, 35.5978), ("Baabda", 33.8333, 35.5442),
    ("El Metn", 33.9006, 35.6178), ("Jbeil", 34.1236, 35.6455),
]

# FIXED VALUES: coordinates of the five transaction-series regions.
REGION_COORDS = [
    ("Beirut", 33.8965, 35.4829),
    ("Bekaa", 33.9105, 35.9631),
    ("Baabda, Aley, Chouf", 33.7779, 35.5737),
    ("Kesrouan, Jbeil", 34.1145, 35.6634),
    ("Tripoli, Akkar", 34.4887, 35.9544),
]

# FIXED VALUES: annual scenario rates, (year, city, crash, boom).
SCENARIO_RATES = [
    (2019, "Beirut", -0.07, 0.03), (2019, "Bekaa", -0.05, 0.02), (2019, "Tripoli", -0.06, 0.03),
    (2019, "Baabda", -0.04, 0.03), (2019, "Kesrouan", -0.03, 0.04),
    (2020, "Beirut", -0.175, 0.05), (2020, "Bekaa", -0.125, 0.04), (2020, "Tripoli", -0.15, 0.05),
    (2020, "Baabda", -0.12, 0.06), (2020, "Kesrouan", -0.10, 0.07),
    (2021, "Beirut", -0.10, 0.075), (2021, "Bekaa", -0.08, 0.065), (2021, "Tripoli", -0.09, 0.075),
    (2021, "Baabda", -0.07, 0.085), (2021, "Kesrouan", -0.06, 0.095),
    (2022, "Beirut", -0.035, 0.10), (2022, "Bekaa", -0.025, 0.085), (2022, "Tripoli", -0.035, 0.095),
    (2022, "Baabda", -0.02, 0.11), (2022, "Kesrouan", -0.02, 0.12),
    (2023, "Beirut", -0.01, 0.125), (2023, "Bekaa", -0.005, 0.10), (2023, "Tripoli", -0.01, 0.11),
    (2023, "Baabda", -0.005, 0.12), (2023, "Kesrouan", 0.02, 0.14),
    (2024, "Beirut", 0.02, 0.15), (2024, "Bekaa", 0.03, 0.125), (2024, "Tripoli", 0.02, 0.135),
    (2024, "Baabda", 0.03, 0.145), (2024, "Kesrouan", 0.04, 0.17),
    (2025, "Beirut", 0.03, 0.17), (2025, "Bekaa", 0.04, 0.15), (2025, "Tripoli", 0.03, 0.16),
    (2025, "Baabda", 0.04, 0.17), (2025, "Kesrouan", 0.05, 0.185),
]
DEFAULT_RATE_CITY = "Beirut"

# FIXED VALUES: selection label -> series city (case-sensitive, scenario page).
SCENARIO_CITY_LABELS = [("Tripoli, Akkar", "Tripoli"), ("Baabda, Aley, Chouf", "Baabda"),
                        ("Kesrouan, Jbeil", "Kesrouan")]
# FIXED VALUES: lower-case needle -> series city (forecast page).
FORECAST_CITY_NEEDLES = [("tripoli", "tripoli"), ("baabda", "baabda"), ("kesrouan", "kesrouan")]

# FIXED VALUES: forecast model feature order.
FORECAST_NUMERIC_FEATURES = ["time_index", "year", "month", "quarter", "month_sin", "month_cos",
                             "is_december", "is_summer", "is_quarter_end", "monthly_avg",
                             "city_avg", "post_2013"]
# FIXED VALUES: forecast booster.
FORECAST_BOOST = dict(rounds=500, depth=4, rate=0.05, subsample=0.8, colsample=0.8, gamma=1.0, alpha=0.5, lam=1.0,
                      min_child=3.0, seed=42)
FORECAST_PATIENCE = 50
FORECAST_SPLIT_DATE = "2016-01-01"
FORECAST_HORIZON_MONTHS = 48

# FIXED VALUES: price model features.
PRICE_NUMERIC_FEATURES = ["log_size_m2", "bedrooms", "bathrooms", "latitude", "longitude",
                          "bed_bath_ratio", "size_per_bedroom"]
PRICE_CATEGORICAL_FEATURES = ["province", "district", "city"]
# FIXED VALUES: price booster grid (32 settings) and folds.
PRICE_GRID = {"rounds": [1000, 1500], "rate": [0.01, 0.02], "depth": [6, 8], "subsample": [0.7, 0.8],
              "colsample": [0.7, 0.8]}
PRICE_FOLDS = 5
# FIXED VALUES: fields that a price request must have.
ESTIMATE_REQUIRED = ["province", "district", "city", "size_m2", "bedrooms", "bathrooms", "latitude", "longitude"]

# FIXED VALUES: thresholds.
HOT_AREA_MIN_LISTINGS = 400
TREND_NEUTRAL_BAND = 0.5
RARE_DISTRICT_MIN_ROWS = 10
TRIM_QUANTILES = (0.01, 0.99)
ESTIMATE_RANGE = 0.10
PAGE_LAST_INDEX = 50
TOP_DISTRICTS = 20

# FIXED VALUES: map circle radius steps (listings <= bound -> radius units), else 70; x100 m.
RADIUS_STEPS = [(100, 14), (500, 20), (1000, 30), (2000, 40)]
RADIUS_DEFAULT = 70
RADIUS_SCALE = 100

# FIXED VALUES: default system prompt role marker for chat sessions.
SYSTEM_ROLE = "system"

# FIXED VALUES: markup of a listing page (tag and class of the section, of a card and of its fields).
HTML_SECTION = ("section", "max-w-[1366px] mx-auto")
HTML_CARD = ("div", "flex my-7 mx-2.5 flex-col min-[1090px]:flex-row")
HTML_ADDRESS = ("address", "poppins-light property-location flex items-center gap-[5px]")
HTML_PRICE = ("p", "text-[#AD2F36] font-bold text-[18px] mt-2")
HTML_TYPE = ("div", "max-[344px]:mr-[5px] max-[344px]:pr-[5px] pr-3 mr-3 fixInSmallScreen")
HTML_ROOMS = ("div", "max-[344px]:mr-[5px] max-[344px]:pr-[5px] pr-2 mr-3")
HTML_AREA_UNIT = "m²"
# FIXED VALUES: tags that have no end tag.
HTML_VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
