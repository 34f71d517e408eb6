"""File and document sources: headered CSV, JSON listing pages, HTML listing pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from plotline import constants as K

# Scraped listing files (all text; "N/A" is missing).
RAW_LISTING_SCHEMA = "Address string, Price string, Type string, Size string, Bedrooms string, Bathrooms string"

# One element of data.boostedProperties / data.docs in a listing API page.
JSON_LISTING_FIELDS = ["title_en", "price", "bedroom_value", "bathroom_value", "area", "furnished",
                       "district_id", "province_id", "community_id"]
JSON_PAGE_SCHEMA = ("data struct<boostedProperties: array<map<string,string>>, "
                    "docs: array<map<string,string>>>")
JSON_OUTPUT_NAMES = ["Title", "Price", "Bedroom", "Bathroom", "Area sqm", "Furnished",
                     "DistrictID", "ProvinceID", "CommunityID"]


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType,
             null_value: str = "N/A") -> DataFrame:
    """Headered CSV with a declared schema (never inferred); ``N/A`` reads as NULL.
    Several paths (one file per region, say) read as one table."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_value)
            .option("mode", "PERMISSIVE").csv(list(paths) if not isinstance(paths, str) else paths))


def scan_json_listings(pages: DataFrame, text_col: str = "json") -> DataFrame:
    """Listing API pages (one JSON document per row) -> one row per listing.

    ``data.boostedProperties`` and ``data.docs`` are concatenated (an absent array
    counts as empty); a missing field becomes ``''``.
    """
    doc = F.from_json(F.col(text_col), JSON_PAGE_SCHEMA)
    empty = F.array().cast("array<map<string,string>>")
    items = F.concat(F.coalesce(doc["data"]["boostedProperties"], empty),
                     F.coalesce(doc["data"]["docs"], empty))
    keep = [c for c in pages.columns if c != text_col]
    x = pages.select(*keep, F.posexplode(items).alias("item_pos", "_it"))
    return x.select(*keep, "item_pos", *[
        F.coalesce(F.col("_it")[f], F.lit("")).alias(n) for f, n in zip(JSON_LISTING_FIELDS, JSON_OUTPUT_NAMES)])


def scan_json_locations(pages: DataFrame, text_col: str = "json") -> DataFrame:
    """Location pages ``{"pageProps": {"locations": [...]}}`` -> one row per location
    (id, province_id, name_en, name_ar, copy_field_en, copy_field_ar; ``''`` where a field
    is absent); pages without locations yield nothing."""
    schema = ("pageProps struct<locations: array<struct<id: string, province_id: string, "
              "name_en: string, name_ar: string, copy_field_en: string, copy_field_ar: string>>>")
    doc = F.from_json(F.col(text_col), schema)
    names = ["id", "province_id", "name_en", "name_ar", "copy_field_en", "copy_field_ar"]
    return pages.select(F.explode(doc["pageProps"]["locations"]).alias("_l")).select(
        *[F.coalesce(F.col("_l")[c], F.lit("")).alias(c) for c in names])


# ------------------------------ HTML listing cards --------------------------------

HTML_FIELDS = ["Address", "Price", "Type", "Size", "Bedrooms", "Bathrooms"]
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.ASCII | re.IGNORECASE | re.DOTALL)
#: One tag: slash, name, the rest up to ">", the text up to the next tag.
_TAG = re.compile(r"<(?=[/a-zA-Z])(/?)([a-zA-Z0-9]*)([^>]*)>([^<]*)")
_CLASS = re.compile(r"""\sclass\s*=\s*["']([^"']*)["']""", re.ASCII | re.IGNORECASE)
_CLASS_BEYOND = re.compile(r"""<[^>]*?\sclass\s*=\s*["']([^"']*)["']""", re.ASCII | re.IGNORECASE)
#: Outer white space; a last line or paragraph separator may follow it.
_OUTER = re.compile(r"\A\s+|\s+(?=[\x85\u2028\u2029]?\Z)", re.ASCII)
_SEPARATORS = frozenset("\x85\u2028\u2029")
_ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_VOID = frozenset(K.HTML_VOID_TAGS)


def _stripped(text: str) -> str:
    return _OUTER.sub("", text) if text[-1:] in _SEPARATORS else text.strip(" \t\n\x0b\f\r")


def html_tokens(html: str) -> Iterator[tuple[bool, str, str, str, int]]:
    """The tags of a page: opens, tag, cls (of opening tags), text (up to the next tag,
    common entities resolved) and the number of elements open after it.  Comments, scripts
    and styles are left out; void tags open nothing."""
    depth = 0
    for slash, tag, rest, text in _TAG.findall(_HIDDEN.sub("", html)):
        tag = tag.lower()
        cls = ""
        if slash:
            depth -= tag not in _VOID
        else:
            depth += tag not in _VOID and not rest.endswith("/")
            if "class" in rest.lower():
                # a quoted value may hold a ">"
                found = _CLASS.search(rest) or _CLASS_BEYOND.match(f"<{tag}{rest}>{text}")
                cls = found[1] if found else ""
        if "&" in text:
            for entity, char in _ENTITIES:
                text = text.replace(entity, char)
        yield not slash, tag, cls, text, depth


def _cards(html: str) -> Iterator[list[tuple]]:
    """The tags of each card in the first listing section of a page."""
    floor = own = None          # depths of the section and of the card that tags belong to
    card: list[tuple] = []
    for token in html_tokens(html):
        opens, tag, cls, _, depth = token
        if floor is None:
            if not (opens and (tag, cls) == K.HTML_SECTION):
                continue
            floor = depth
        if depth < floor:
            break
        if opens and (tag, cls) == K.HTML_CARD:
            if card:
                yield card
            card, own = [], depth
        elif own is not None and depth < own:
            own = None
        if own is not None:
            card.append(token)
    if card:
        yield card


def _card_fields(card: list[tuple]) -> list[str | None]:
    """``HTML_FIELDS`` of one card.  An element's text ends where the depth falls below it."""
    found: dict[tuple[str, str], list[str]] = {s: [] for s in (K.HTML_ADDRESS, K.HTML_PRICE, K.HTML_TYPE, K.HTML_ROOMS)}
    size = None
    for i, (opens, tag, cls, _, depth) in enumerate(card):
        plain = tag == "div" and cls == "" and size is None
        if not opens or not plain and (tag, cls) not in found:
            continue
        parts = []
        for j in range(i, len(card)):
            if card[j][4] < depth and j > i:
                break
            parts.append(card[j][3])
        if plain:
            text = _stripped("".join(map(_stripped, parts)))
            if K.HTML_AREA_UNIT in text:
                size = text
        else:
            found[(tag, cls)].append(_stripped("".join(parts)))
    rooms = [text.split(" ", 1)[0] or None for text in found[K.HTML_ROOMS][:2]] + [None, None]
    first = [next(iter(found[s]), None) or None for s in (K.HTML_ADDRESS, K.HTML_PRICE, K.HTML_TYPE)]
    return [*first, size, *rooms[:2]]


def scan_html_listings(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> DataFrame:
    """HTML pages -> one row a listing card: ``key``, pos (of the card, from 0), Address,
    Price, Type, Size, Bedrooms, Bathrooms; NULL when absent or empty.

    Cards count inside the page's first listing section only, whatever is nested in them.
    A card ends where the depth falls below its own; a card inside a card starts one of its
    own.  Size is the text of the first division without a class that holds an area unit;
    rooms are the first words of the first and the second room block.

    Every page is read once, tag by tag, where it lies: nothing is shuffled or sorted, and
    a task holds the cards of one batch of pages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, fields = [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for n, card in enumerate(_cards(html)):
                    at.append(i)
                    pos.append(n)
                    fields.append(_card_fields(card))
            columns = list(zip(*fields)) or [()] * len(HTML_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()),
                 *[pa.array(c, pa.string()) for c in columns]], names=[key, "pos", *HTML_FIELDS])

    schema = StructType([pages.schema[key], StructField("pos", IntegerType()), *[StructField(c, StringType()) for c in HTML_FIELDS]])
    return pages.where(F.contains(html_col, F.lit(K.HTML_CARD[1]))).select(key, html_col).mapInArrow(run, schema)


def page_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Navigation links of each page: (page_id, pos, href, label)."""
    rx = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    items = F.regexp_extract_all(F.col(html_col), F.lit(r'<li><a href="[^"]*">[^<]*</a></li>'), 0)
    x = pages.select("page_id", F.posexplode(items).alias("pos", "_a"))
    return x.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                    F.regexp_extract("_a", rx, 1).alias("href"), F.regexp_extract("_a", rx, 2).alias("label"))
