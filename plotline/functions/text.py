"""String cleaning and parsing expressions for listing text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["clean_price", "clean_rent", "clean_size", "clean_room_count", "strip_decimal_zero",
           "strip_suffix_words", "format_address", "address_part", "extract_first_match",
           "extract_by_priority", "canonical_contains", "canonical_contains_ci",
           "capitalize_label", "strip_plus", "contains_arabic", "split_param_list",
           "not_contains_ci", "coerce_numeric"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce_numeric(x) -> Column:
    """Text or number -> DOUBLE; anything unparsable -> NULL (``errors='coerce'``)."""
    return _c(x).try_cast("double")


def clean_price(x) -> Column:
    """``"$1,250,000"`` -> ``"1250000"`` (drops every ``$`` and ``,``; a character
    mapping, no regex)."""
    return F.translate(_c(x), "$,", "")


def clean_rent(x) -> Column:
    """``"$24,000 /Year"`` -> ``"24000"`` (drops ``$``, ``,`` and `` /Year``)."""
    return F.translate(F.replace(_c(x), F.lit(" /Year"), F.lit("")), "$,", "")


def clean_size(x) -> Column:
    """``"1,200 m²"`` -> ``"1200"`` (drops `` m²`` and ``,``)."""
    return F.translate(F.replace(_c(x), F.lit(" m²"), F.lit("")), ",", "")


def clean_room_count(x) -> Column:
    """Room text -> INT, NULL when not a number (``"N/A"``, ``"studio"``)."""
    return coerce_numeric(x).try_cast("int")


def strip_decimal_zero(x) -> Column:
    """Drop a trailing ``.0`` from a number's text (``"2.0"`` -> ``"2"``).

    The dot is escaped on purpose: an unescaped pattern would also eat the last
    two characters of ``"10"``.
    """
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def strip_suffix_words(x, words: Sequence[str] = (" Governorate", " district")) -> Column:
    out = _c(x)
    for w in words:
        out = F.replace(out, F.lit(w), F.lit(""))
    return out


def format_address(*parts) -> Column:
    return F.concat_ws(", ", *[_c(p) for p in parts])


def address_part(x, i: int) -> Column:
    """i-th comma part, trimmed; NULL when the text has fewer parts."""
    return F.trim(F.get(F.split(_c(x), ","), i))


def extract_first_match(x, names: Sequence[str]) -> Column:
    """Name that occurs first *by position in the text* (leftmost match of the
    alternation; at equal positions the earlier listed name); NULL when none occurs.
    One compiled regex per row measured faster than per-name ``instr`` positions."""
    pattern = "(" + "|".join(re.escape(n) for n in names) + ")"
    return F.nullif(F.regexp_extract(_c(x), pattern, 1), F.lit(""))


def extract_by_priority(x, names: Sequence[str], aliases: dict | None = None) -> Column:
    """First name *in list order* contained in the text, with alias mapping."""
    aliases = aliases or {}
    out = None
    for n in names:
        val = F.lit(aliases.get(n, n))
        out = F.when(F.contains(_c(x), F.lit(n)), val) if out is None else \
            out.when(F.contains(_c(x), F.lit(n)), val)
    return out


def canonical_contains(x, labels: Sequence[tuple[str, str]]) -> Column:
    """Exact (case-sensitive) label inside the text -> short name, else unchanged."""
    out = _c(x)
    for needle, short in reversed(list(labels)):
        out = F.when(F.contains(_c(x), F.lit(needle)), F.lit(short)).otherwise(out)
    return out


def canonical_contains_ci(x, needles: Sequence[tuple[str, str]]) -> Column:
    """Lower-cased needle inside lower(text) -> short name, else lower(text)."""
    low = F.lower(_c(x))
    out = low
    for needle, short in reversed(list(needles)):
        out = F.when(F.contains(low, F.lit(needle)), F.lit(short)).otherwise(out)
    return out


def capitalize_label(x) -> Column:
    return F.initcap(_c(x))


def strip_plus(x) -> Column:
    """``"5+"`` -> 5."""
    return F.replace(_c(x), F.lit("+"), F.lit("")).try_cast("int")


def contains_arabic(x) -> Column:
    return _c(x).rlike("[\\x{0600}-\\x{06FF}]")


def not_contains_ci(x, needle: str) -> Column:
    return ~F.lower(_c(x)).contains(needle.lower())


def split_param_list(text: str, min_items: int = 2) -> list[str]:
    """Request parameter ``"a, b,a"`` -> ``["a", "b"]``: trimmed, empties and repeats
    dropped, order kept.  Raises when fewer than ``min_items`` remain.
    """
    seen: list[str] = []
    for part in (text or "").split(","):
        p = part.strip()
        if p and p not in seen:
            seen.append(p)
    if len(seen) < min_items:
        raise ValueError(f"need at least {min_items} distinct items, got {seen}")
    return seen
