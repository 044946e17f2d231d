"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


# ---- text -------------------------------------------------------------------


def joined_text(a: Column, b: Column) -> Column:
    """Trimmed texts with two spaces between them; null counts as empty."""
    blank = F.lit("")
    return F.concat(F.trim(F.coalesce(a, blank)), F.lit("  "), F.trim(F.coalesce(b, blank)))


def words(text: Column) -> Column:
    """Split on runs of white space; no empty elements at the ends."""
    return F.split(F.trim(text), r"\s+")


def first_decimal(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+\.\d+)", 1), F.lit("")).cast("double")


def cylinder_count(text: Column) -> Column:
    """Digits after a capital V, null when absent."""
    return F.nullif(F.regexp_extract(text, r"V(\d+)", 1), F.lit("")).cast("int")


NUMBERED_NAME = r"^(.+?)(\d+)$"


def name_prefix(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, NUMBERED_NAME, 1), F.lit(""))


def name_number(name: Column) -> Column:
    return F.expr("try_cast(null as bigint)") if name is None else F.nullif(
        F.regexp_extract(name, NUMBERED_NAME, 2), F.lit("")
    ).try_cast("bigint")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s{2,}", " ")


def between_tags(text: Column, tag: str) -> Column:
    """Trimmed text of the first ``<tag>...</tag>``, null when the tag is absent."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    body = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(^\s+)|(\s+$)", "")
    return F.when(text.rlike(pattern), body)


def outer_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, the input when either is absent."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(part == "", text).otherwise(part)


def bare_reference(ref: Column, host: Column | str) -> Column:
    """Drop scheme, host prefix and query string; only for values that start with http."""
    host = F.lit(host) if isinstance(host, str) else host
    no_scheme = F.regexp_replace(ref, r"^[^:]*://", "")
    prefix = F.concat(host, F.lit("/"))
    no_host = F.when(
        F.startswith(no_scheme, prefix), F.substr(no_scheme, F.length(prefix) + 1)
    ).otherwise(no_scheme)
    return F.when(F.startswith(ref, F.lit("http")), F.substring_index(no_host, "?", 1)).otherwise(ref)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)


# ---- numbers ----------------------------------------------------------------


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; null stays null although least/greatest skip nulls."""
    out = x
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(x.isNotNull(), out)


def nan_to(x: Column, value: float) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(value)), F.lit(value))


def lenient_number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def threshold(p: Column, at: float = 0.5) -> Column:
    return (p > at).cast("int")


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Haversine distance in the unit of ``radius``."""
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def inverse_log1p(x: Column, cap: float = 20.0) -> Column:
    """expm1 with the argument limited first, so that it cannot overflow."""
    return F.expm1(clip(x, high=cap))


# ---- maps -------------------------------------------------------------------


def value_map(x: Column, mapping: Mapping, default=None) -> Column:
    """Fixed mapping as a CASE; other values give ``default``."""
    out = None
    for key, value in mapping.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default))


def as_list(text: Column) -> Column:
    """A JSON list as an array, a bare value as a one-element array."""
    return F.when(
        F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")
    ).otherwise(F.array(text))


# ---- dates ------------------------------------------------------------------


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def hour_of_clock(text: Column) -> Column:
    """Hour of ``HH:mm:ss``, null when the text is no time of day."""
    return F.hour(F.try_to_timestamp(text, F.lit("HH:mm:ss")))


def date_parts(d: Column) -> dict[str, Column]:
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.day(d),
        "hour": F.hour(d),
        "dayofyear": F.dayofyear(d),
        "weekday": weekday(d),
        "is_weekend": is_weekend(d),
    }


# ---- arrays -----------------------------------------------------------------


def argmax(p: Column) -> Column:
    """Position of the first largest element, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_positions(p: Column, k: int) -> Column:
    """Positions (from 0) of the k largest elements, ties by position."""
    keyed = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("pos")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["pos"])


def count_at_least(p: Column, at: float = 0.5) -> Column:
    return F.size(F.filter(p, lambda x: x >= at))


def grid(cells: list[Column], width: int) -> Column:
    """Flat columns as rows of ``width`` cells."""
    return F.array(*[F.array(*cells[i : i + width]) for i in range(0, len(cells), width)])


def grid_cell(g: Column, row: int, col: int) -> Column:
    return F.element_at(F.element_at(g, row + 1), col + 1)


def bucket_of_key(key: Column, buckets: int = 100) -> Column:
    """Stable pseudo-random bucket of a key, the same in every run and engine."""
    head = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return head % F.lit(buckets)
