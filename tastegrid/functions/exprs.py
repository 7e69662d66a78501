"""Scalar column expressions.

Everything here is a composition of built-in Spark functions so it stays
inside whole-stage code generation; nothing crosses into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastegrid import constants as K

__all__ = [
    "round6", "attributes_text", "wide_attributes_text", "soup_expr", "split_categories",
    "clamp_rating", "parse_ts", "alpha_expr", "activity_level", "is_elite",
    "hour_token_minutes", "open_now", "normalize_cf", "clip01", "json_key", "fixed", "round_half_up",
]


def round_half_up(x: Column, n: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: the same IEEE operations in every engine, unlike round()."""
    scale = float(10 ** n)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fixed(x: Column, n: int) -> Column:
    """Non-negative number as text with n decimals, half-up on the scaled double.

    Done with integer arithmetic so that every engine prints the same digits
    (printf-style formatting rounds half-way cases differently across runtimes).
    """
    scale = 10 ** n
    s = F.floor(x.cast("double") * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    return F.concat((s / F.lit(scale)).cast("long").cast("string"), F.lit("."),
                    F.lpad(F.pmod(s, F.lit(scale)).cast("string"), n, "0"))


def round6(c: Column | str) -> Column:
    """Round doubles to 6 decimals so that results compare across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def attributes_text(m: Column | str) -> Column:
    """Map -> "k v k v"; a null value keeps the key and leaves an empty word."""
    m = F.col(m) if isinstance(m, str) else m
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, " "), F.lit(""))


def wide_attributes_text(columns: list[str]) -> Column:
    """P7: "col value" for each non-blank column; nan / none / null in any case are skipped."""
    parts = []
    for c in columns:
        v = F.trim(F.col(c).cast("string"))
        valid = v.isNotNull() & (v != "") & ~F.lower(v).isin("nan", "none", "null")
        parts.append(F.when(valid, F.concat(F.lit(c + " "), v)))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def soup_expr(name: Column, categories: Column, attributes: Column) -> Column:
    """P5: lower(name + " " + categories + " " + attributes) with nulls as ""."""
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(categories, F.lit("")),
                            F.lit(" "), F.coalesce(attributes, F.lit(""))))


def split_categories(c: Column | str) -> Column:
    """Split on comma, trim, drop blanks; null -> []."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def clamp_rating(c: Column | str) -> Column:
    """max(1, min(5, stars))."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(K.MIN_RATING), F.least(F.lit(K.MAX_RATING), c.cast("double")))


def parse_ts(c: Column | str) -> Column:
    """Unparseable text -> null instead of an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c)


def alpha_expr(n: Column | str, min_alpha: float = K.MIN_ALPHA, e_fold: float = K.ALPHA_E_FOLD) -> Column:
    """H1: clip(m + (1 - m) * exp(-max(n, 0) / e_fold), m, 1)."""
    n = F.col(n) if isinstance(n, str) else n
    n0 = F.greatest(F.coalesce(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    a = F.lit(min_alpha) + F.lit(1.0 - min_alpha) * F.exp(-n0 / F.lit(e_fold))
    return F.least(F.greatest(a, F.lit(min_alpha)), F.lit(1.0))


def activity_level(n: Column | str) -> Column:
    """< 5 low, < 25 medium, else high."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n < K.LEVEL_LOW_BELOW, "low")
            .when(n < K.LEVEL_MEDIUM_BELOW, "medium").otherwise("high"))


def is_elite(elite_year_count: Column, elite: Column) -> Column:
    """Elite when elite_year_count > 0 or the elite text is not blank."""
    return (F.coalesce(elite_year_count.cast("long"), F.lit(0)) > 0) | (F.trim(F.coalesce(elite.cast("string"), F.lit(""))) != "")


def hour_token_minutes(token: Column) -> Column:
    """"H:M" with 0 <= H <= 24, 0 <= M <= 59 and 24 only as 24:00 -> minutes, else null."""
    t = F.trim(token)
    parts = F.split(t, ":")
    ok_shape = F.size(parts) == 2
    h = F.when(ok_shape, F.trim(parts.getItem(0)).try_cast("int"))
    m = F.when(ok_shape, F.trim(parts.getItem(1)).try_cast("int"))
    valid = (h.isNotNull() & m.isNotNull() & (h >= 0) & (h <= 24) & (m >= 0) & (m <= 59)
             & ~((h == 24) & (m != 0)))
    return F.when(valid, h * 60 + m)


def open_now(hours_text: Column, now_minutes: Column) -> Column:
    """open = close -> always open; close > open -> [open, close); else overnight wrap.

    Null when the text is missing, has no "-" or a token does not parse.
    """
    has_dash = F.instr(hours_text, "-") > 0
    pos = F.instr(hours_text, "-")
    open_tok = F.substring_index(hours_text, "-", 1)
    close_tok = F.when(has_dash, hours_text.substr(pos + 1, F.lit(1 << 30)))
    o = hour_token_minutes(open_tok)
    c = hour_token_minutes(close_tok)
    res = (F.when(c == o, F.lit(True))
           .when(c > o, (now_minutes >= o) & (now_minutes < c))
           .otherwise((now_minutes >= o) | (now_minutes < c)))
    return F.when(has_dash & o.isNotNull() & c.isNotNull(), res)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def normalize_cf(rating: Column, lo: float = K.MIN_RATING, hi: float = K.MAX_RATING) -> Column:
    """H3: clip((r - lo) / (hi - lo), 0, 1); zero range -> 0."""
    if hi - lo <= 0:
        return F.lit(0.0)
    return clip01((rating - F.lit(lo)) / F.lit(hi - lo))


def json_key(props: Column | str, key: str) -> Column:
    props = F.col(props) if isinstance(props, str) else props
    return F.get_json_object(props, f"$.{key}")
