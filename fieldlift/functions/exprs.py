"""Column expressions: normalisation, guarded arithmetic, banding, geography, response curves."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.7613

#: Call frequency per month by decile band and share band.
CALL_MATRIX = {
    ("Decile 9-10", "Low (<20%)"): 2.00,
    ("Decile 9-10", "Mid (20-50%)"): 1.50,
    ("Decile 9-10", "High (>50%)"): 0.75,
    ("Decile 7-8", "Low (<20%)"): 1.00,
    ("Decile 7-8", "Mid (20-50%)"): 0.75,
    ("Decile 7-8", "High (>50%)"): 0.25,
    ("Decile 1-6", "Low (<20%)"): 0.0,
    ("Decile 1-6", "Mid (20-50%)"): 0.0,
    ("Decile 1-6", "High (>50%)"): 0.0,
}
#: Census regions and their states.
CENSUS_REGIONS = {
    "Northeast": ["CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"],
    "Midwest": ["IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"],
    "South": ["DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"],
    "West": ["AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"],
}


def clean(c: Column) -> Column:
    """Upper case without outer blanks."""
    return F.upper(F.trim(c))


def zip5(c: Column, *, cut_at_dash: bool = True) -> Column:
    """Five digits with leading zeros; null stays null. ``cut_at_dash=False`` keeps the digits behind a dash, as plain SQL stripping does."""
    digits = F.regexp_replace(F.split_part(c, F.lit("-"), F.lit(1)) if cut_at_dash else c, "[^0-9]", "")
    return F.lpad(digits, 5, "0")


def zip3(c: Column, *, cut_at_dash: bool = True) -> Column:
    return F.substring(zip5(c, cut_at_dash=cut_at_dash), 1, 3)


def number(c: Column, kind: str = "double") -> Column:
    """A number or null; unreadable text is null, never an error."""
    return F.trim(c).try_cast(kind)


def sum_of(columns: Iterable[Column]) -> Column:
    """Row-wise sum in which a null counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])


def ratio(n: Column, d: Column) -> Column:
    """n / d for a positive d, else null."""
    return F.when(d > 0, n / d)


def growth(now: Column, before: Column, floor: float = 1.0) -> Column:
    """Change over a base that is at least ``floor``; null if either value is."""
    return F.when(before.isNotNull(), (now - before) / F.greatest(before, F.lit(floor)))


def collapse(c: Column, groups: Mapping[str, Iterable[str]], other: str) -> Column:
    """The group whose members hold the value, else ``other`` (nulls as well)."""
    chain = reduce(lambda acc, kv: acc.when(c.isin(*kv[1]), F.lit(kv[0])), groups.items(), F.when(F.lit(False), F.lit(other)))
    return chain.otherwise(F.lit(other))


def census_region(state: Column) -> Column:
    return collapse(F.upper(F.trim(state)), CENSUS_REGIONS, "Unknown")


def clip(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Clip a value; a null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bands ``[edge, next edge)``; values below the first edge and nulls are null."""
    chain = F.when(c.isNull() | (c < edges[0]), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels, strict=False):
        chain = chain.when(c < edge, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def decile_band(d: Column) -> Column:
    return F.when(d >= 9, "Decile 9-10").when(d >= 7, "Decile 7-8").otherwise("Decile 1-6")


def share_band(s: Column) -> Column:
    s = F.coalesce(s, F.lit(0.0))
    return F.when((s >= 0) & (s < 0.2), "Low (<20%)").when((s >= 0.2) & (s < 0.5), "Mid (20-50%)").when((s >= 0.5) & (s < 1.01), "High (>50%)").otherwise("Low (<20%)")


def size_band(c: Column) -> Column:
    return band(c, [0, 50, 200, 800], ["<50", "50-199", "200-799", "800+"])


def desired_calls(decile: Column, share: Column) -> Column:
    d, s = decile_band(decile), share_band(share)
    chain = reduce(lambda acc, kv: acc.when((d == kv[0][0]) & (s == kv[0][1]), F.lit(kv[1])), CALL_MATRIX.items(), F.when(F.lit(False), F.lit(0.0)))
    return chain.otherwise(0.0)


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def hill(calls: Column, ceiling: Column | float, half: Column | float) -> Column:
    """Saturating response: half of the ceiling at ``half`` calls."""
    return F.try_divide(ceiling * calls, calls + half)


def product_pattern(brands: Iterable[str], generics: Iterable[str]) -> str:
    """Regular expression of brand names and of the first words of generic names."""
    words = sorted({*brands, *(g.split()[0] for g in generics)})
    return "(" + "|".join(w.upper() for w in words) + ")"


def account_filter(*, deciles: tuple[int, int] = (1, 10), states: Iterable[str] = (), groups: Iterable[str] = (), targets_only: bool = False, key_prefix: str | None = None, name_prefix: str | None = None) -> Column:
    """Conjunctive list filter. The default decile range leaves out accounts outside the market (decile 0)."""
    parts = [F.col("opportunity_decile").between(*deciles)]
    if states:
        parts.append(F.col("state").isin(*states))
    if groups:
        parts.append(F.col("specialty_group").isin(*groups))
    if targets_only:
        parts.append(F.col("is_target"))
    if key_prefix:
        parts.append(F.col("npi").cast("string").startswith(key_prefix))
    if name_prefix:
        parts.append(F.upper("last_name").startswith(name_prefix.upper()))
    return reduce(lambda a, b: a & b, parts)


#: Fixed value: accounts with fewer claims outside the class than this are specialised in it.
FOCUSED_BELOW = 500


def readable_value(feature: Column, value: Column) -> Column:
    """A model input as a person would say it: logarithms undone, shares in per cent, categories as they are; a missing one is two dashes."""
    number = value.try_cast("double")
    shown = F.when(number.isNull(), value.cast("string")).when(feature.startswith("log_"), F.format_number(F.expm1(number), 0))
    shown = shown.when(feature.startswith("pct_"), F.format_string("%.0f%%", 100 * number)).otherwise(F.format_string("%.2f", number))
    return F.when(feature.isNull() | value.isNull(), "--").otherwise(shown)


def reason_text(feature: Column, value: Column, multiplier: Column, label: Column | None = None) -> Column:
    """The first driver as a sentence; null without one. Little volume outside the class raises potential where a practice is specialised, and is said so."""
    times = F.format_string(" (x%.2f potential)", multiplier)
    outside = F.expm1(value.try_cast("double"))
    focused = (feature == "log_non_class_clms") & (multiplier > 1) & (outside < FOCUSED_BELOW)
    plain = F.concat(label if label is not None else F.regexp_replace(feature, "^(log|pct)_", ""), F.lit(": "), readable_value(feature, value), times)
    return F.when(multiplier.isNull(), None).when(focused, F.concat(F.lit("specialised practice: only "), F.format_number(outside, 0), F.lit(" claims outside the class"), times)).otherwise(plain)
