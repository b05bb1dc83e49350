"""Column expressions of the cleaning, feature and scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def normalize_title(title: Column) -> Column:
    """Lower case, any Unicode white space collapsed to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "(?U)\\s+", " "))


def store_merge_key(store: Column) -> Column:
    """The store as it is, or empty where it is null or blank."""
    return F.when(F.trim(F.coalesce(store, F.lit(""))) == "", "").otherwise(store)


def clean_value(x: Column) -> Column:
    """Trimmed; null and the words for a missing value are empty."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "unknown", ""), "").otherwise(t)


def known_or(x: Column, unknown: str = "Unknown") -> Column:
    """A categorical with its missing forms as one value, filled before any cast."""
    t = x.cast("string")
    return F.when(t.isNull() | t.isin("", "nan", "None"), unknown).otherwise(t)


def price(x: Column) -> Column:
    """The number left when all but digits and points go; null if none."""
    return F.regexp_replace(x.cast("string"), "[^\\d.]", "").try_cast("double")


def list_length(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def item_text(title: Column, store: Column, categories: Column) -> Column:
    """title | store | first two categories, without blanks; `unknown item` if nothing is left."""
    parts = F.concat(F.array(clean_value(title), clean_value(store)), F.transform(F.slice(F.coalesce(categories, F.array().cast("array<string>")), 1, 2), clean_value))
    text = F.array_join(F.filter(parts, lambda p: p != ""), " | ")
    return F.when(text == "", "unknown item").otherwise(text)


def sigmoid(x: Column) -> Column:
    """Does not overflow for either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def decay(age_ms: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), age_ms / float(DAY_MS) / half_life_days)


def review_bucket(n: Column) -> Column:
    """Left-closed buckets of an item's history reviews."""
    return F.when(n < 10, "0-9").when(n < 30, "10-29").when(n < 100, "30-99").when(n < 300, "100-299").otherwise("300+")


def cohort(n: Column) -> Column:
    """History length 0, 1, 2, 3 or more; a missing count is 0."""
    return F.least(F.coalesce(n, F.lit(0)), F.lit(3)).cast("int")


def fine_cohort(n: Column) -> Column:
    c = F.coalesce(n, F.lit(0))
    return F.when(c == 0, "0").when(c <= 2, "1-2").when(c <= 4, "3-4").when(c <= 9, "5-9").otherwise("10+")


def helpful_bin(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, (c / total) * F.log2(c / total)).otherwise(0.0))
