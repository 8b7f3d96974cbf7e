"""Column expressions over text, urls, time and arrays; built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without a time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def upper_fraction(text: Column) -> Column:
    """Upper-case letters among letters, 0 without letters; letters are A-Z and a-z."""
    letters, upper = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return F.when(letters > 0, upper / letters).otherwise(0.0)


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def non_ascii(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def host(url: Column) -> Column:
    """Host without a leading www., null on a bad url."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def decay(age: Column, half_life: float) -> Column:
    return F.exp(-age * F.lit(0.6931471805599453 / half_life))


def shrunk_rate(successes: Column, trials: Column, strength: float) -> Column:
    """successes / (trials + strength): small samples are drawn to 0."""
    return successes / (trials + strength)


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def median_of(values: Column) -> Column:
    """Median of an array without nulls, null if empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def joined_distinct(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def after_position(slot: Column, index: Column, slot0: Column, index0: Column) -> Column:
    """Strictly later in the order (slot, index)."""
    return (slot > slot0) | ((slot == slot0) & (index > index0))


def after_prefix(text: Column, prefix: str) -> Column:
    """The whole number that follows a prefix and ends the text, else null."""
    return F.nullif(F.regexp_extract(text, rf"^{prefix}(-?\d+)$", 1), F.lit("")).try_cast("int")


def _share(text: Column, kind: str, of: str) -> Column:
    count = lambda k: F.length(F.regexp_replace(text, rf"[^\p{{{k}}}]", ""))
    return F.when(count(of) > 0, count(kind) / count(of)).otherwise(0.0)


def text_profile(name: Column, symbol: Column, uri: Column, providers: dict[str, str]) -> list[Column]:
    """Named columns about a name, a symbol and a link, none of them null; providers: part of a link -> class, the first that fits."""
    low = F.lower(uri)
    name_n, symbol_n = normalized(name), F.regexp_replace(F.lower(symbol), r"\s+", "")
    provider = reduce(lambda c, p: c.when(F.contains(low, F.lit(p)), providers[p]), list(providers)[1:], F.when(F.contains(low, F.lit(next(iter(providers)))), providers[next(iter(providers))]))
    size = lambda c: F.length(c).cast("long")
    found = {
        "name_normalized": name_n, "symbol_normalized": symbol_n, "name_length": size(name), "symbol_length": size(symbol), "uri_length": size(uri), "name_words": word_count(name).cast("long"),
        "name_digits": digits(name).cast("long"), "symbol_digits": digits(symbol).cast("long"), "name_non_ascii": non_ascii(name).cast("long"), "symbol_non_ascii": non_ascii(symbol).cast("long"),
        "name_upper": F.round(_share(name, "Lu", "L"), 9), "symbol_upper": F.round(_share(symbol, "Lu", "L"), 9), "same_name": F.replace(name_n, F.lit(" "), F.lit("")) == symbol_n,
        "name_has_url": contains_any(name_n, ["http://", "https://", ".com"]), "has_dollar": contains_any(name, ["$"]) | contains_any(symbol, ["$"]), "name_special": non_ascii(name) > 0, "symbol_special": non_ascii(symbol) > 0,
        "host": host(uri), "provider": provider.when(uri == "", "missing").otherwise("other"), "has_symbol": F.length(F.trim(symbol)) > 0,
    }
    return [c.alias(n) for n, c in found.items()]
