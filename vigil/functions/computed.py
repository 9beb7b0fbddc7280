"""Computed fields over host names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vowel_count(host: Column | str) -> Column:
    """Vowels, of either case."""
    c = F.col(host) if isinstance(host, str) else host
    return F.length(c) - F.length(F.translate(F.lower(c), "aeiou", ""))


def shannon_entropy(host: Column | str) -> Column:
    """Bits per character of the text's own character frequencies."""
    c = F.col(host) if isinstance(host, str) else host
    letters = F.split(c, "")
    n = F.size(letters)
    shares = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    return F.when(F.length(c) > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def subdomain_depth(host: Column | str) -> Column:
    """Dots less one."""
    c = F.col(host) if isinstance(host, str) else host
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) - 1


def query_length(host: Column | str) -> Column:
    return F.length(host)


def is_numeric_heavy(host: Column | str) -> Column:
    """Whether over four tenths are digits; false for null and empty."""
    c = F.col(host) if isinstance(host, str) else host
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, "[^0-9]", "")), F.length(c)) > 0.4, F.lit(False))


def host_suffixes(host: Column | str) -> Column:
    """The host name and each part of it that follows a dot; all of different lengths, so none repeats."""
    c = F.col(host) if isinstance(host, str) else host
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda p: (p == 1) | (F.substring(c, p - 1, F.lit(1)) == "."))
    return F.transform(starts, lambda p: F.substr(c, p))
