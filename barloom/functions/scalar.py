"""Column expressions that Spark has no function for."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Abramowitz-Stegun 7.1.26 approximation of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

#: Words that mark an announcement as good or bad news.
POSITIVE = ["DIVIDEND", "BONUS", "BUYBACK"]
NEGATIVE = ["DELAY", "DEFAULT", "SUSPENSION", "LOSS", "RESIGNATION"]


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = reduce(lambda acc, a: (acc + a) * t, reversed(ERF_A), F.lit(0.0))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def chi2_sf_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom."""
    if df % 2:
        raise ValueError("df must be even")
    y = x / 2
    return F.exp(-y) * reduce(lambda a, b: a + b, [F.pow(y, F.lit(k)) / math.factorial(k) for k in range(df // 2)])


def add_trading_days(ts: Column, days: Column) -> Column:
    """``days`` weekdays after ``ts``; the time of day stays. Saturday and Sunday count as the Friday before."""
    weekday = F.weekday(ts)  # Monday 0
    back = F.greatest(weekday - 4, F.lit(0))  # from a weekend to its Friday
    start = F.least(weekday, F.lit(4))
    total = start + days
    calendar = F.floor(total / 5) * 7 + total % 5 - start - back
    return F.when(days <= 0, ts).otherwise(F.timestamp_micros(F.unix_micros(ts) + calendar.cast("long") * 86_400_000_000))


def staleness_days(as_of: Column, last: Column) -> Column:
    gap = (F.unix_micros(as_of) - F.unix_micros(last)) / 86_400_000_000
    return F.greatest(F.lit(0), F.floor(gap + 0.5)).cast("long")


def classify_text(text: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    up = F.upper(text)
    any_of = lambda words: up.rlike("|".join(words))
    return F.when(any_of(positive or POSITIVE), "POSITIVE").when(any_of(negative or NEGATIVE), "NEGATIVE").otherwise("NEUTRAL")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def text_excerpt(text: Column, at: Column, before: int = 250, after: int = 1500) -> Column:
    """The piece of ``text`` around the 1-based position ``at``."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, at + after - start)


def pct_format(x: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", x * 100)


def normalize_symbol(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(s)), r"-SEP$", "")


def valid_symbol(s: Column) -> Column:
    return s.rlike(r"^[A-Z0-9.-]{1,20}$")


def number_from_cell(s: Column) -> Column:
    return F.regexp_replace(s, "[,%]", "").try_cast("double")


def safe_divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))
