"""Counts, shares and times as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(n: str, noun: str) -> Column:
    """1,234 turns; 1 turn."""
    return F.concat(F.format_number(F.col(n), 0), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))


def phrase(n: str, noun: str, verb: str) -> Column:
    """1 turn contains; 2 turns contain."""
    return F.concat(count(n, noun), F.lit(f" {verb}"), F.when(F.col(n) == 1, "s").otherwise(""))


def share(part: str, whole: str) -> Column:
    """3 of 1,200 (0.2%); without a whole no percentage."""
    both = F.concat(F.format_number(F.col(part), 0), F.lit(" of "), F.format_number(F.col(whole), 0))
    percent = F.format_string(" (%.1f%%)", F.bround(F.try_divide(F.col(part) * 1000, F.col(whole)), 0) / 10)
    return F.concat(both, F.when(F.col(whole) > 0, percent).otherwise(""))


def when(ts: str, hours: str, never: str) -> Column:
    """A time and how long ago: hours with one decimal under two days, else whole days."""
    ago = F.when(F.col(hours) < 48, F.format_string("%.1f hours", F.col(hours))).otherwise(F.concat(F.floor(F.col(hours) / 24).cast("string"), F.lit(" days")))
    shown = F.when(F.col(hours).isNull(), F.col(ts)).otherwise(F.concat(F.col(ts), F.lit(" ("), ago, F.lit(" ago)")))
    return F.when(F.coalesce(F.col(ts), F.lit("")) == "", never).otherwise(shown)
