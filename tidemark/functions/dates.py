"""Dates in text, and ISO-week shards, as Column expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months and weekdays (1 is Sunday).
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
}
WEEKDAYS = {"sunday": 1, "monday": 2, "tuesday": 3, "wednesday": 4, "thursday": 5, "friday": 6, "saturday": 7}
_NAMES = "|".join(MONTHS)
#: The five reference patterns, earliest match and then most absolute first.
ISO_DATE = r"(?i)\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
MONTH_DAY = rf"(?i)\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_NAMES})\.?(?:,?\s+(\d{{4}}))?\b"
RELATIVE = r"(?i)\b(today|tomorrow|tmrw|yesterday)\b"
WEEKDAY = rf"(?i)\b(next|this|last|coming)?\s*({'|'.join(WEEKDAYS)})\b"


def _named(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, null where there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def event_date(text: Column, captured: Column) -> Column:
    """The day that text speaks of, seen from the capture time; null if none."""
    today = F.to_date(captured)

    def reference(pattern: str, priority: int, day_of) -> Column:
        """Place, priority and day of the pattern's first match: the text is searched for the match, the match for its parts."""

        def of(match: Column) -> Column:
            part = lambda group: F.nullif(F.regexp_extract(match, pattern, group), F.lit(""))
            at = F.when(match != "", F.regexp_instr(text, F.lit(pattern))).otherwise(0)
            return F.struct(at.alias("at"), F.lit(priority).alias("prio"), F.when(match != "", day_of(part)).alias("day"))

        return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 0)), of), F.lit(0))

    number = lambda x: x.try_cast("int")

    def month_named(month_group: int, day_group: int):
        def day_of(part) -> Column:
            month, day, year = _named(MONTHS)[F.lower(part(month_group))], number(part(day_group)), number(part(3))
            this = _day(F.year(captured), month, day)
            rolled = F.when(this < today, _day(F.year(captured) + 1, month, day)).otherwise(this)
            return F.when(year.isNotNull(), _day(year, month, day)).otherwise(rolled)

        return day_of

    def relative(part) -> Column:
        word = F.lower(part(1))
        return F.date_add(today, F.when(word == "yesterday", -1).when(word == "today", 0).when(word.isNotNull(), 1))

    def weekday(part) -> Column:
        delta = F.pmod(_named(WEEKDAYS)[F.lower(part(2))] - F.dayofweek(captured) + 7, F.lit(7))
        qualifier = F.coalesce(F.lower(part(1)), F.lit(""))
        return F.date_add(today, F.when(qualifier == "next", delta + 7).when(qualifier == "last", delta - 7).otherwise(delta).cast("int"))

    found = F.array(
        reference(ISO_DATE, 0, lambda part: _day(number(part(1)), number(part(2)), number(part(3)))),
        reference(MONTH_DAY, 1, month_named(1, 2)),
        reference(DAY_MONTH, 1, month_named(2, 1)),
        reference(RELATIVE, 2, relative),
        reference(WEEKDAY, 3, weekday),
    )
    return F.array_min(F.filter(found, lambda s: (s["at"] > 0) & s["day"].isNotNull()))["day"]


def shard_of(ts: Column) -> Column:
    """ISO year and week, as in 2026-W07."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def shard_start(shard: Column) -> Column:
    """Monday 00:00 of a shard id; null if the id is malformed."""
    year, week = F.regexp_extract(shard, r"^(\d{4})-W(\d{2})$", 1).try_cast("int"), F.regexp_extract(shard, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    fourth = F.try_to_timestamp(F.format_string("%04d-01-04", year), F.lit("yyyy-MM-dd"))
    return F.when(year.isNotNull() & week.isNotNull(), F.date_trunc("week", fourth) + F.make_interval(weeks=week - 1))


def shard_end(shard: Column) -> Column:
    return shard_start(shard) + F.expr("interval 7 days")


def shard_bounds(shard: str) -> tuple[dt.datetime, dt.datetime]:
    """The same on the driver, for pruning; UTC without a zone."""
    m = re.fullmatch(r"(\d{4})-W(\d{2})", shard)
    if not m:
        raise ValueError(f"not a shard: {shard}")
    start = dt.datetime.fromisocalendar(int(m[1]), int(m[2]), 1)
    return start, start + dt.timedelta(days=7)


def shard_name(ts: dt.datetime) -> str:
    year, week, _ = ts.isocalendar()
    return f"{year:04d}-W{week:02d}"
