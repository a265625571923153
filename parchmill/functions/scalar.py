"""Numbers, dates, arrays and enumerations as column expressions."""

from __future__ import annotations

from datetime import UTC
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def rate(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def usd(micro: Column) -> Column:
    """Integer micro-dollars as dollars, four places, halves to even."""
    return F.bround(micro / F.lit(1e6), 4)


def iso_time(c: Column) -> Column:
    """An ISO-8601 text as a timestamp; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(c, r"Z$", "+00:00"))


def age_days(ts: Column, now: Column) -> Column:
    """Whole days of 86,400,000 ms, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / F.lit(DAY_MS)))


def month_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("0000-00"))


def clamped(c: Column, low: float, high: float) -> Column:
    """A number inside the limits; null if it is not finite."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(F.least(F.greatest(d, F.lit(low)), F.lit(high)))


def whole_number(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default))


def one_of(c: Column, allowed: list[str]) -> Column:
    """A value of the list, trimmed and lower case; null if it is another."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*allowed), x)


def numbers_between(low: Column, high: Column, most: int = 50) -> Column:
    """low..high as an array, at most `most` of them; empty if high < low."""
    return F.when((high >= low), F.sequence(low, F.least(high, low + (most - 1)))).otherwise(F.array().cast("array<bigint>"))


def term_band(years: Column) -> Column:
    return F.when(years <= 0, None).when(years <= 2, "up_to_2").when(years <= 5, "up_to_5").when(years > 5, "over_5")


def months_as_years(months: Column) -> Column:
    return months / F.lit(12.0)


def number_words(n: Column) -> Column:
    """A count in words up to twenty, and thirty; others in digits."""
    word = F.get(F.array(*map(F.lit, NUMBER_WORDS)), (n - 1).cast("int"))
    return F.when(n.between(1, len(NUMBER_WORDS)), word).when(n == 30, "thirty").otherwise(n.cast("string"))


def year_label(years: Column, digits: bool = False) -> Column:
    """"five years", or with digits "five (5) years"."""
    unit = F.when(years == 1, " year").otherwise(" years")
    return F.concat(number_words(years), F.concat(F.lit(" ("), years.cast("string"), F.lit(")")) if digits else F.lit(""), unit)


@F.pandas_udf(T.StringType())
def email_time(dates: pd.Series) -> pd.Series:
    """The date of a mail's header as an ISO text, in UTC where it names no zone; empty if it cannot be read."""

    def read(x: str | None) -> str:
        try:
            d = parsedate_to_datetime(x) if x else None
        except (TypeError, ValueError):
            return ""
        return "" if d is None else (d if d.tzinfo else d.replace(tzinfo=UTC)).isoformat()

    return dates.map(read)


def counts_by_key(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, counts): how often each key stands in a group, as a map; null keys do not count. Counted before they are
    gathered, so a group holds as many entries as it has keys."""
    n = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def finite_json(c: Column, schema: str) -> Column:
    """A JSON object by a schema; null if it is none, or holds NaN or an infinity."""
    bare = c.rlike(r'(?:^|[:\[,])\s*[-+]?(?:NaN|Infinity|INF)\s*(?:[,}\]]|$)')
    return F.when(~bare, F.from_json(c, schema, {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}))
