"""The year/month filter every period question takes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LARGEST = 2**63 - 1

#: Years whose months are spans of their own where a month of any year is asked for.
SPAN_YEARS = range(1990, 2050)

#: Metadata of a date key that is the date as a number, yyyymmdd.
DATE_KEY = {"date_key": "yyyymmdd"}

Month = tuple[int, int]
_LEADING_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def _whole_number(raw: int | str | None) -> int | None:
    """The leading number of ``raw`` cut to an integer; zero means no filter.

    Numbers beyond 64 bits stop at the bound, where they match nothing.
    """
    if raw is None:
        return None
    found = _LEADING_NUMBER.match(str(raw))
    number = float(found.group(1)) if found else 0.0
    if abs(number) >= _LARGEST:
        return _LARGEST if number > 0 else -_LARGEST
    return int(number) or None


@dataclass(frozen=True)
class Period:
    """A year, a month, both, or neither."""

    year: int | None = None
    month: int | None = None

    @classmethod
    def of(cls, year: int | str | None = None, month: int | str | None = None) -> Period:
        """From request parameters: blank, zero and non-numeric mean no filter."""
        return cls(_whole_number(year), _whole_number(month))

    @property
    def grain(self) -> str:
        """What one point of a series stands for under this filter."""
        if self.year and self.month:
            return "day"
        if self.year:
            return "month"
        return "year" if self.month else "year_month"

    def condition(self) -> Column | None:
        """Equality on the ``tahun`` and ``bulan`` columns, or None."""
        tests = []
        if self.year:
            tests.append(F.col("tahun") == F.lit(self.year))
        if self.month:
            tests.append(F.col("bulan") == F.lit(self.month))
        if not tests:
            return None
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    def keep(self, df: DataFrame) -> DataFrame:
        condition = self.condition()
        return df if condition is None else df.where(condition)

    def spans(self) -> list[tuple[Month | None, Month | None]] | None:
        """Half-open spans of (year, month) outside which no date is of the period.

        None means no bound at all, and None as an end that the span is open
        there. A month of any year is a span in each of ``SPAN_YEARS``; before
        and after those, where it is told by the date itself, all is let through.
        """
        if self.month is not None and not 1 <= self.month <= 12:
            return []
        if self.year is not None:
            if not 1 <= self.year < 9999:
                return None
            first = (self.year, self.month or 1)
            return [(first, _next(first) if self.month else (self.year + 1, 1))]
        if self.month is None:
            return None
        months = [(year, self.month) for year in SPAN_YEARS]
        inside = [(month, _next(month)) for month in months]
        return [(None, (SPAN_YEARS.start, 1)), *inside, ((SPAN_YEARS.stop, 1), None)]

    def _within(self, column: str, at: Callable[[Month], Column]) -> Column | None:
        spans = self.spans()
        if spans is None:
            return None
        tests = []
        for first, after in spans:
            ends = [F.col(column) >= at(first)] if first else []
            ends += [F.col(column) < at(after)] if after else []
            tests.append(reduce(lambda a, b: a & b, ends))
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def keep_keys(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose yyyymmdd key may be of the period; the calendar decides about the rest.

        The spans are comparisons with literals, so they reach the files: row
        groups that hold other dates are not read.
        """
        within = self._within(key, lambda month: F.lit(month[0] * 10000 + month[1] * 100))
        return df if within is None else df.where(within)

    def keep_moments(self, df: DataFrame, moment: str) -> DataFrame:
        """Rows whose date or time is of the period, by spans that reach the files."""
        kind = df.schema[moment].dataType.simpleString()
        within = self._within(moment, lambda m: F.lit(date(*m, 1).isoformat()).cast(kind))
        if within is not None:
            df = df.where(within)
        elif self.year is not None:
            df = df.where(F.year(moment) == F.lit(self.year))
        return df.where(F.month(moment) == F.lit(self.month)) if self.month is not None else df


def _next(month: Month) -> Month:
    return (month[0] + month[1] // 12, month[1] % 12 + 1)


ALL = Period()


def in_period(fact: DataFrame, dim_waktu: DataFrame, period: Period = ALL) -> DataFrame:
    """Inner-join a fact to its dates and keep those of the period.

    The join stays even without a filter: rows whose date is unknown drop out.
    A fact that is partitioned by year and month is filtered on those columns
    as well, so the scan skips the other partitions before any join; any other
    fact whose key is known to be the date, on spans of the key. No broadcast
    hint: the optimizer broadcasts the calendar when its files are under the
    session's threshold and shuffles otherwise.
    """
    if {"tahun", "bulan"} <= set(fact.columns):
        fact = period.keep(fact).drop("tahun", "bulan")
    elif fact.schema["waktu_id"].metadata.items() >= DATE_KEY.items():
        fact = period.keep_keys(fact, "waktu_id")
    return fact.join(period.keep(dim_waktu), "waktu_id")
