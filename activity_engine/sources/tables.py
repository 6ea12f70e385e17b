"""The logical input tables every operator works on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Scope:
    """What a query needs of a fact table: half-open date ranges and codes (empty: all)."""

    dates: tuple[tuple[dt.date, dt.date], ...] = ()
    first_attendance: tuple[str, ...] = ()
    attendance_status: tuple[str, ...] = ()
    administrative_category: str | None = None


def fin_year_dates(labels: Sequence[str]) -> tuple[tuple[dt.date, dt.date], ...]:
    """Half-open date range of each financial year label ('1999/00' or '1999-00')."""
    return tuple((dt.date(y, 4, 1), dt.date(y + 1, 4, 1)) for y in sorted({int(x[:4]) for x in labels}))


@dataclass(frozen=True)
class Tables:
    """Lazy DataFrames for the reference's logical tables (schemas in FIXTURES.md).

    ``attendance`` and ``attendance_cost`` are fact-sized; ``planning`` and
    ``hrg_time_series`` are monthly aggregates; the rest are dimension tables
    whose size is bounded by the number of organisations / codes.
    ``calendar_bounds`` is a one-row frame ``(start_date, end_date)`` or None
    (then the calendar range comes from ``Params``); ``holidays`` is a one
    column frame ``date``, a callable ``(spark, start, end) -> frame`` for
    rule-based holidays, or None (then only ``Params.extra_holidays``).
    ``source(name, scope)``, where given, rebuilds a fact table with the scope
    as predicates on its stored columns; a query still applies its own filters.
    ``calendar_range``, where given, is the range itself, from stored metadata.
    ``cost_key`` names the columns that join attendance and its cost.
    """

    attendance: DataFrame
    tfc_ref: DataFrame
    provider_hierarchy: DataFrame
    attendance_cost: DataFrame
    planning: DataFrame
    hrg_time_series: DataFrame
    provider_lookup: DataFrame
    system_lookup: DataFrame
    acutes: DataFrame
    holidays: object = None
    calendar_bounds: DataFrame | None = None
    source: Callable[[str, Scope], DataFrame] | None = None
    calendar_range: tuple[dt.date | None, dt.date | None] | None = None
    cost_key: tuple[str, str] = ("opa_ident", "der_financial_year")

    def fact(self, name: str, scope: Scope) -> DataFrame:
        """The named fact table, with at least the rows in ``scope``."""
        return self.source(name, scope) if self.source else getattr(self, name)
