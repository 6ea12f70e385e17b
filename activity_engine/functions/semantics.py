"""Null, division and rounding rules of the reference, as Spark expressions.

All helpers return plain ``Column`` expressions (JVM side, inside whole-stage
codegen); none of them is a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column) -> Column:
    """``sum(x)`` without ``na.rm``: NULL as soon as one input is NULL.

    Works as an aggregate, over a window and inside ``pivot``.
    """
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_sum_over(c: str | Column, window) -> Column:
    c = _c(c)
    return F.when(F.count(c).over(window) == F.count(F.lit(1)).over(window), F.sum(c).over(window))


def pivot_strict(df: DataFrame, ids: Sequence[str], names_from: str, values: Sequence, value: str,
                 names: Sequence[str] | None = None) -> DataFrame:
    """``pivot_wider``: one column per value of ``names_from`` holding the strict
    sum of ``value`` over that value's rows (the value itself when the id is
    unique; NULL when absent or when any contributing row is NULL).

    Written as conditional aggregation, one aggregate with one shuffle: Spark's
    ``pivot`` needs two when the cell expression is not a plain aggregate.
    """
    names = list(names) if names is not None else [str(v) for v in values]
    cells = []
    for v, name in zip(values, names):
        hit = F.col(names_from) == F.lit(v)
        x = F.when(hit, F.col(value))
        cells.append(F.when(F.count(F.when(hit, F.lit(1))) == F.count(x), F.sum(x)).alias(name))
    return df.groupBy(*ids).agg(*cells)


def listed(c: str | Column, values: Sequence) -> Column:
    """``c``, which must be one of a pivot's ``values``: another value, or NULL, would be dropped, so it raises."""
    c = _c(c)
    other = F.raise_error(F.concat(F.lit("value without a pivot column: "), F.coalesce(c.cast("string"), F.lit("NULL"))))
    return F.when(c.isin(*values), c).otherwise(other.cast("string") if isinstance(values[0], str) else other.cast("date"))


def sum_na_rm(c: str | Column) -> Column:
    """``sum(x, na.rm=TRUE)``: skips NULL and NaN; no value left gives 0."""
    c = _c(c)
    return F.coalesce(F.sum(F.when(~F.isnan(c), c)), F.lit(0.0))


def ratio(n: str | Column, d: str | Column) -> Column:
    """IEEE division as in R: x/0 = +-Inf, 0/0 = NaN, NULL stays NULL.

    Spark's ANSI mode raises on division by zero, so the zero case is spelled
    out; both sides are doubles.
    """
    n = _c(n).cast("double")
    d = _c(d).cast("double")
    inf = F.lit(float("inf"))
    on_zero = (
        F.when(n.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(n) | (n == 0), F.lit(float("nan")))
        .when(n > 0, inf)
        .otherwise(-inf)
    )
    return F.when(d == 0, on_zero).otherwise(n / d)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """R's ``round`` (IEC 60559 half-to-even) on doubles."""
    return F.bround(_c(c).cast("double"), digits)


def left_join(
    x: DataFrame,
    y: DataFrame,
    by: Sequence[str] | dict[str, str],
    *,
    null_safe: bool = True,
    how: str = "left",
    broadcast: bool = False,
) -> DataFrame:
    """dplyr-style join with ``keep = FALSE``: keys merged, x's key kept.

    ``by`` is a list of shared names or a mapping ``{x_name: y_name}``.
    ``null_safe`` (default, dplyr semantics) matches NULL to NULL with
    ``<=>``; Spark still plans it as a hash / sort-merge equi-join.
    ``broadcast`` hints y; use it only for tables with a structural size bound
    (calendar, working days, lookups).
    """
    pairs = list(by.items()) if isinstance(by, dict) else [(k, k) for k in by]
    tmp = {yk: f"__r_{i}_{yk}" for i, (_, yk) in enumerate(pairs)}
    yr = y.select(*[F.col(c).alias(tmp[c]) if c in tmp else F.col(c) for c in y.columns])
    if broadcast:
        yr = F.broadcast(yr)
    conds = []
    for xk, yk in pairs:
        lc, rc = x[xk], yr[tmp[yk]]
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    out = x.join(yr, cond, how)
    return out.drop(*tmp.values())


def semi_join(x: DataFrame, y: DataFrame, by: Sequence[str], *, null_safe: bool = True) -> DataFrame:
    tmp = {k: f"__s_{k}" for k in by}
    yr = y.select(*[F.col(k).alias(tmp[k]) for k in by])
    cond = None
    for k in by:
        c = x[k].eqNullSafe(yr[tmp[k]]) if null_safe else x[k] == yr[tmp[k]]
        cond = c if cond is None else cond & c
    return x.join(yr, cond, "left_semi")


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """dplyr ``union``: by-name union, then distinct rows."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()
