"""Data-quality checks (D11 and the pivot uniqueness guard)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def months_reported(per_provider_month: DataFrame, code_col: str = "der_provider_code") -> DataFrame:
    """Number of rows (months) each provider reported."""
    return per_provider_month.groupBy(code_col).agg(F.count(F.lit(1)).alias("n"))


def pivot_lists(df: DataFrame, ids: list[str], names_from: str, names: list[str], value: str, *, unique: bool = False) -> DataFrame:
    """R1/R2 as ``pivot_wider`` itself does it: a column per name, each cell the list of its rows' values.

    Lists are in ascending order, NULLs last; a cell without a row is NULL. With
    ``unique`` a cell of several rows fails the query instead, and cells are single values.
    One conditional aggregation. A cell holds the rows of one id and name, which in
    the reference's pivots are as many as the provider codes of one provider.
    """
    cells = []
    for name in names:
        here = F.col(names_from) == name
        # wrapped, as a list leaves out NULLs
        found = F.collect_list(F.when(here, F.struct(F.col(value).isNull().alias("missing"), F.col(value).alias("v"))))
        values = F.transform(F.array_sort(found), lambda x: x["v"])
        if unique:
            several = F.raise_error(F.concat(F.lit(f"several values in column {name} of "), F.to_json(F.struct(*ids))))
            cell = F.when(F.size(values) > 1, several.cast(df.schema[value].dataType)).otherwise(F.get(values, F.lit(0)))
        else:
            cell = F.when(F.size(values) > 0, values)
        cells.append(cell.alias(name))
    return df.groupBy(*ids).agg(*cells)


def duplicated_cells(lists: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """The cells of ``pivot_lists`` that hold more than one value, in long form."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("cell")) for n in names])
    rows = lists.select(*ids, F.explode(each).alias("x")).where(F.size("x.cell") > 1)
    return rows.select(
        *ids,
        "x.name",
        F.size("x.cell").cast("bigint").alias("n_values"),
        F.get("x.cell", F.lit(0)).alias("lowest"),
        F.array_max("x.cell").alias("highest"),
        F.aggregate("x.cell", F.lit(0.0), lambda a, v: a + v).alias("total"),
    )


def pivot_duplicates(name: str, df: DataFrame, ids: list[str], names_from: str) -> DataFrame:
    """R1/R2 guard: cells of a pivot fed by more than one row.

    One row per pivot: number of cells, of cells with duplicates, and the
    largest number of rows in one cell.
    """
    cells = df.groupBy(*ids, names_from).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).cast("bigint").alias("duplicated_cells"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_rows_per_cell"),
    ).select(F.lit(name).alias("pivot"), "cells", "duplicated_cells", "max_rows_per_cell")
