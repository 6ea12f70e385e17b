"""Named queries over the driver's tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query builds the logical tables from ``sf_dir`` (lazy), wires the
pipeline with ``test_params()`` and returns one output.  Doubles are rounded to
6 decimals at the very end so results hash the same as the DuckDB oracles
(sums of doubles depend on summation order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params, test_params
from ..session import configure
from ..sources.testmap import load_tables, prepared_for
from .pipeline import Pipeline

QueryFn = Callable[[SparkSession, str], DataFrame]


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns (NaN and infinities pass through, zero is always +0.0)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(c == 0, F.lit(0.0)).otherwise(F.round(c, digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def pipeline(
    spark: SparkSession, sf_dir: str, params: Params | None = None, *, stored_span: bool = True, prepared: bool = False
) -> Pipeline:
    """A lazy pipeline over the files that ``sf_dir`` holds now.

    ``stored_span`` takes the calendar's range from the kept spans of the files;
    ``prepared`` reads the fact from its laid-out copy, made when there is none.
    """
    params = params or test_params()
    configure(spark)
    laid_out = prepared_for(spark, sf_dir, params) if prepared else None
    return Pipeline(load_tables(spark, sf_dir, params, prepared=laid_out, stored_span=stored_span), params)


def _p(attr: str, v2: bool = False, params: Params | None = None, **how: bool) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pl = pipeline(spark, sf_dir, params, **how)
        if v2:
            pl = pl.variant_v2()
        return finalize(getattr(pl, attr))

    run.__name__ = attr
    return run


def _q(fn: Callable[[Pipeline], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(fn(pipeline(spark, sf_dir)))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def queries() -> dict[str, QueryFn]:
    from . import catalog

    return catalog.build()
