"""Text expressions: provider code rules, title case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def provider_code(
    code,
    prefix_rules: Sequence[tuple[str, str]],
    *,
    else_len: int | None = None,
    exact_rules: Sequence[tuple[str, str]] = (),
    r_prefix_len: int | None = None,
) -> Column:
    """Searched CASE over a provider code; first matching rule wins.

    Order: exact codes, then a trailing '00' keeps the first 3 characters, then
    each ``(prefix, replacement)``, then (optionally) codes starting with 'R'
    keep ``r_prefix_len`` characters, else the code itself (or its first
    ``else_len`` characters).
    """
    c = _c(code)
    expr = None

    def add(cond, value):
        nonlocal expr
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)

    for full, repl in exact_rules:
        add(c == full, F.lit(repl))
    add(c.endswith("00"), F.substring(c, 1, 3))
    for prefix, repl in prefix_rules:
        add(c.startswith(prefix), F.lit(repl))
    if r_prefix_len is not None:
        add(c.startswith("R"), F.substring(c, 1, r_prefix_len))
    return expr.otherwise(F.substring(c, 1, else_len) if else_len else c)


def title_case_nhs(name) -> Column:
    """``str_replace(str_to_title(x), 'Nhs', 'NHS')``: title case, first 'Nhs' fixed.

    ``initcap`` under the UNICODE collation capitalises after any non-letter
    (as ICU title case does), unlike the binary ``initcap``.
    """
    t = F.initcap(F.collate(F.lower(_c(name)), "UNICODE")).cast("string")
    # replace only the first occurrence
    return F.regexp_replace(t, r"^(.*?)Nhs", "$1NHS")
