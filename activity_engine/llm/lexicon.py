"""Corpus-wide counts of distinct text units, and the most frequent of them.

A unit is a white-space run with the run of other characters behind it (or, with
``spaces=False``, the latter alone). Both tokenizers here treat a unit the same
wherever it stands, so work done once for a unit holds for the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACES, buffer, pieces, slices, split

#: White space beyond ASCII: a text that has any is one unit, as it may touch the ASCII white space beside it.
WIDE_SPACE = "[\u001c-\u001f\u0085   -     　]"


class Units(NamedTuple):
    codes: np.ndarray
    distinct: pa.Array
    first: np.ndarray  # of each text, the index of its first unit; one more entry at the end


def units(texts: pa.Array, spaces: bool) -> Units:
    """Units of each text; with ``spaces`` they make up the whole text."""
    data, offsets = buffer(texts)
    if not spaces:
        words = split(data, offsets, SPACES)
        return Units(words.codes, words.distinct, words.first)
    gap = SPACES[data]
    start = np.zeros(len(data), bool)
    start[1:] = gap[1:] & ~gap[:-1]
    wide = np.flatnonzero(np.asarray(pc.match_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), WIDE_SPACE)))
    for i in wide:
        start[offsets[i] : offsets[i + 1]] = False
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    cuts = np.flatnonzero(start)
    encoded = pieces(data, cuts).dictionary_encode()
    return Units(np.asarray(encoded.indices), encoded.dictionary, np.searchsorted(cuts, offsets))


def counts(docs: DataFrame, column: str, spaces: bool, longest: int) -> DataFrame:
    """(unit, n): how often each distinct unit of at most ``longest`` bytes occurs in all documents, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                own = units(part.column(column), spaces)
                n = np.bincount(own.codes, minlength=len(own.distinct))
                some = np.flatnonzero((n > 0) & (np.asarray(pc.binary_length(own.distinct)) <= longest))
                yield pa.RecordBatch.from_arrays(
                    [own.distinct.take(pa.array(some)).cast(pa.string()), pa.array(n[some])], names=["unit", "n"]
                )

    return docs.select(column).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, column: str, spaces: bool, size: int, longest: int = 64) -> list[str]:
    """The most frequent units of at most ``longest`` bytes, in order: those that occur at least 2**j times, with
    the smallest j that leaves ``size`` of them or fewer. The driver gets no more than these."""
    each = counts(docs, column, spaces, longest).persist()
    level = F.floor(F.log2("n")).cast("int")
    by_level = {r.level: r.n for r in each.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    left, least = size, 64
    for j in sorted(by_level, reverse=True):
        if by_level[j] > left:
            break
        left, least = left - by_level[j], j
    known = sorted(r.unit for r in each.filter(level >= least).select("unit").collect())
    each.unpersist()
    return known
