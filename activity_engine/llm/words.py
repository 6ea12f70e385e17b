"""Vectorised splitting of text columns into words, for use inside Arrow tasks.

A text column is handled as one UTF-8 byte buffer: a lookup table says which
bytes separate words, the words are cut at its boundaries without copying and
encoded as codes into a dictionary of distinct words. Separators are ASCII, so
cutting bytes never cuts a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at a time; one longer text is handled alone.
SLICE_BYTES = 8 << 20


def separators(spec: str) -> np.ndarray:
    """Lookup table over byte values: True where the byte is in ``spec`` (ASCII)."""
    table = np.zeros(256, bool)
    table[list(spec.encode("ascii"))] = True
    return table


#: U+0020 and U+0009 to U+000D.
SPACES = separators(" \t\n\x0b\x0c\r")


class Words(NamedTuple):
    codes: np.ndarray  # of each word, into ``distinct``
    distinct: pa.Array  # the distinct words (and, unused, the distinct gaps)
    first: np.ndarray  # of each text, the index of its first word; one more entry at the end
    starts: np.ndarray  # byte offset of each word in the column's buffer
    stops: np.ndarray

    def of_text(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Strings that begin at ``starts`` (first one 0) and end where the next begins."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def split(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Words:
    """Maximal runs of bytes that aren't separators, text by text."""
    gap = separator[data]
    change = np.ones(len(data), bool)
    change[1:] = gap[1:] != gap[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    cuts = np.flatnonzero(change)
    encoded = pieces(data, cuts).dictionary_encode()
    word = ~gap[cuts]
    starts = cuts[word]
    return Words(
        np.asarray(encoded.indices)[word],
        encoded.dictionary,
        np.searchsorted(starts, offsets),
        starts,
        np.append(cuts, len(data))[1:][word],
    )


def digests(distinct: pa.Array) -> np.ndarray:
    """128-bit hash of each distinct word, as rows of two unsigned 64-bit integers."""
    raw = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in distinct.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hash(values: np.ndarray, at: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of the ``size`` consecutive values from each index in ``at``."""
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = h * np.uint64(factor) + values[at + k]
    return mixed(h)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indices of words at which a window of ``size`` words of one text starts."""
    n = np.maximum(np.diff(words.first) - size + 1, 0)
    return np.repeat(words.first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of ``n`` words, those inside a window of ``size`` words from any of ``starts``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + size, -1)
    return np.cumsum(delta[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take at most ``most`` bytes (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
    for a, b in zip(bounds, [*bounds[1:], len(group)], strict=True):
        yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame, column: str, schema: T.StructType | str, rows: Callable[[pa.RecordBatch], dict]
) -> DataFrame:
    """``rows`` over bounded slices of ``df``: it gives the output's columns by name."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                got = rows(part)
                yield pa.RecordBatch.from_arrays([as_arrow(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def map_rows(df: DataFrame, fields: str, rows: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``df`` with more columns, as ``append``, batch by batch as they come."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(fields)
    kept = [f for f in df.schema if f.name.lower() not in {x.name.lower() for x in new}]
    schema = T.StructType([*kept, *new])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {f.name: batch.column(f.name) for f in kept} | rows(batch)
            yield pa.RecordBatch.from_arrays([as_arrow(got[f.name], f.type) for f in out], schema=out)

    return df.select(*[f"`{f.name}`" for f in df.schema]).mapInArrow(run, schema)


def append(df: DataFrame, column: str, fields: str, rows: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``df`` with more columns; a column of ``df`` with a new one's name (in any case) is replaced (``rows`` still sees it)."""
    new = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in new} - {column.lower()}
    kept = [f for f in df.schema if f.name.lower() not in taken]

    def both(part: pa.RecordBatch) -> dict:
        return {f.name: part.column(f.name) for f in kept} | rows(part)

    return map_texts(df, column, T.StructType([*kept, *new]), both)
