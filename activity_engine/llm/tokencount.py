"""Token counts without ids (operator 6).

The pieces of each frequent pre-token are counted once for the corpus; a
document's count is the sum of its pre-token frequencies times those counts.
Pre-tokens outside the lexicon are counted once per distinct pre-token of a
slice of a task, so the sum is exact for every text. Ids are never kept.

A pre-token here is a white-space run and what follows it up to the next white
space: the byte-level vocabulary's own pattern never joins text across such a
boundary. A text with white space beyond ASCII is one pre-token.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of
special tokens inside a text count as the library's default counts them (one
token each); each input row gives one row, repeated rows and null ids included;
columns with the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import frequent, units
from .tokenizer import load
from .words import append

#: Pre-tokens counted once for the whole corpus: a broadcast of some 3 MB.
LEXICON = 131_072


def piece_counts(path: str, texts: list[str], step: int = 20_000) -> np.ndarray:
    tokenizer = load(path)
    n = np.zeros(len(texts), np.int64)
    for i in range(0, len(texts), step):
        got = tokenizer.encode_batch_fast(texts[i : i + step], add_special_tokens=False)
        n[i : i + step] = [len(x) for x in got]
    return n


def lexicon_counts(docs: DataFrame, path: str, column: str, size: int) -> tuple[list[str], np.ndarray]:
    known = frequent(docs, column, True, size)
    return known, piece_counts(path, known)


def count_tokens(
    docs: DataFrame, path: str, column: str = "text", limit: int = 512, lexicon: int = LEXICON
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon_counts(docs, path, column, lexicon))

    def rows(part: pa.RecordBatch) -> dict:
        texts, counts = shared.value
        own = units(part.column(column), True)
        at = np.asarray(pc.fill_null(pc.index_in(own.distinct, pa.array(texts, pa.large_string())), -1))
        each = np.append(counts, 0)[at]
        unseen = np.flatnonzero(at < 0)
        each[unseen] = piece_counts(path, own.distinct.take(pa.array(unseen)).to_pylist())
        summed = np.append(0, np.cumsum(each[own.codes]))
        n = summed[own.first[1:]] - summed[own.first[:-1]]
        return {
            "n_bytes": pc.fill_null(pc.binary_length(part.column(column)), 0),
            "n_tokens": n,
            "over_limit": n > limit,
        }

    return append(docs, column, "n_bytes long, n_tokens long, over_limit boolean", rows).select(
        "*", F.lit(limit).alias("token_limit")
    )
