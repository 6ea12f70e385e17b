"""Language identification with hyperdimensional profiles (operator 5).

Every letter (and the gap between words) has a random vector of +1 and -1. An
n-gram's vector binds its letters' vectors, each permuted by its place: their
product. A text's vector bundles (adds) those of its n-grams, a language's
prototype those of its training texts, each scaled to length one so that long
texts don't outweigh others. A text gets the language whose prototype has the
largest cosine with it (ties: the first by name).

Training reads only texts and labels of the rows in the training fold; label,
source and id are never inputs of a prediction. Prototypes are bounded by the
number of label values times DIMENSIONS.

Defined cases: a null text, or one without a letter, is `und` with score 0; so
is every text if nothing is labelled. Rows with a null id are in no fold: not
learned from, not held out. Each input row gives one row; columns with the new
names are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import append, buffer, mixed, slices

DIMENSIONS = 1024
#: Distinct n-grams of a slice whose vectors are kept together (64 MB), and n-grams bundled at a time (32 MB).
KEPT_GRAMS = 1 << 16
BUNDLED = 1 << 13
SIZE = 3
FOLDS = 3
HELD_OUT = 1


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def coded(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (all below ``bound``) in order, and each value's place among them."""
    if bound > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one 0 for each gap, and the text of each."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw, offsets = buffer(low)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    length = np.asarray(pc.utf8_length(low))
    of = np.repeat(np.arange(len(low)), length)
    kinds, codes = coded(points, 0x110000)
    letter = np.array([unicodedata.category(chr(p))[0] == "L" for p in kinds.tolist()], bool)
    if len(points):
        points = np.where(letter, kinds, 0)[codes]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (of[1:] != of[:-1])
    return points[keep], of[keep]


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each code point, the same in every task."""
    blocks = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mixed(mixed(points.astype(np.uint64)[:, None] * np.uint64(1_000_003) + blocks) + np.uint64(17))
    signs = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    return signs.astype(np.int8) * 2 - 1


def grams(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as rows of code points; then text, n-gram and count of each pair that occurs."""
    points, of = letters(texts)
    kinds, codes = coded(points, 0x110000)
    at = np.arange(max(0, len(points) - size + 1))
    at = at[of[at] == of[at + size - 1]]
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code * len(kinds) + codes[at + k]
    seen, gram = coded(code, len(kinds) ** size)
    pair, n = np.unique(of[at] * max(1, len(seen)) + gram, return_counts=True)
    rows = np.stack([kinds[seen // len(kinds) ** (size - 1 - k) % len(kinds)] for k in range(size)], axis=1) if len(seen) else np.zeros((0, size), np.uint32)
    rows = rows.astype(np.int64)
    spoken = (rows != 0).any(axis=1)[pair % max(1, len(seen))] if len(pair) else np.zeros(0, bool)
    return rows, (pair // max(1, len(seen)))[spoken], (pair % max(1, len(seen)))[spoken], n[spoken]


def gram_vectors(rows: np.ndarray) -> np.ndarray:
    """Each n-gram's vector: the product of its letters' vectors, rotated by their place."""
    kinds, codes = np.unique(rows, return_inverse=True)
    vectors, codes = letter_vectors(kinds), codes.reshape(rows.shape)
    bound = np.ones((len(rows), DIMENSIONS), np.int8)
    for k in range(rows.shape[1]):
        bound *= np.roll(vectors, rows.shape[1] - 1 - k, axis=1)[codes[:, k]]
    return bound


def text_vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its vector scaled to length one) for each text with an n-gram that has a letter."""
    rows, text, gram, n = grams(texts)
    if not len(text):
        return
    vectors = gram_vectors(rows) if len(rows) <= KEPT_GRAMS else None
    cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        # a long text's n-grams are bundled some at a time
        v = np.zeros(DIMENSIONS, np.float32)
        for c in range(a, b, BUNDLED):
            some = slice(c, min(b, c + BUNDLED))
            each = gram_vectors(rows[gram[some]]) if vectors is None else vectors[gram[some]]
            v += n[some].astype(np.float32) @ each.astype(np.float32)
        norm = float(np.sqrt(v @ v))
        if norm:
            yield int(text[a]), v / norm


def padded(texts: pa.Array) -> pa.Array:
    """Texts between gaps, so that one letter already makes an n-gram."""
    gap = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(gap, pc.fill_null(texts.cast(pa.large_string()), ""), gap, pa.scalar("", pa.large_string()))


def train(docs: DataFrame, label: str = "lang", column: str = "text") -> tuple[list[str], np.ndarray]:
    """Labels and their prototypes from all given rows; each task adds up its own texts first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, column, 1 << 21):
                names = part.column(label).to_pylist()
                for i, v in text_vectors(padded(part.column(column))):
                    sums[names[i]] = sums.get(names[i], 0) + v.astype(np.float64)
        for name, v in sums.items():
            # whole millionths, so that the order of adding makes no difference
            whole = np.round(v * 1e6).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(whole)], names=["label", "d", "v"]
            )

    own = docs.filter(F.col(label).isNotNull() & F.col(column).isNotNull()).select(column, label)
    summed = own.mapInArrow(add, "label string, d long, v long").groupBy("label", "d").agg(F.sum("v").alias("v"))
    found = summed.collect()  # label values times dimensions
    names = sorted({r.label for r in found})
    index = {x: i for i, x in enumerate(names)}
    prototypes = np.zeros((len(names), DIMENSIONS))
    for r in found:
        prototypes[index[r.label], r.d] = r.v
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return names, (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the cosine with that language's prototype (0 if negative)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(part: pa.RecordBatch) -> dict:
        names, prototypes = shared.value
        best, score = ["und"] * len(part), np.zeros(len(part))
        if names:
            # smaller slices: the n-gram vectors of a slice are held together
            at = 0
            for few in slices(part, column, 1 << 21):
                for i, v in text_vectors(padded(few.column(column))):
                    cosine = prototypes @ v
                    k = int(np.argmax(cosine))
                    best[at + i], score[at + i] = names[k], min(1.0, max(0.0, float(cosine[k])))
                at += len(few)
        return {"lang_pred": best, "score": score}

    return append(docs, column, "lang_pred string, score double", rows)


def identify(docs: DataFrame, label: str = "lang", column: str = "text", key: str = "doc_id") -> DataFrame:
    """Learns from the training folds of ``docs`` and predicts every row; adds held_out, lang_pred and score."""
    held_out = F.coalesce(fold(F.col(key)) == HELD_OUT, F.lit(False))
    model = train(docs.filter(F.col(key).isNotNull() & ~held_out), label, column)
    return predict(docs.withColumn("held_out", held_out), model, column)
