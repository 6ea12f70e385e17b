"""Substring deduplication with difference-cover anchors (operator 2).

A run of WINDOW words that also starts in a document with a smaller id is
removed. Positions p with p mod PERIOD in COVER are anchors: for any two
positions there is a shift below PERIOD that brings both onto anchors, so two
equal windows hold an equal anchor of WINDOW - PERIOD + 1 words at the same
place. Only anchors are hashed and shuffled; the windows around an anchor that
another document shares are then compared by 96-bit hashes.

In both shuffles a task sends one row for each hash and slice (that of its
smallest document), so the rows of a hash shared by any part of the corpus are
no more than slices; what a slice can decide alone goes around the shuffle.
Of exact copies of a text, all but the first lose every word (if there are
enough for a window) and go no further.

Defined cases: a null text has no words; a row with a null id neither removes
nor loses anything; rows with one id are one document (they don't remove from
each other; different texts of one id are told apart by 20 bits of a hash); each input row gives one row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import SPACES, Words, buffer, digests, map_texts, mixed, split, window_hash, window_starts

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every residue modulo 7 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1


def hashed_words(texts: pa.Array):
    data, offsets = buffer(texts)
    words = split(data, offsets, SPACES)
    return data, words, digests(words.distinct)[words.codes] if len(words.distinct) else np.zeros((0, 2), np.uint64)


def first_of_each(doc: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has its key's smallest document, and whether its key has several documents."""
    first, several = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    if len(doc):
        order = np.lexsort((doc, *key))
        d = doc[order]
        new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in key], axis=0))
        cuts = np.flatnonzero(new)
        size = np.diff(np.append(cuts, len(d)))
        least = np.repeat(d[cuts], size)
        most = np.repeat(d[np.append(cuts[1:], len(d)) - 1], size)
        first[order], several[order] = d == least, most > least
    return first, several


def anchor_hashes(words: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every anchor of the texts that have a window."""
    at = window_starts(words, ANCHOR)
    of = words.of_text()[at]
    some = np.isin((at - words.first[of]) % PERIOD, COVER) & (np.diff(words.first) >= WINDOW)[of]
    # 48 bits: an anchor only chooses what is compared
    return at[some], window_hash(values[:, 0], at[some], ANCHOR) >> np.uint64(16)


def anchors(docs: DataFrame) -> DataFrame:
    """(h, doc_id, tid, known): anchors of the rows with ``is_first`` to compare; with ``known``, one that its slice already found shared, and h
    is any number."""

    def rows(part: pa.RecordBatch) -> dict:
        _, words, values = hashed_words(part.column("text"))
        at, h = anchor_hashes(words, values)
        of = words.of_text()[at]
        own = np.asarray(part.column("is_first").fill_null(False))[of]
        at, h, of = at[own], h[own], of[own]
        doc, tid = np.asarray(part.column("doc_id"))[of], np.asarray(part.column("tid"))[of]
        first, several = first_of_each(doc, h)
        known = pa.array(np.concatenate([h[first], h[several]]).view(np.int64), mask=np.arange(first.sum() + several.sum()) < first.sum())
        # known rows are spread over all tasks
        spread = mixed(h[several] + mixed(tid[several].view(np.uint64)))
        return {
            "h": np.concatenate([h[first], spread]).view(np.int64),
            "doc_id": np.concatenate([doc[first], doc[several]]),
            "tid": np.concatenate([tid[first], tid[several]]),
            "known": known,
        }

    return map_texts(docs, "text", "h long, doc_id long, tid long, known long", rows)


def windows(docs: DataFrame) -> DataFrame:
    """(a, b, doc_id, tid, run): the windows at the anchors in ``shared``. a and the upper half of b are the hash, the
    lower half of b is the start; with ``run``, it and the starts behind it, so many in all, are known to be removed."""

    def rows(part: pa.RecordBatch) -> dict:
        _, words, values = hashed_words(part.column("text"))
        at, h = anchor_hashes(words, values)
        of = words.of_text()
        lists = part.column("shared")
        owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
        wanted = mixed(owner.astype(np.uint64) + np.uint64(1)) ^ np.asarray(lists.flatten()).view(np.uint64)
        at = at[np.isin(mixed(of[at].astype(np.uint64) + np.uint64(1)) ^ h, wanted)]
        # starts of the windows that hold such an anchor
        low, high = words.first[:-1][of[at]], words.first[1:][of[at]] - WINDOW
        flags = np.zeros(len(values) + 1, np.int64)
        np.add.at(flags, np.maximum(at - PERIOD + 1, low), 1)
        np.add.at(flags, np.minimum(at, high) + 1, -1)
        at = np.flatnonzero(np.cumsum(flags[:-1]) > 0)
        of = of[at]
        doc, tid = np.asarray(part.column("doc_id"))[of], np.asarray(part.column("tid"))[of]
        a = window_hash(values[:, 0], at, WINDOW)
        b = window_hash(values[:, 1], at, WINDOW, 0xC2B2AE3D27D4EB4F) >> np.uint64(32) << np.uint64(32)
        first, _ = first_of_each(doc, b, a)
        b |= (at - words.first[of]).astype(np.uint64)
        gone, of = at[~first], of[~first]
        cut = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (of[1:] != of[:-1]))) if len(gone) else gone
        run = np.diff(np.append(cut, len(gone)))
        spread = mixed(tid[~first][cut].view(np.uint64) + gone[cut].astype(np.uint64))
        return {
            "a": np.concatenate([a[first], spread]).view(np.int64),
            "b": np.concatenate([b[first], b[~first][cut]]).view(np.int64),
            "doc_id": np.concatenate([doc[first], doc[~first][cut]]),
            "tid": np.concatenate([tid[first], tid[~first][cut]]),
            "run": pa.array(np.concatenate([np.zeros(first.sum(), np.int64), run]), mask=np.arange(first.sum() + len(cut)) < first.sum()),
        }

    return map_texts(docs, "text", "a long, b long, doc_id long, tid long, run long", rows)


def removals(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` (doc_id, text, tid) with is_first, null for a text that a smaller id has; and (doc_id, tid, runs), runs
    of window starts to remove from the others."""
    key = ["doc_id", "tid"]
    firsts = (
        known.select(*key, F.sha2("text", 256).alias("sha"))
        .groupBy("sha")
        .agg(F.min("doc_id").alias("doc_id"), F.first("tid").alias("tid"))
        .select(*key, F.lit(True).alias("is_first"))
    )
    marked = known.join(firsts, key, "left")
    of_hash, of_window = Window.partitionBy("h"), Window.partitionBy("a", F.shiftright("b", 32))
    shared = (
        anchors(marked)
        .withColumn("least", F.min("doc_id").over(of_hash))
        .withColumn("most", F.max("doc_id").over(of_hash))
        .filter(F.col("known").isNotNull() | (F.col("least") < F.col("most")))
        .groupBy(key)
        .agg(F.collect_set(F.coalesce("known", "h")).alias("shared"))  # at most a document's words
    )
    start = F.col("b").bitwiseAND(0xFFFFFFFF)
    runs = (
        windows(marked.join(shared, key))
        .withColumn("least", F.min("doc_id").over(of_window))
        .filter(F.col("run").isNotNull() | (F.col("least") < F.col("doc_id")))
        .groupBy(key)
        # at most a document's words
        .agg(F.collect_list(F.struct(start.alias("start"), (start + F.coalesce("run", F.lit(1))).alias("stop"))).alias("runs"))
    )
    return marked, runs


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    if dict(own.dtypes)["doc_id"] != "bigint":  # a cast that does nothing would keep Spark from reusing the shuffle of texts
        own = own.withColumn("doc_id", F.col("doc_id").cast("long"))
    # with the id, it tells a row's text; few bits, as the shuffled rows carry it
    own = own.withColumn("tid", F.xxhash64("text").bitwiseAND(0xFFFFF))
    known = own.filter(F.col("doc_id").isNotNull())
    marked, runs = removals(known)

    def rows(part: pa.RecordBatch) -> dict:
        data, words, _ = hashed_words(part.column("text"))
        n, total = np.diff(words.first), len(words.codes)
        copy = np.asarray(part.column("copy")) & (n >= WINDOW)
        lists = part.column("runs")
        of = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        starts = words.first[of] + np.asarray(flat.field("start")).astype(np.int64)
        stops = words.first[of] + np.asarray(flat.field("stop")).astype(np.int64) + WINDOW - 1
        delta = np.zeros(total + 1, np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, stops, -1)
        gone = (np.cumsum(delta[:-1]) > 0) | copy[words.of_text()]
        summed = np.append(0, np.cumsum(gone))
        # kept words joined by one space: their bytes and one more for each that isn't a text's last
        keep = np.flatnonzero(~gone)
        owner = words.of_text()[keep]
        last = np.append(owner[1:] != owner[:-1], True) if len(keep) else np.zeros(0, bool)
        size = words.stops[keep] - words.starts[keep]
        width = size + ~last
        at = np.append(0, np.cumsum(width))
        out = np.full(at[-1], 32, np.uint8)
        take = np.repeat(words.starts[keep] - at[:-1], width) + np.arange(at[-1])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], width) < np.repeat(size, width)
        out[inside] = data[take[inside]]
        offsets = at[np.searchsorted(owner, np.arange(len(part) + 1))]
        text = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
        return {
            "doc_id": part.column("doc_id"),
            "n_words": n,
            "n_removed": summed[words.first[1:]] - summed[words.first[:-1]],
            "kept_text": text,
        }

    key = ["doc_id", "tid"]
    columns = ["doc_id", "text", "copy", "runs"]
    joined = marked.withColumn("copy", F.col("is_first").isNull()).join(runs, key, "left")
    nameless = own.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")
    )
    fields = "doc_id long, n_words long, n_removed long, kept_text string"
    return map_texts(joined.select(columns).unionByName(nameless), "text", fields, rows)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
