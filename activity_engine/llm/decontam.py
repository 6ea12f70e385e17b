"""Benchmark decontamination (operator 9): a prefix-filtered set join.

Every benchmark item is cut into windows of 13 words (a shorter item is one
window). A document can hold a window only if it holds the window's rarest
word, so that word, rarest by its count in all documents, is the window's
prefix: it alone is searched. Each of its occurrences fixes where the window
would start (positional bound); the window must fit into the document (length
bound), its hash must be that of a window, and its words are then compared one
by one.

The benchmark is a stated query set. It is dealt into blocks of about
BLOCK_WINDOWS windows, whatever its size; each block is broadcast on its own
and all documents pass by it. With several blocks, each one's hits are written
(rows with a hit alone) and its broadcast is destroyed before the next is made,
so one block is live at a time; the hits are then joined to the documents, which
are written once for it.

Defined cases: null texts and texts without words have no windows and no hits;
items with a null id are no items; items with one id are one item; an empty
benchmark hits nothing; each document row gives one row, repeated rows and
null ids included; columns with the new names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.session import checkpoint_dir

from .words import Words, append, buffer, map_texts, slices, split, window_hash, window_starts

WINDOW = 13
#: Windows in a broadcast block: with 13 words each, some 20 MB at most for words of usual length.
BLOCK_WINDOWS = 50_000

#: Bytes that aren't in words, once A-Z are lower case: all of ASCII but 0-9 and a-z.
NOT_WORD = np.array([b < 128 and not (48 <= b < 58 or 97 <= b < 123) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)

#: Numbers the rows while several blocks pass.
ROW = "row_of_decontamination"

FIELDS = "n_words long, n_hit long, hit_spans array<struct<start:int,stop:int>>, items array<string>"


class Block(NamedTuple):
    vocabulary: pa.Array  # distinct words of the block's windows
    rows: dict[int, np.ndarray]  # by length: each distinct window's words, as indices into the vocabulary
    items: dict[int, list[list[str]]]  # by length: the ids of the items that hold the window
    prefix: dict[tuple[int, int], np.ndarray]  # by length and offset: the words that are a prefix there
    sorted: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hashes in order, and the window of each


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    data, offsets = buffer(texts)
    data = LOWER[data]
    return data, offsets, split(data, offsets, NOT_WORD)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): the word sequences that count as an item's occurrence."""

    def rows(part: pa.RecordBatch) -> dict:
        _, _, words = words_of(part.column("text"))
        at, n = window_starts(words, size), np.diff(words.first)
        short = np.flatnonzero((n > 0) & (n < size))
        first = np.concatenate([at, words.first[short]])
        length = np.concatenate([np.full(len(at), size), n[short]]).astype(np.int64)
        owner = words.of_text()[first] if len(first) else np.zeros(0, np.int64)
        flat = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        seq = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(length)), pa.int32()),
            words.distinct.cast(pa.string()).take(pa.array(words.codes[flat])),
        )
        return {"item_id": part.column("item_id").take(pa.array(owner)), "window": seq}

    own = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_texts(own, "text", "item_id string, window array<string>", rows).distinct()


def corpus_counts(docs: DataFrame, column: str, vocabulary: list[str]) -> np.ndarray:
    """Occurrences of each word of the vocabulary in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.value, pa.large_string())
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            for part in slices(batch, column):
                _, _, words = words_of(part.column(column))
                if len(words.distinct):
                    found = np.asarray(pc.fill_null(pc.index_in(words.distinct, values), -1))
                    each = np.bincount(words.codes, minlength=len(words.distinct))
                    total += np.bincount(found[found >= 0], each[found >= 0], len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    found = docs.select(column).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary), np.int64)
    for word, n in found.collect():  # bounded by the block's vocabulary
        counts[word] = n
    return counts


def make_block(rows: list, docs: DataFrame, column: str) -> Block:
    """A block from its (item_id, window) rows."""
    owners: dict[tuple, list] = {}
    for item, window in rows:
        owners.setdefault(tuple(window), []).append(item)
    vocabulary = sorted({w for window in owners for w in window})
    index = {w: i for i, w in enumerate(vocabulary)}
    rarity = corpus_counts(docs, column, vocabulary)
    by_length: dict[int, list] = {}
    for window in sorted(owners):
        by_length.setdefault(len(window), []).append(window)
    block = Block(pa.array(vocabulary, pa.large_string()), {}, {}, {}, {})
    for n, windows in by_length.items():
        ids = np.array([[index[w] for w in window] for window in windows], np.int64).reshape(-1, n)
        block.rows[n] = ids
        block.items[n] = [sorted(set(owners[w])) for w in windows]
        offset = np.argmin(rarity[ids], axis=1)
        for o in np.unique(offset):
            block.prefix[n, int(o)] = np.unique(ids[offset == o, o])
        hashes = row_hash(ids)
        order = np.argsort(hashes)
        block.sorted[n] = (hashes[order], order)
    return block


def row_hash(ids: np.ndarray) -> np.ndarray:
    flat = word_values(ids.ravel())
    return window_hash(flat, np.arange(len(ids)) * ids.shape[1], ids.shape[1])


def word_values(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64) + 2).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def find(words: Words, block: Block) -> tuple[list, list, list]:
    """Occurrences of the block's windows: index of the first word, length, index of the window."""
    starts, lengths, windows = [], [], []
    if not len(words.codes):
        return starts, lengths, windows
    known = np.asarray(pc.fill_null(pc.index_in(words.distinct, block.vocabulary), -1)).astype(np.int64)
    ids = known[words.codes]
    values = word_values(ids)
    seen = np.flatnonzero(ids >= 0)
    of = words.of_text()
    low, high = words.first[:-1][of], words.first[1:][of]
    for (n, offset), prefix in block.prefix.items():
        here = np.zeros(len(block.vocabulary), bool)
        here[prefix] = True
        at = seen[here[ids[seen]]]
        at = at[(at - offset >= low[at]) & (at - offset + n <= high[at])] - offset
        hashes, order = block.sorted[n]
        got = window_hash(values, at, n)
        place = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
        at, place = at[hashes[place] == got], place[hashes[place] == got]
        same = (ids[at[:, None] + np.arange(n)] == block.rows[n][order[place]]).all(axis=1)
        starts.append(at[same])
        lengths.append(np.full(same.sum(), n))
        windows.append(order[place[same]])
    return starts, lengths, windows


def hits(docs: DataFrame, benchmark: DataFrame, column: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word indices) and items (ids of the items found)."""

    def none(part: pa.RecordBatch) -> dict:
        _, _, words = words_of(part.column(column))
        n = len(part)
        return {"n_words": np.diff(words.first), "n_hit": np.zeros(n, np.int64), "hit_spans": [[]] * n, "items": [[]] * n}

    windows = item_windows(benchmark).cache()
    blocks = math.ceil(windows.count() / block_windows)
    if not blocks:
        return append(docs, column, FIELDS, none)
    spark = docs.sparkSession
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)))

    def block(k: int):
        rows = dealt.filter(F.col("block") == k).select("item_id", "window").collect()  # about block_windows rows
        return spark.sparkContext.broadcast(make_block(rows, docs, column))

    if blocks == 1:
        out = pass_by(docs, block(0), column, first=True)
    else:
        base = f"{checkpoint_dir(spark)}/decontamination-{uuid.uuid4().hex}"
        own = docs.withColumn(ROW, F.monotonically_increasing_id()).checkpoint()
        for k in range(blocks):
            shared = block(k)
            found = pass_by(own.select(ROW, column), shared, column, first=True)
            found.filter("n_hit > 0").select(ROW, "hit_spans", "items").write.parquet(f"{base}/{k}")
            shared.destroy()
        # a row's hits in the blocks: at most one row for each
        old = spark.read.parquet(*[f"{base}/{k}" for k in range(blocks)]).groupBy(ROW)
        old = old.agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items"))
        left = own.drop("hit_spans", "items").join(old, ROW, "left")
        none_yet = [F.coalesce(c, F.array().cast(old.schema[c].dataType)).alias(c) for c in ("hit_spans", "items")]
        merged = left.select(*[f"`{c}`" for c in left.columns if c not in ("hit_spans", "items")], *none_yet)
        nothing = spark.sparkContext.broadcast(Block(pa.array([], pa.large_string()), {}, {}, {}, {}))
        out = pass_by(merged, nothing, column, first=False).drop(ROW)
    windows.unpersist()
    return out


def pass_by(docs: DataFrame, shared, column: str, first: bool) -> DataFrame:
    """Adds the hits of the block in the broadcast ``shared`` to those that the columns hold already (none if ``first``)."""

    def rows(part: pa.RecordBatch) -> dict:
        own = shared.value
        _, _, words = words_of(part.column(column))
        n, total = len(part), len(words.codes)
        starts, lengths, windows = find(words, own)
        delta = np.zeros(total + 1, np.int64)
        for at, length in zip(starts, lengths, strict=True):
            np.add.at(delta, at, 1)
            np.add.at(delta, at + length, -1)
        old_spans = [[]] * n if first else part.column("hit_spans").to_pylist()
        old_items = [[]] * n if first else part.column("items").to_pylist()
        for i, spans in enumerate(old_spans):
            for s in spans:
                delta[words.first[i] + s["start"]] += 1
                delta[words.first[i] + s["stop"]] -= 1
        hit = np.cumsum(delta[:-1]) > 0
        summed = np.append(0, np.cumsum(hit))
        # a span ends where the hits end or the text does
        edge = np.zeros(total + 1, bool)
        edge[words.first] = True
        opens = np.flatnonzero(hit & (edge[:-1] | np.append(True, ~hit[:-1]))) if total else np.zeros(0, np.int64)
        closes = np.flatnonzero(hit & (edge[1:] | np.append(~hit[1:], True))) + 1 if total else opens
        of = words.of_text()
        spans: list[list] = [[] for _ in range(n)]
        for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
            base = int(words.first[of[a]])
            spans[of[a]].append({"start": a - base, "stop": b - base})
        items = [set(x) for x in old_items]
        for at, length, window in zip(starts, lengths, windows, strict=True):
            if len(at):
                pairs = np.unique(np.stack([of[at], window]), axis=1)
                for text, w in pairs.T.tolist():
                    items[text].update(own.items[int(length[0])][w])
        return {
            "n_words": np.diff(words.first),
            "n_hit": summed[words.first[1:]] - summed[words.first[:-1]],
            "hit_spans": spans,
            "items": [sorted(x) for x in items],
        }

    return append(docs, column, FIELDS, rows)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """``hits`` and the verdict: a hit, and at least one word in 20 is hit."""
    found = hits(docs, benchmark, column)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
