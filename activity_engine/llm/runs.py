"""Periodic runs of words by descending-LCP Kruskal (operator 13).

A run is a stretch of words with smallest period q that no neighbouring word
extends. For a run of period q from word s, the suffixes from s and s + q share
exactly length - q words. So the suffixes of a text are sorted (prefix doubling,
each round sorting only those still tied), and suffix classes are united by
decreasing length of the common prefix (LCP), with union-find over ordered sets
of their positions, the smaller set going into the larger. Two positions that
become neighbours in a united set, at a distance within the LCP at which it was
united, seed a run; it is one if the words before them differ (else an earlier
pair has it). Between s and s + q no other position can share so many words, so
every run is found, and found once, with its smallest period.

The shortest LCP that a run can have bounds the work: only words at which as
long a sequence repeats inside their text are sorted, and only classes whose
smallest distance fits their largest LCP are united. A text is handled whole by
one task, in time n log n (squared) and memory linear in its words.

Defined cases: a null or empty text, or one without words, has no run and an
empty collapsed text. Rows with a null id are as others (and never rearranged by
``woven``). Each input row gives one row; columns with the new names are replaced.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACES, append, buffer, mixed, split, window_hash

RUN = "struct<start:long,length:long,period:long>"


class Shape(NamedTuple):
    """What counts as a run: at least ``least`` words and ``times`` (2 or more) periods."""

    least: int = 6
    times: int = 4

    def shared(self, distance: int) -> int:
        """Words that the suffixes at a run's first two periods share, at least."""
        return max(self.least - distance, (self.times - 1) * distance)

    @property
    def shortest(self) -> int:
        return min(self.shared(d) for d in range(1, max(2, self.least)))


class Pairs(NamedTuple):
    """Neighbours in the order of suffixes, as positions, with their LCP and class."""

    left: np.ndarray
    right: np.ndarray
    lcp: np.ndarray


def repeated(codes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a sequence of ``size`` words starts that its text has twice (by hash: some more may come)."""
    at = np.flatnonzero(np.arange(len(codes)) + size <= np.repeat(first[1:], np.diff(first)))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    h = window_hash(mixed(codes.astype(np.uint64) + np.uint64(1)), at, size) ^ mixed(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.append(False, same) | np.append(same, False)
    return np.sort(at[order[twice]])


def neighbours(codes: np.ndarray, first: np.ndarray, shape: Shape) -> Pairs:
    """Pairs of suffixes of one text that are neighbours in sorted order and share ``shape.shortest`` words or more."""
    size = shape.shortest
    seeds = repeated(codes, first, size)
    end = np.repeat(first[1:], np.diff(first))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    after = seeds + size
    after = after[after < end[seeds]]
    spots = np.union1d(seeds, after)
    none = np.zeros(0, np.int64)
    if not len(seeds):
        return Pairs(none, none, none)
    place = np.full(len(codes), -1, np.int64)  # of a position, in ``spots``
    place[spots] = np.arange(len(spots))

    def word(offset: int) -> np.ndarray:
        return np.where(spots + offset < end[spots], codes[np.minimum(spots + offset, len(codes) - 1)], -1)

    columns = [text[spots], *[word(k) for k in range(size)]]
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    # a rank is the first place of a group, from 1; 0 stands for a text's end
    group = np.flatnonzero(new)
    rank = np.empty(len(spots), np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, len(order)))) + 1
    levels, length = [], size
    tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
    while True:
        levels.append((length, rank))
        if not len(tied):
            break
        ahead = spots[tied] + length
        inside = ahead < end[spots[tied]]
        follow = np.where(inside, rank[place[np.where(inside, ahead, 0)]], 0)
        order = np.lexsort((follow, rank[tied]))
        tied, follow, old = tied[order], follow[order], rank[tied[order]]
        head = np.append(True, old[1:] != old[:-1])
        sub = head | np.append(True, follow[1:] != follow[:-1])
        at = np.arange(len(tied))
        start_of_head = np.maximum.accumulate(np.where(head, at, 0))
        start_of_sub = np.maximum.accumulate(np.where(sub, at, 0))
        rank = rank.copy()
        rank[tied] = old + start_of_sub - start_of_head
        alone = sub & np.append(sub[1:], True)
        tied, length = tied[~alone], 2 * length
    sorted_spots = np.empty(len(spots), np.int64)
    sorted_spots[levels[-1][1] - 1] = np.arange(len(spots))
    base = levels[0][1][sorted_spots]
    alike = np.flatnonzero(base[1:] == base[:-1])
    left, right, base = spots[sorted_spots[alike]], spots[sorted_spots[alike + 1]], base[alike]
    lcp = np.zeros(len(left), np.int64)
    for length, ranks in reversed(levels):
        inside = (left + lcp < end[left]) & (right + lcp < end[right])
        a, b = np.where(inside, left + lcp, left), np.where(inside, right + lcp, right)
        lcp += length * (inside & (ranks[place[a]] == ranks[place[b]]))
    going = np.ones(len(left), bool)
    for _ in range(size - 1):
        going &= (left + lcp < end[left]) & (right + lcp < end[right])
        a, b = np.where(going, left + lcp, left), np.where(going, right + lcp, right)
        going &= codes[a] == codes[b]
        lcp += going
    return _fitting(spots, levels[0][1], left, right, lcp, base, shape)


def _fitting(spots, rank, left, right, lcp, base, shape: Shape) -> Pairs:
    """Pairs of the classes whose smallest distance of two positions fits their largest LCP."""
    if not len(left):
        return Pairs(left, right, lcp)
    most = np.zeros(int(rank.max()) + 1, np.int64)
    np.maximum.at(most, base, lcp)
    order = np.argsort(rank, kind="stable")  # positions ascend in each class
    gap = np.diff(spots[order])
    one = rank[order][1:] == rank[order][:-1]
    near = np.full(len(most), np.iinfo(np.int64).max // shape.times)
    np.minimum.at(near, rank[order][1:][one], gap[one])
    fits = most >= np.maximum(shape.least - near, (shape.times - 1) * near)
    return Pairs(*[x[fits[base]] for x in (left, right, lcp)])


def found(codes: np.ndarray, first: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of all texts, by start and period; starts count from the first text's first word."""
    pairs = neighbours(codes, first, shape)
    order = np.argsort(-pairs.lcp, kind="stable")
    spots, ends = np.unique(np.concatenate([pairs.left, pairs.right]), return_inverse=True)
    of_left, of_right = ends[: len(order)][order].tolist(), ends[len(order) :][order].tolist()
    root = list(range(len(spots)))
    sets: list[list[int]] = [[x] for x in spots.tolist()]
    begin = set(first.tolist())
    word = codes.tolist() if len(spots) else []
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y, shared in zip(of_left, of_right, pairs.lcp[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets[y]
        root[y], sets[y] = x, []
        if 8 * len(small) > len(large):
            large += small
            large.sort()  # two ascending parts: linear
        else:
            for p in small:
                insort(large, p)
        for before, p, after in zip([None, *small], small, [*small[1:], None], strict=False):
            k = bisect_left(large, p)
            i, j = large[k - 1] if k else before, large[k + 1] if k + 1 < len(large) else after
            # neighbours from the two old sets share exactly ``shared`` words; a run's first pair has nothing before it
            if i != before and shared >= shape.shared(p - i) and (i in begin or word[i - 1] != word[p - 1]):
                out.append((i, p - i + shared, p - i))
            if j != after and shared >= shape.shared(j - p) and (p in begin or word[p - 1] != word[j - 1]):
                out.append((p, j - p + shared, j - p))
    return sorted(out, key=lambda r: (r[0], r[2]))


Weave = Callable[[list, np.ndarray], np.ndarray]


def woven(ids: list, counts: np.ndarray) -> np.ndarray:
    """For each word, which word of its text stands there: in one text in ten (by its id's CRC-32) the words from a
    place on repeat with a period, both set by the CRC-32."""
    out = [np.zeros(0, np.int64)]
    for key, n in zip(ids, counts.tolist(), strict=True):
        at = np.arange(n)
        g, rest = divmod(zlib.crc32(str(key).encode()), 10)
        if key is not None and rest == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[a:] = a + (at[a:] - a) % p
        out.append(at)
    return np.concatenate(out)


def periodic_runs(docs: DataFrame, column: str = "text", key: str = "doc_id", shape: Shape = Shape(), weave: Weave | None = None) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``: the words joined by one space, of each run the first period alone."""

    def rows(part: pa.RecordBatch) -> dict:
        words = split(*buffer(part.column(column)), SPACES)
        codes, first = words.codes.astype(np.int64), words.first
        if weave:
            codes = codes[np.repeat(first[:-1], np.diff(first)) + weave(part.column(key).to_pylist(), np.diff(first))]
        runs = np.array(found(codes, first, shape), np.int64).reshape(-1, 3)
        gone = np.zeros(len(codes) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        strings = words.distinct.take(pa.array(codes[kept]))
        upto = np.append(0, np.cumsum(kept))[first]
        text = np.searchsorted(first, runs[:, 0], side="right") - 1
        fields = [pa.array(runs[:, 0] - first[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        each = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
        return {
            "runs": pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32()), each),
            "collapsed": pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), strings), pa.scalar(" ", pa.large_string())),
        }

    return append(docs, column, f"runs array<{RUN}>, collapsed string", rows)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: the first); null without one."""

    def better(a: Column, b: Column) -> Column:
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))


def digest(found_runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of what ``periodic_runs`` gives."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found_runs.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
