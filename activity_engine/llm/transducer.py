"""Minimal acyclic transducer over a sorted list of words.

States with equal futures are shared (suffixes as well as prefixes). Each arc
holds how many words pass before it, so the sum along a word's path is the
word's index in the sorted list, and the index gives its output: a run of ids.
Stored as flat arrays in one file that tasks map into memory.
"""

from __future__ import annotations

import os

import numpy as np

NAMES = ("first", "label", "target", "skip", "final", "from", "ids")
KINDS = dict(zip(NAMES, ("<u4", "u1", "<u4", "<u4", "u1", "<u4", "<u4"), strict=True))


def build(words: list[bytes], outputs: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton for distinct, sorted, non-empty ``words``."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of each finished state: its arcs as (byte, state)
    finals: list[bool] = []
    size: list[int] = []  # words below each finished state

    def finish(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(final)
            size.append(final + sum(size[t] for _, t in out))
        return register[key]

    path: list[list] = [[False, []]]  # unfinished states along the last word: final, arcs; labels between them
    labels: list[int] = []
    for word in words:
        common = 0
        while common < min(len(word), len(labels)) and word[common] == labels[common]:
            common += 1
        while len(labels) > common:
            state = finish(*path.pop())
            path[-1][1].append((labels.pop(), state))
        for b in word[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        state = finish(*path.pop())
        path[-1][1].append((labels.pop(), state))
    finish(*path.pop())

    first = np.append(0, np.cumsum([len(a) for a in arcs]))
    skip = []
    for final, out in zip(finals, arcs, strict=True):
        passed = int(final)
        for _, target in out:
            skip.append(passed)
            passed += size[target]
    got = {
        "first": first,
        "label": [b for out in arcs for b, _ in out],
        "target": [t for out in arcs for _, t in out],
        "skip": skip,
        "final": finals,
        "from": np.append(0, np.cumsum([len(x) for x in outputs])),
        "ids": [i for x in outputs for i in x],
    }
    return {k: np.asarray(v, KINDS[k]) for k, v in got.items()}


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the arrays' lengths, then the arrays, each from a multiple of 8 bytes on."""
    part = f"{path}.{os.getpid()}"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays[k]) for k in NAMES], "<u8").tobytes())
        for k in NAMES:
            raw = arrays[k].tobytes()
            f.write(raw + bytes(-len(raw) % 8))
    os.replace(part, path)


class Transducer:
    """A saved automaton, mapped into memory; tasks of one machine share its pages."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        lengths, at, a = raw[: 8 * len(NAMES)].view("<u8"), 8 * len(NAMES), {}
        for k, n in zip(NAMES, lengths.tolist(), strict=True):
            width = n * np.dtype(KINDS[k]).itemsize
            a[k] = raw[at : at + width].view(KINDS[k])
            at += width + -width % 8
        self.first, self.label, self.target, self.skip, self.final, self.begin, self.ids = (a[k] for k in NAMES)
        self.root = len(self.first) - 2

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Index of each word data[start:stop] in the sorted list, or -1; all words walk a byte at a time together."""
        n = len(starts)
        state, index = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        length, alive, depth = stops - starts, np.flatnonzero(stops > starts), 0
        found = np.full(n, -1, np.int64)
        # arcs sorted by (state, label): one binary search finds the arc of every word
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first.astype(np.int64))) << 8 | self.label
        while len(alive):
            want = state[alive] << 8 | data[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            ok = keys[arc] == want if len(keys) else np.zeros(len(alive), bool)
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.target[arc]
            index[alive] += self.skip[arc]
            depth += 1
            over = length[alive] == depth
            done = alive[over]
            done = done[self.final[state[done]] > 0]
            found[done] = index[done]
            alive = alive[~over]
        return found
