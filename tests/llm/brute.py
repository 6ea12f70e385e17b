"""Plain single-process versions of the operators' contracts, to test against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\\x20\\x09-\\x0d]+")
KINDS = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"(AKIA)[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def secret_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def secret_row(text: str | None) -> tuple:
    spans = secret_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    n = Counter(k for *_, k in spans)
    return n["assign"], n["access"], n["hex"], sha(joined), joined


def substring_rows(docs: list[tuple]) -> list[tuple]:
    first: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = WORD.findall(lower(text or ""))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near_rows(docs: list[tuple], size: int, percent: int) -> list[tuple]:
    sets = [shingles(t, size) for _, t in docs]
    by: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    root = list(range(len(docs)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(sets):
        if docs[k][0] is None:
            continue
        both = Counter(j for x in s for j in by[x] if j < k and docs[j][0] is not None)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(docs):
        c = None if i is None else least[find(k)]
        out.append((i, len(sets[k]), c, c is None or c == i))
    return out


def bpe_row(tokenizer, text: str | None) -> tuple:
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), sha(tokenizer.decode(ids, skip_special_tokens=False))


def count_row(tokenizer, text: str | None) -> tuple:
    n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > 512


def quality_row(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    at: dict = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {k + j for x in at.values() if len(x) > 1 for k in x for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def benchmark_rows(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    word = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = word.findall(lower(text or ""))
        if item is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    sizes = sorted({len(x) for x in windows})
    out = []
    for i, text in docs:
        w = word.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out
