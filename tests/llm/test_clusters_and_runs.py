"""Centroid clustering and periodic runs against plain versions, on the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest

from activity_engine.llm import bitplanes, queries, runs


# -- clusters ------------------------------------------------------------------
def cluster_rows(rows: list[tuple], k: int = 16, rounds: int = 3) -> list[tuple]:
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in seeds[:k]]
    if not centroids:
        return []

    def assign() -> list[tuple[int, int]]:
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in kept]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        own: dict[int, list] = {}
        for (c, _), (_, v) in zip(assign(), kept, strict=True):
            own.setdefault(c, []).append(v)
        for c, vs in own.items():
            centroids[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    got = assign()
    inertia = {c: sum(d for x, d in got if x == c) for c in range(len(centroids))}
    return [
        (i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, got, strict=True)
    ]


def normal(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


def test_clusters(spark):
    r = random.Random(3)
    # components of very different sizes, so that batches need different numbers of planes
    rows = [(i, [r.gauss(0, 10 ** r.choice((-2, 0, 3))) for _ in range(64)]) for i in range(300)]
    rows += [(i, [float(i % 3)] * 64) for i in range(300, 330)]  # ties
    rows += [rows[5], rows[5], (5, [0.5] * 64), (None, rows[7][1])]  # repeated rows, one id with two vectors, no id
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63)]
    rows += [(405, [math.nan] + [1.0] * 63), (406, [math.inf] + [1.0] * 63), (407, [-0.0] * 64), (408, [-1.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = bitplanes.with_inertia(*bitplanes.cluster(df.repartition(5)))
    assert got.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert normal(got.select(names).collect()) == normal(cluster_rows(rows))
    few = df.filter("vec_id in (1, 2, 400)")
    want = cluster_rows([x for x in rows if x[0] in (1, 2, 400)])
    assert normal(bitplanes.with_inertia(*bitplanes.cluster(few)).select(names).collect()) == normal(want)
    none = bitplanes.with_inertia(*bitplanes.cluster(df.filter("false")))
    assert none.count() == 0 and none.select(names).dtypes == got.select(names).dtypes
    with pytest.raises(Exception, match="too large"):
        bitplanes.cluster(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>"))[0].collect()


def test_planes():
    r = np.random.default_rng(1)
    x, c = r.integers(-5000, 5000, (70, 64)), r.integers(-(1 << 26), 1 << 26, (9, 64))
    x[0], c[0] = 0, -1
    assert (bitplanes.dots(bitplanes.packed(x), bitplanes.packed(c)) == x @ c.T).all()
    assert (bitplanes.squared(bitplanes.packed(c)) == (c * c).sum(axis=1)).all()
    w = bitplanes.weights(bitplanes.packed(x).shape[1])
    assert (w @ bitplanes.ones_by_place(bitplanes.packed(x)) == x.sum(axis=0)).all()


# -- runs ----------------------------------------------------------------------
def runs_of(w: list[str], least: int = 6, times: int = 4) -> list[tuple]:
    out, seen = [], []
    for q in range(1, len(w) // times + 1):
        k = 0
        while k + q < len(w):
            start = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            length = k - start + q
            if k > start and length >= max(least, times * q) and not any(a <= start and start + length <= b for a, b in seen):
                out.append((start, length, q))
            if k > start:
                seen.append((start, start + length))
            k += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def woven(i, w: list[str]) -> list[str]:
    if i is None or not w:
        return w
    h = zlib.crc32(str(i).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def runs_row(i, text: str | None) -> tuple:
    w = woven(i, brute.WORD.findall(text or ""))
    own = runs_of(w)
    gone = {k for s, n, q in own for k in range(s + q, s + n)}
    best = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in own)
    return i, len(own), *four, brute.sha(lines), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def texts() -> list[tuple]:
    r = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a a a a a a"), (6, "a a a a a"), (7, "a b a b a b a b"), (8, "a b a b a b a")]
    rows += [(9, "x " + "a b c " * 5 + "a y"), (10, "a a b " * 9 + "a a"), (None, "b " * 30), (11, "é   " * 8), (12, "q " * 3000)]
    for i in range(20, 260):  # few different words, with stretches repeated
        w = [r.choice("abc"[: r.choice((1, 2, 3))]) for _ in range(r.randrange(1, 90))]
        if r.random() < 0.6:
            k, n = r.randrange(len(w)), r.randrange(1, 9)
            w[k:k] = w[k : k + n] * r.randrange(2, 9)
        rows.append((i, " ".join(w)))
    # nested runs: a period that itself holds runs
    inner = "a " * 7 + "b " + "c d " * 5
    rows += [(300, inner * 6), (301, (inner * 5 + "e ") * 5), (302, " ".join(str(k % 700) for k in range(6000)))]
    line = "one line of a text that stands in it often "
    rows += [(303, " ".join(line + r.choice("xyz") for _ in range(300))), (12, "q " * 3000), (12, "other")]
    return rows


def test_runs(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, RUNS int, collapsed string").repartition(4)
    got = runs.digest(runs.periodic_runs(df, weave=runs.woven)).collect()
    assert normal(got) == normal(runs_row(i, t) for i, t in rows)
    assert sum(r.n_runs for r in got) > 200 and sum(1 for i, _ in rows if i and not zlib.crc32(str(i).encode()) % 10) > 10
    assert runs.periodic_runs(df.filter("false")).count() == 0


@pytest.mark.parametrize("shape", [(2, 2), (5, 3), (12, 4)])
def test_other_shapes(spark, shape):
    rows = [x for x in texts() if x[1] and len(x[1]) < 500]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = runs.periodic_runs(df, shape=runs.Shape(*shape)).collect()
    want = [(i, [tuple(x) for x in runs_of(brute.WORD.findall(t), *shape)]) for i, t in rows]
    assert normal((r.doc_id, [tuple(x) for x in r.runs]) for r in got) == normal(want)


def test_registered_queries(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert normal(queries.op13_periodic_runs(spark, sf_dir).collect()) == normal(
        runs_row(i, t) for i, t in docs
    )
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_bitplane_clusters(spark, sf_dir)
    assert normal(got.collect()) == normal(cluster_rows(vectors))
