"""Centroid clustering with bit-plane popcounts (operator 12).

A vector's 64 integer components are held in two's complement as bit planes:
plane k packs bit k of all components into one 64-bit word. A dot product is
then the sum over pairs of planes of their weights times the number of ones in
the AND of the two words, and a squared distance is |x|^2 - 2 x.c + |c|^2; both
are exact. A cluster's componentwise sums are its planes' ones counted by place.

The planes are written once to the shared folder (8 bytes a plane, as many
planes as a batch's largest component needs); each round reads them, and each
task sends at most one row per cluster and component, so what reaches the driver
is bounded by clusters times components, whatever the number of vectors.

Defined cases: vectors without exactly 64 components, or with a null or
non-finite one, are left out; so is a null vector. Component x becomes
floor(scale * x). A component of 2**27 or more in size fails the query, as a
distance would not fit a 64-bit integer. Rows with a null id are never seeds but
get a cluster. Repeated rows count each; seeds of one id are ordered by their
components. With fewer vectors than clusters there are as many clusters as
vectors; an empty table gives no row. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_engine.session import checkpoint_dir

COMPONENTS = 64
#: Components must lie below this in size.
LIMIT = 1 << 27
#: Vectors handled at a time, so that the work fits a core's cache.
CHUNK = 2048


def weights(planes: int) -> np.ndarray:
    """Value of a one in each plane; the last plane holds the sign."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def packed(values: np.ndarray) -> np.ndarray:
    """Bit planes (rows x planes) of integer vectors (rows x 64)."""
    largest = int(np.maximum(values, ~values).max(initial=0))
    if largest >= LIMIT:
        raise ValueError(f"a component of {largest} or {~largest} is too large for exact 64-bit distances")
    bits = (values[:, None, :] >> np.arange(largest.bit_length() + 1)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def ones_by_place(planes: np.ndarray) -> np.ndarray:
    """How many of the rows have a one, for each plane and component."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of each row of planes in ``x`` with each in ``c``."""
    out = np.zeros((len(x), len(c)), np.int64)
    for b, of_c in enumerate(weights(c.shape[1])):
        for a, of_x in enumerate(weights(x.shape[1])):
            out += np.bitwise_count(x[:, a, None] & c[None, :, b]) * (of_x * of_c)
    return out


def squared(x: np.ndarray) -> np.ndarray:
    """Exact squared length of each row."""
    w, out = weights(x.shape[1]), np.zeros(len(x), np.int64)
    for a in range(x.shape[1]):
        out += np.bitwise_count(x[:, a]) * (w[a] * w[a])
        for b in range(a):
            out += np.bitwise_count(x[:, a] & x[:, b]) * (2 * w[a] * w[b])
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smallest) and the squared distance to it."""
    c = packed(centroids)
    far = squared(x)[:, None] - 2 * dots(x, c) + squared(c)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def _chunks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of rows with equally many planes, some at a time."""
    length = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten()).view(np.uint64)
    begin = np.cumsum(length) - length
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for k in range(0, len(rows), CHUNK):
            some = rows[k : k + CHUNK]
            yield some, values[begin[some][:, None] + np.arange(n)]


def usable(vector: Column) -> Column:
    """Whether a vector of doubles has 64 finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == COMPONENTS) & finite, F.lit(False))


def bit_planes(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, planes) of vectors that are usable."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("vector").flatten()).reshape(-1, COMPONENTS)
            for k in range(0, len(values), CHUNK):
                whole = np.floor(values[k : k + CHUNK] * scale)
                planes = packed(np.clip(whole, -LIMIT - 1, LIMIT).astype(np.int64))
                offsets = pa.array(np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(planes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, CHUNK), lists], names=["id", "planes"])

    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("planes", T.ArrayType(T.LongType()))])
    return vectors.mapInArrow(pack, schema)


def _sums(planes: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sum of each component over each cluster's vectors; the count is kept as component 64."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), COMPONENTS + 1), np.int64)
        for batch in batches:
            for _, x in _chunks(batch.column("planes")):
                best, _ = nearest(x, centroids)
                for c in np.unique(best):
                    own = x[best == c]
                    total[c, :COMPONENTS] += weights(x.shape[1]) @ ones_by_place(own)
                    total[c, COMPONENTS] += len(own)
        cluster, component = np.nonzero((total[:, COMPONENTS] > 0)[:, None] & np.ones_like(total, bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(component), pa.array(total[cluster, component])], names=["cluster", "component", "n"]
        )

    each = planes.select("planes").mapInArrow(add, "cluster long, component long, n long")
    rows = each.groupBy("cluster", "component").agg(F.sum("n").alias("n")).collect()  # clusters x 65 at most
    return {(r.cluster, r.component): r.n for r in rows}


def moved(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without a vector stay."""
    sums, out = _sums(planes, centroids), centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, COMPONENTS)):
            out[c] = [sums[c, d] // n for d in range(COMPONENTS)]
    return out


def cluster(
    df: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every usable vector, and the final centroids."""
    checkpoint_dir(df.sparkSession)
    own = df.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("vector"))
    own = own.filter(usable(F.col("vector")))
    planes = bit_planes(own, scale).checkpoint()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = own.filter("id is not null").orderBy(order, "vector").limit(clusters).collect()
    centroids = np.floor(np.array([r.vector for r in first]).reshape(-1, COMPONENTS) * scale).astype(np.int64)
    if not len(centroids):
        return planes.filter("false").select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(planes, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for rows, x in _chunks(batch.column("planes")):
                best[rows], far[rows] = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best), pa.array(far)], names=[key, "cluster", "distance"])

    schema = T.StructType([T.StructField(key, planes.schema["id"].dataType)]).add("cluster", T.IntegerType()).add("distance", T.LongType())
    return planes.mapInArrow(assign, schema), centroids


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distances' sums over its cluster and over all, and its centroid's hash."""
    checkpoint_dir(assigned.sparkSession)
    assigned = assigned.checkpoint()
    sums = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(k, sums.get(k, 0), sum(sums.values()), centroid_hash(c)) for k, c in enumerate(centroids)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # one row for each cluster
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(rows, schema)), "cluster")
