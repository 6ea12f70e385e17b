"""MinHash near-duplicates with sequential Bayesian verification (operator 3).

1. Each text's set of word shingles is hashed; its minhash signature is cut into
   bands. Texts with one set are one class, and only classes go on.
2. Every class is paired with the smallest class beside it in any band's bucket
   (its hub): one pair for a class, never all pairs of a group.
3. A pair's signatures are compared batch by batch. With a uniform prior on the
   similarity, m matches of n hashes give it a beta posterior; the pair is pruned
   once the posterior probability of reaching the threshold is below a limit.
   The limit is the largest power of a half with which all batches together prune
   a pair at the threshold with probability below MISS. Survivors are verified
   exactly on their full shingle sets.
4. Linked classes merge. Classes of buckets that still hold several components
   are the rest: they are compared in bounded blocks, block against block, and
   every pair that shares a bucket and isn't connected yet is pruned or verified
   the same way. So no candidate pair between components stays unexamined. Only
   the sets are sent to the blocks; signatures are made again there. Survivors of
   one class are verified together, by counting its shingles' postings.

Bands are chosen so that a pair at the threshold shares none with probability
below MISS.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; a text of fewer words than a shingle has the whole
sequence as one; a row with a null id is linked with nothing (component_id
null, kept); rows with one id are judged each by its own text, repeated rows
alike, each gives a row; classes are told apart by their sets, not by ids, so
two texts of one id are linked only if they are alike; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.session import checkpoint_dir

from .components import components
from .decontam import LOWER
from .words import SPACES, buffer, digests, map_rows, map_texts, mixed, split, window_hash, window_starts

#: Probability with which a pair at the threshold may be missed by the bands, and by the pruning.
MISS = 1e-6

#: A block of the rest has about so many classes, and so many bytes of shingle hashes, at most.
BLOCK_ITEMS = 4096
BLOCK_BYTES = 24 << 20


@dataclass(frozen=True)
class Settings:
    size: int = 5  # words in a shingle
    percent: int = 80  # of the union that the intersection must reach
    most: int = 128  # hashes in a signature

    def bands(self) -> tuple[int, int]:
        """(rows, bands): the longest rows whose bands keep the miss probability within the signature."""
        t = self.percent / 100
        for rows in range(16, 1, -1):
            bands = math.ceil(math.log(MISS) / math.log(1 - t**rows))
            if rows * bands <= self.most:
                return rows, bands
        return 1, self.most


def least_matches(threshold: float, n: int, limit: float = MISS) -> int:
    """Fewest matches of n with which a pair goes on: P(similarity >= threshold | matches) is ``limit`` at least.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail above
    the threshold is the chance of m successes or fewer in n + 1 trials.
    """
    posterior = 0.0
    for m in range(n + 1):
        posterior += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if posterior >= limit:
            return m
    return n


def missed(threshold: float, steps: list[int], least: list[int]) -> float:
    """Probability that a pair at the threshold is pruned by any of the checks."""
    alive, done, lost = {0: 1.0}, 0, 0.0
    for n, m in zip(steps, least, strict=True):
        new = [0.0] * (n + 1)
        for x, p in alive.items():
            for k in range(n - done + 1):
                new[x + k] += p * math.comb(n - done, k) * threshold**k * (1 - threshold) ** (n - done - k)
        lost += math.fsum(new[:m])
        alive, done = {x: new[x] for x in range(m, n + 1)}, n
    return lost


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, one text after another, and where each begins."""
    data, offsets = buffer(texts)
    data = LOWER[data]
    words = split(data, offsets, SPACES)
    values = digests(words.distinct)[words.codes, 0] if len(words.distinct) else np.zeros(0, np.uint64)
    n = np.diff(words.first)
    at = window_starts(words, size)
    of, h = words.of_text()[at] if len(at) else at, window_hash(values, at, size)
    short = np.flatnonzero((n > 0) & (n < size))
    for k in range(1, size):
        some = short[n[short] == k]
        of = np.concatenate([of, some])
        h = np.concatenate([h, window_hash(values, words.first[some], k) ^ np.uint64(k)])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(of[new], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, begins: np.ndarray, hashes: int, step: int = 1 << 15) -> np.ndarray:
    """Minhash signatures (32 bits a hash) of the non-empty sets, one row each; work goes in cache-sized runs."""
    own = np.flatnonzero(np.diff(begins))
    out = np.full((len(own), hashes), 0xFFFFFFFF, np.uint32)
    if not len(own):
        return out
    k = np.arange(1, hashes + 1, dtype=np.uint64)
    factor, plus = mixed(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mixed(k * np.uint64(0xC2B2AE3D27D4EB4F))
    row = np.repeat(np.arange(len(own)), np.diff(begins)[own])
    for a in range(0, len(sets), step):
        x, r = sets[a : a + step], row[a : a + step]
        cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rows = r[cuts]
        for j in range(hashes):
            v = ((x * factor[j] + plus[j]) >> np.uint64(32)).astype(np.uint32)
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(v, cuts))
    return out


def band_keys(sig: np.ndarray, rows_in_band: int, bands: int) -> np.ndarray:
    """Each signature's bucket in each band, one row for a signature."""
    at = np.arange(len(sig)) * rows_in_band
    each = (sig[:, b * rows_in_band : (b + 1) * rows_in_band].astype(np.uint64).ravel() + np.uint64(b << 32) for b in range(bands))
    return np.stack([window_hash(x, at, rows_in_band) for x in each], axis=1)


def profiles(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text_hash, set_id, n_shingles, signature, bands): set_id hashes the whole set (null if it is empty)."""
    rows_in_band, bands = settings.bands()

    def rows(part: pa.RecordBatch) -> dict:
        sets, begins = shingle_sets(part.column("text"), settings.size)
        n = np.diff(begins)
        own = np.flatnonzero(n)
        sig = signatures(sets, begins, rows_in_band * bands)
        keys = band_keys(sig, rows_in_band, bands)
        place = np.full(len(n), -1)
        place[own] = np.arange(len(own))
        take = pa.array(place, mask=place < 0)
        raw = memoryview(sets.tobytes())
        ids = [
            hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)
        ]
        width = 4 * rows_in_band * bands
        packed = pa.Array.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(sig.tobytes())])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands)
        return {
            "doc_id": part.column("doc_id"),
            "text_hash": part.column("text_hash"),
            "set_id": ids,
            "n_shingles": n,
            "signature": packed.cast(pa.binary()).take(take),
            "bands": lists.cast(pa.list_(pa.int64())).take(take),
        }

    schema = "doc_id long, text_hash long, set_id binary, n_shingles long, signature binary, bands array<long>"
    return map_texts(docs, "text", schema, rows)


def checks(settings: Settings, batch: int = 16) -> tuple[list[int], list[int]]:
    """After how many hashes a pair is judged, and the fewest matches with which it goes on."""
    rows_in_band, bands = settings.bands()
    steps, t = [*range(batch, rows_in_band * bands, batch), rows_in_band * bands], settings.percent / 100
    limit = 0.5
    while missed(t, steps, least := [least_matches(t, n, limit) for n in steps]) > MISS:
        limit /= 2
    return steps, least


def pruned(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose similarity may reach the threshold: sizes first, then signatures batch by batch."""
    steps, least = checks(settings)
    hashes = steps[-1]

    def rows(part: pa.RecordBatch) -> dict:
        left, right = (
            np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, hashes)
            for c in ("signature_a", "signature_b")
        )
        alive, matches, done = np.arange(len(part)), np.zeros(len(part), np.int64), 0
        for n, m in zip(steps, least, strict=True):
            matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            alive, done = alive[matches[alive] >= m], n
        passed = np.zeros(len(part), bool)
        passed[alive] = True
        return {"passed": passed}

    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return map_rows(pairs.filter(100 * small >= settings.percent * large), "passed boolean", rows).filter("passed")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): pairs of class representatives that are linked."""

    def side(x: str) -> DataFrame:
        return classes.select(
            F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}")
        )

    def exact(part: pa.RecordBatch) -> dict:
        passed = []
        for x, y in zip(part.column("set_a"), part.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            passed.append(100 * both >= settings.percent * (len(x) + len(y) - both))
        return {"linked": passed}

    likely = pruned(pairs.join(side("a"), "a").join(side("b"), "b"), settings).select("a", "b")
    full = likely.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b"
    )
    return map_rows(full, "linked boolean", exact).filter("linked").select("a", "b").distinct()


def class_links(classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(id, component) of the class representatives that are linked with another class."""
    members = classes.select("rep", F.explode("bands").alias("key"))
    hubs = (
        members.groupBy("key")
        .agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
        .filter(F.col("hub") < F.col("last"))
    )
    buckets = members.join(hubs.select("key", "hub"), "key").checkpoint()
    needed = buckets.select("rep").distinct()

    def rows(part: pa.RecordBatch) -> dict:
        sets, begins = shingle_sets(part.column("text"), settings.size)
        raw = sets.tobytes()
        cut = [raw[8 * a : 8 * b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        return {"rep": part.column("rep"), "set": cut}

    # one text stands for a class: its least id's, told from other texts of that id by its hash
    which = classes.select("rep", "least.doc_id", "least.text_hash").join(needed, "rep", "left_semi")
    texts = docs.join(which, ["doc_id", "text_hash"]).select("rep", "text")
    sets = map_texts(texts, "text", "rep long, set binary", rows).distinct().checkpoint()
    stars = buckets.filter(F.col("rep") > F.col("hub")).groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a"))
    links = verified(stars, classes, sets, settings).checkpoint()
    found = components(links, "a", "b").checkpoint()

    at = buckets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "hub", "rep", F.coalesce("component", "rep").alias("component")
    )
    several = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    left = at.join(several.select("key"), "key", "left_semi").checkpoint()
    more = rest_links(left, sets, settings)
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b")


def rest_links(left: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between components that still share a bucket; ``left`` has key, hub, rep and component.

    Classes that buckets connect form a cluster, dealt into blocks. Each pair of
    blocks is one group, in which every pair of classes with a common bucket and
    different components is pruned or verified; a link that connects nothing
    new is left out, so a group gives no more rows than it has classes.
    """
    clusters = components(left.select("hub", "rep"), "hub", "rep").withColumnsRenamed({"id": "rep", "component": "cluster"})
    items = left.select("rep", "component").distinct().join(clusters, "rep").join(sets, "rep")
    sizes = items.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ITEMS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1))
    dealt = (
        items.join(sizes.select("cluster", blocks.cast("int").alias("blocks")), "cluster")
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cluster",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            *("block", "rep", "component", "set"),
        )
    )
    rows_in_band, bands = settings.bands()
    steps, least = checks(settings)

    def compare(group: pa.Table) -> pa.Table:
        rep, component = np.asarray(group.column("rep")), np.asarray(group.column("component")).copy()
        own = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        n = np.array([len(x) for x in own])
        signature = signatures(np.concatenate(own), np.append(0, np.cumsum(n)), rows_in_band * bands)
        keys = band_keys(signature, rows_in_band, bands)
        block, i, j = (np.asarray(group.column(c)) for c in ("block", "i", "j"))
        left_side, right_side = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # postings: which of the right side's classes have a shingle
        shingle, owner = np.concatenate([own[k] for k in right_side]), np.repeat(right_side, n[right_side])
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        a, b = [], []
        for x in left_side.tolist():
            y = right_side[component[right_side] != component[x]]
            if i[0] == j[0]:
                y = y[y > x]
            y = y[100 * np.minimum(n[y], n[x]) >= settings.percent * np.maximum(n[y], n[x])]
            y = y[(keys[y] == keys[x]).any(axis=1)]
            matches, done = np.zeros(len(y), np.int64), 0
            for upto, m in zip(steps, least, strict=True):
                matches += (signature[y, done:upto] == signature[x, done:upto]).sum(axis=1)
                y, matches, done = y[matches >= m], matches[matches >= m], upto
            if not len(y):
                continue
            begin, end = np.searchsorted(shingle, own[x]), np.searchsorted(shingle, own[x], side="right")
            each = end - begin
            at = np.repeat(begin - np.cumsum(each) + each, each) + np.arange(each.sum())
            both = np.bincount(owner[at], minlength=len(rep))[y]
            for k in y[100 * both >= settings.percent * (n[x] + n[y] - both)].tolist():
                if component[k] != component[x]:  # a link that joins nothing new is left out
                    a.append(int(rep[x]))
                    b.append(int(rep[k]))
                    component[component == component[k]] = component[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first), one row for each row of ``docs`` (doc_id, text).

    ``first`` is true for the rows of one text of each component (its least by
    id and hash), and for rows that are linked with nothing.
    """
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = profiles(docs, settings).checkpoint()
    real = own.filter(F.col("doc_id").isNotNull() & F.col("set_id").isNotNull())
    # rep numbers the classes: the checkpoint holds the numbers, an id may have several.
    # It must be nullable for the plans: Spark fails on the checkpoints of the components if it is not.
    classes = real.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
        F.first("bands").alias("bands"),
    ).withColumn("rep", F.when(F.col("n_shingles") > 0, F.monotonically_increasing_id())).checkpoint()
    found = class_links(classes, docs.filter(F.col("doc_id").isNotNull()), settings).withColumnRenamed("id", "rep").checkpoint()
    least = found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("of_component"))
    of_set = (
        classes.select("set_id", "rep", "least")
        .join(found.join(least, "component").select("rep", "of_component"), "rep", "left")
        .select("set_id", F.coalesce("of_component", "least").alias("of_component"))
    )
    own_text = F.struct("doc_id", "text_hash")
    return own.join(of_set, "set_id", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("of_component.doc_id", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | F.coalesce(F.col("of_component") == own_text, F.lit(True))).alias("first"),
    )


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text)."""
    placed = grouped(docs, settings).select("doc_id", "n_shingles", "component_id")
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
