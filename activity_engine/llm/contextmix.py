"""Language-model scores by online logistic context mixing (operator 11).

A text is its lower-cased words and one end. Each token is coded in bits: the
frequent training words, the end and an escape are leaves of a Huffman tree, and
a token is the path to its leaf. Several predictors give each bit's probability
from how often it was 0 or 1 at this node in the same context: no context, the
token before, the two before, and the last very frequent token before those
(which tells the language or topic). Contexts are hashed with the node into slots.
The predictions' logits are added with weights that a gate chooses by how much
evidence the slots hold; the weights are learned online, in small batches, by the
gradient of the coding cost. An adaptive map from (depth in the tree, logit) to
the bits seen there refines the sum. A token outside the lexicon costs the escape and
then (c + 1) / (C + V + 1) among those tokens: c is its training count, C and V
their total and number. So known tokens and one class for all unknown ones share
probability one, as in the base score, and the text's is the product.

Work: the counts of all training words are summed in Spark and written once;
what is broadcast (lexicon of ``lexicon`` words at most, ``slots`` slots a context,
64 gates, the map) is bounded by the settings. Words outside the lexicon are
joined with their counts by a shuffle, one row for a document and word, and
summed by document; so what is gathered grows with the corpus. The weights and
the map are fitted on all training documents, each bit without its own share in the
slots it looks at. Tasks fit in parallel, each learner takes ``fit_docs`` rows (a
batch's slice more at most) before the next one begins anew, and the learners'
weights are averaged by how often each gate was used.

Defined cases: a null text is empty and has the end alone. Rows with a null id are
scored but not learned from and not held out. Repeated rows count each. Without
training rows every token is unknown and the base score is 0. Each input row
gives one row with its columns but the text; columns with the new names are
replaced. ``bits_per_byte`` is null for an empty text.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_engine.session import checkpoint_dir

from .words import SPACES, buffer, map_texts, pieces, slices

#: Predictors beside the one without a context: the token before, the two before, the last very frequent one.
CONTEXTS = 3
PREDICTORS = CONTEXTS + 1
#: Levels of evidence in a slot, and the gate's settings: one for each combination of the three contexts' levels.
LEVELS = 4
GATES = LEVELS**CONTEXTS
#: The adaptive map's depths and logit steps.
DEPTHS, STEPS = 16, 49
#: What each slot holds of either bit at first.
PRIOR = 0.4
#: Tokens handled at a time: so few that their bits' arrays stay near the processor, and so many that what they look
#: up in one predictor's table is often near too.
CHUNK = 4096
#: Zeros and ones of how many neighbouring slots are summed in one row.
NEIGHBOURS = 8


class Settings(NamedTuple):
    lexicon: int = 1 << 16
    slots: int = 1 << 18
    topics: int = 256
    fit_docs: int = 8192  # rows for each learner of the weights
    batch: int = 512  # tokens between two steps of the weights
    rate: float = 1.0
    folds: int = 7
    held_out: int = 2


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


# -- counts of the training words ------------------------------------------------
def word_counts(docs: DataFrame, column: str) -> DataFrame:
    """(word, n): occurrences of each word, and of the end as the null word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                each = lowered(part.column(column))[0].value_counts()
                yield pa.RecordBatch.from_arrays([each.field("values").cast(pa.string()), each.field("counts")], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([len(batch)])], names=["word", "n"])

    return docs.select(column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lowered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and the index of each text's first; one more entry at the end."""
    data, offsets = buffer(texts)
    raw = data.tobytes()
    word = np.frombuffer(raw.translate(_WORD), bool)
    begin = offsets[:-1][offsets[:-1] < len(data)]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[begin] = word[begin]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    # a text's last byte ends its last word, though the next text may begin with one
    stop[begin[begin > 0] - 1] = word[begin[begin > 0] - 1]
    starts = np.flatnonzero(start)
    ends = np.cumsum(np.flatnonzero(stop) + 1 - starts)
    return pieces(np.frombuffer(raw.translate(_LOWER, _GAPS), np.uint8), np.append(0, ends)[:-1]), np.searchsorted(starts, offsets)


#: Of each byte: whether it is part of a word, and the lower-case one.
_WORD = bytes((~SPACES).astype(np.uint8))
_LOWER = bytes(x + 32 * (ord("A") <= x <= ord("Z")) for x in range(256))
_GAPS = bytes(np.flatnonzero(SPACES).astype(np.uint8))


class Lexicon(NamedTuple):
    """Frequent words by falling count, then the end and the escape, with their paths in the Huffman tree."""

    words: pa.Array
    log_counts: np.ndarray  # log10(count + 1) of each word, then of the end
    ends: int  # training rows
    first: np.ndarray  # of each symbol's path; one more entry at the end
    steps: np.ndarray  # 2 * node + bit

    @property
    def nodes(self) -> np.ndarray:
        return self.steps >> 1

    @property
    def bits(self) -> np.ndarray:
        return self.steps & 1

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def escape(self) -> int:
        return len(self.words) + 1


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's path from the root: where it begins, and 2 * node + bit of its inner nodes."""
    heap = [(max(n, 1), k) for k, n in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    number = len(counts)
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[b] = (number, 0), (number, 1)
        heapq.heappush(heap, (n + m, number))
        number += 1
    first, steps = [0], []
    for k in range(len(counts)):
        path = []
        while k in up:
            k, bit = up[k]
            path.append(2 * (k - len(counts)) + bit)
        steps += reversed(path)
        first.append(len(steps))
    return np.array(first), np.array(steps, np.int32)


def lexicon(counts: DataFrame, size: int) -> tuple[Lexicon, int, int, int, int]:
    """The words that occur at least 2**j times, with the smallest j that leaves ``size`` of them or fewer; then the
    tokens and distinct tokens of the training rows, and of these those outside the lexicon."""
    level = F.floor(F.log2("n")).cast("int")
    each = counts.groupBy(level.alias("level"), F.col("word").isNull().alias("end")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r.n for r in each), sum(r.v for r in each)
    ends = sum(r.n for r in each if r.end)
    left, least = size, 64
    for r in sorted((r for r in each if not r.end), key=lambda r: -r.level):
        if r.v > left:
            break
        left, least = left - r.v, r.level
    known = counts.filter(F.col("word").isNotNull() & (level >= least)).collect()
    known.sort(key=lambda r: (-r.n, r.word))
    inside = sum(r.n for r in known)
    n = [r.n for r in known]
    tree = huffman([*n, ends, total - ends - inside])
    words = pa.array([r.word for r in known], pa.large_string())
    logs = np.log10(np.array([*n, ends], float) + 1)
    rest = distinct - len(known) - (ends > 0)
    return Lexicon(words, logs, ends, *tree), total, distinct, total - ends - inside, rest


# -- bits and their contexts -------------------------------------------------------
class Tokens(NamedTuple):
    """Symbols of all texts, one after the other, each text's last being the end."""

    symbol: np.ndarray
    text: np.ndarray
    contexts: tuple[np.ndarray, ...]
    before: tuple[np.ndarray, ...] = ()  # what the contexts are hashed from: the token before, the one before that, the topic


_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(words: pa.Array, first: np.ndarray, own: Lexicon, topics: int) -> Tokens:
    found = pc.index_in(words, value_set=own.words) if len(own.words) else pa.nulls(len(words), pa.int32())
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    last = first[1:] + np.arange(len(lengths))
    symbol = np.full(len(text), own.end, np.int64)
    inner = np.ones(len(text), bool)
    inner[last] = False
    symbol[inner] = np.asarray(pc.fill_null(found, own.escape))
    start = last - lengths
    one, two, topic = (np.ones(len(text), np.uint64) for _ in range(CONTEXTS))
    one[1:] = symbol[:-1] + 2
    one[start] = 1
    two[1:] = one[:-1]
    two[start] = 1
    # the last very frequent word at least two tokens before
    seen = np.maximum.accumulate(np.where((symbol < min(topics, own.end)), np.arange(len(text)), -1))
    latest = np.full(len(text), -1)
    latest[2:] = seen[:-2]
    some = np.flatnonzero(latest >= np.repeat(start, lengths + 1))
    topic[some] = symbol[latest[some]] + 2
    return Tokens(symbol, text, (hashed(one), hashed(one, two), hashed(topic)), (one, two, topic))


def hashed(one: np.ndarray, two: np.ndarray | None = None) -> np.ndarray:
    return (one if two is None else one * np.uint64(0x100000001B3) + two) * _ODD


def distinct(some: Tokens, symbols: int) -> list[tuple[Tokens, np.ndarray]]:
    """For each context, its tokens with that context alone, those with the same one together, and how many they are."""
    width = np.uint64((symbols + 2).bit_length())
    if 3 * int(width) > 64:
        return [(Tokens(some.symbol, some.text, (x,)), np.ones(len(some.symbol), np.int64)) for x in some.contexts]
    one, two, topic = some.before
    mask = (np.uint64(1) << width) - np.uint64(1)
    out = []
    for number in (one, one << width | two, topic):
        key = np.sort(number << width | some.symbol.astype(np.uint64))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times, key = np.diff(first, append=len(key)), key[first]
        number = key >> width
        context = hashed(number >> width, number & mask) if len(out) == 1 else hashed(number)
        out.append((Tokens((key & mask).astype(np.int64), first, (context,)), times))
    return out


class Paths(NamedTuple):
    """What is needed of the symbols' paths; what a step's bit and node tell is at its number."""

    first: np.ndarray  # of each symbol's path; one more entry at the end
    steps: np.ndarray  # 2 * node + bit
    row: np.ndarray  # of each step, where its depth begins in the adaptive map
    spread: np.ndarray  # of each step, its node's share in a slot's hash


def folded(h: np.ndarray) -> np.ndarray:
    """Folding goes bit by bit: that of two values' exclusive or is theirs' exclusive or."""
    return h ^ (h >> np.uint64(29))


def paths(own: Lexicon) -> Paths:
    depth = np.arange(len(own.steps)) - np.repeat(own.first[:-1], np.diff(own.first))
    row = np.zeros(2 * (len(own.words) + 2), np.int64)
    row[own.steps] = np.minimum(depth, DEPTHS - 1) * STEPS
    node = np.arange(len(row), dtype=np.uint64) >> np.uint64(1)
    return Paths(own.first, own.steps, row, folded((node + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))


class Bits(NamedTuple):
    first: np.ndarray  # of each token
    step: np.ndarray  # 2 * node + bit
    slots: list[np.ndarray]  # of each predictor with a context


def bits_of(path: Paths, some: Tokens, a: int, slots: int) -> Bits:
    """Bits of the ``CHUNK`` tokens from ``a`` on, or of those left."""
    symbol = some.symbol[a : a + CHUNK]
    start = path.first[symbol]
    n = path.first[symbol + 1] - start
    before = np.cumsum(n) - n
    at = np.repeat(start - before, n)
    at += np.arange(len(at))
    step = path.steps.take(at).astype(np.int64)
    spread = path.spread.take(step)
    shift = np.uint64(64 - (slots.bit_length() - 1))
    places = []
    for context in some.contexts:
        h = np.repeat(folded(context[a : a + CHUNK]), n)
        h ^= spread
        h *= _ODD
        h >>= shift
        places.append(h.view(np.int64))
    return Bits(before, step, places)


def sizes(own: Lexicon, slots: int) -> list[int]:
    return [len(own.words) + 2, *[slots] * CONTEXTS]


def bit_counts(docs: DataFrame, column: str, own, settings: Settings) -> list[np.ndarray]:
    """Zeros and ones seen at each slot of each predictor, over all given rows (slots x 2 each)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*own.value)
        path = paths(lex)
        size = sizes(lex, settings.slots)
        seen = [np.zeros(-(-n // NEIGHBOURS) * 2 * NEIGHBOURS, np.int64) for n in size]
        symbols = np.zeros(len(lex.words) + 2, np.int64)
        for batch in batches:
            for part in slices(batch, column):
                some = tokens(*lowered(part.column(column)), lex, settings.topics)
                symbols += np.bincount(some.symbol, minlength=len(symbols))
                for table, (each, times) in zip(seen[1:], distinct(some, len(symbols)), strict=True):
                    for a in range(0, len(times), CHUNK):
                        bits = bits_of(path, each, a, settings.slots)
                        n = np.repeat(times[a : a + CHUNK], np.diff(bits.first, append=len(bits.step)))
                        np.add.at(table, 2 * bits.slots[0] + (bits.step & 1), n)
        # without a context, a symbol's occurrences all count at the same steps
        np.add.at(seen[0], path.steps, np.repeat(symbols, np.diff(path.first)))
        for k, table in enumerate(seen):
            each = table.reshape(-1, 2 * NEIGHBOURS)
            some = np.flatnonzero(each.any(axis=1))
            arrays = [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), *map(pa.array, each[some].T.copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "block", *names])

    names = [f"n{i}" for i in range(2 * NEIGHBOURS)]
    each = docs.select(column).mapInArrow(count, f"k int, block int, {', '.join(f'{x} long' for x in names)}")
    got = each.groupBy("k", "block").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    k, block = np.asarray(got["k"]), np.asarray(got["block"])
    out = []
    for j, n in enumerate(sizes(Lexicon(*own.value), settings.slots)):
        table = np.zeros((-(-n // NEIGHBOURS), 2 * NEIGHBOURS))
        for i, x in enumerate(names):
            table[block[k == j], i] = np.asarray(got[x])[k == j]
        out.append(table.reshape(-1, 2)[:n])
    return out


# -- mixing ------------------------------------------------------------------------
def level(n: np.ndarray) -> np.ndarray:
    """Evidence in a slot: none, little, some, much."""
    return (n > 0.5).astype(np.int64) + (n > 2.5) + (n > 15.5)


def gate(levels: list[np.ndarray]) -> np.ndarray:
    out = levels[0]
    for x in levels[1:]:
        out = out * LEVELS + x
    return out


def mixed_logit(weights: np.ndarray, chosen: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
    z = weights[PREDICTORS].take(chosen)
    for w, x in zip(weights, logits, strict=False):
        own = w.take(chosen)
        own *= x
        z += own
    return np.clip(z, -12, 12, out=z)


def cell(row: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place in the adaptive map."""
    out = np.rint((z + 12) * ((STEPS - 1) / 24)).astype(np.int64)
    out += row
    return out


def first_weights() -> np.ndarray:
    """One row for each predictor and one for the bias, one column for each gate."""
    return np.vstack([np.full((PREDICTORS, GATES), 0.3), np.zeros((1, GATES))])


def without_own(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logit at each slot for a bit that was counted there, at 2 * slot + bit, and the slot's level, both without that bit."""
    zeros, ones = table[:, 0], table[:, 1]
    logits = np.empty((len(table), 2), np.float32)
    logits[:, 0] = np.log((ones + PRIOR) / (np.maximum(zeros - 1, 0) + PRIOR))
    logits[:, 1] = np.log((np.maximum(ones - 1, 0) + PRIOR) / (zeros + PRIOR))
    return logits.ravel(), level(zeros + ones - 1).astype(np.uint8)


def learned(docs: DataFrame, column: str, own, tables, settings: Settings) -> DataFrame:
    """(kind, place, a, b): kind 0, for each weight, millionths times uses, and uses; kind 1, for each cell of the map, ones and bits."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*own.value)
        path = paths(lex)
        each = [without_own(x) for x in tables.value]
        mark = path.row + DEPTHS * STEPS * (np.arange(len(path.row)) & 1)  # the map's cells of ones behind those of zeros
        gates = np.arange(GATES + 1, dtype=np.uint8)
        weights, visits, cells, rows = first_weights(), np.zeros(GATES, np.int64), np.zeros((DEPTHS * STEPS, 2), np.int64), 0
        for batch in batches:
            for part in slices(batch, column):
                some = tokens(*lowered(part.column(column)), lex, settings.topics)
                for at in range(0, len(some.symbol), CHUNK):
                    bits = bits_of(path, some, at, settings.slots)
                    chosen = gate([x.take(place) for (_, x), place in zip(each[1:], bits.slots, strict=True)])
                    ends = np.append(bits.first[settings.batch :: settings.batch], len(chosen))
                    # each batch's bits gate by gate, so that a gate's sums are over neighbours
                    order = np.concatenate([a + np.argsort(chosen[a:b], kind="stable") for a, b in zip(np.append(0, ends), ends, strict=False)])
                    chosen, step = chosen.take(order), bits.step.take(order)
                    bit = step & 1
                    logits = [each[0][0].take(step), *[x.take(2 * place.take(order) + bit) for (x, _), place in zip(each[1:], bits.slots, strict=True)]]
                    power = (1 + sum(x * x for x in logits)).astype(float)
                    inputs = np.ones((PREDICTORS + 1, len(chosen)))  # the last is the bias's
                    for k, x in enumerate(logits):
                        inputs[k] = x
                    seen, z = bit.astype(float), np.empty(len(chosen))
                    for a, b in zip(np.append(0, ends), ends, strict=False):
                        first = np.searchsorted(chosen[a:b], gates)
                        n = np.diff(first)
                        used = np.flatnonzero(n)
                        first, n = first[used], n[used]
                        xs = inputs[:, a:b]
                        np.clip(np.einsum("kn,kn->n", np.repeat(weights[:, used], n, axis=1), xs), -12, 12, out=z[a:b])
                        wrong = np.exp(-z[a:b])
                        wrong += 1
                        np.subtract(seen[a:b], np.divide(1, wrong, out=wrong), out=wrong)
                        # a step in proportion to the inputs' power, so that it can't overshoot however large the logits are
                        size = settings.rate / ((n + 16) * (1 + np.add.reduceat(power[a:b], first) / n / 4))
                        weights[:, used] += size * np.add.reduceat(xs * wrong, first, axis=1)
                        visits[used] += n
                    cells += np.bincount(cell(mark.take(step), z), minlength=2 * len(cells)).reshape(2, -1).T
                rows += len(part)
                if rows >= settings.fit_docs:
                    yield _sums(weights, visits, cells)
                    weights, visits, cells, rows = first_weights(), np.zeros(GATES, np.int64), np.zeros((DEPTHS * STEPS, 2), np.int64), 0
        yield _sums(weights, visits, cells)

    each = docs.select(column).mapInArrow(learn, "kind int, place int, a long, b long")
    return each.groupBy("kind", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _sums(weights: np.ndarray, visits: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """What one learner gives to the sums of ``learned``."""
    worth = np.minimum(visits, 1 << 16)  # bounded, so that the sum over many tasks fits
    arrays = []
    for k in range(len(weights)):
        arrays.append((np.full(GATES, 0), k * GATES + np.arange(GATES), np.rint(weights[k] * 1e6).astype(np.int64) * worth, worth))
    arrays.append((np.full(len(cells), 1), np.arange(len(cells)), cells[:, 1], cells.sum(axis=1)))
    kind, place, a, b = [np.concatenate(x) for x in zip(*arrays, strict=True)]
    used = b > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(kind[used].astype(np.int32)), pa.array(place[used].astype(np.int32)), pa.array(a[used]), pa.array(b[used])],
        names=["kind", "place", "a", "b"],
    )


def fit(docs: DataFrame, column: str, own, tables, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the adaptive map's refined logits, learned online from the given rows."""
    weights, cells = first_weights(), np.zeros((DEPTHS * STEPS, 2))
    for r in learned(docs, column, own, tables, settings).collect():  # gates and cells: a bounded number
        if r.kind == 0:
            weights[r.place // GATES, r.place % GATES] = r.a / r.b / 1e6
        else:
            cells[r.place] = r.a, r.b
    # a cell with little evidence keeps the logit that leads to it
    centre = np.tile(np.linspace(-12, 12, STEPS), DEPTHS)
    p = 1 / (1 + np.exp(-centre))
    ones, zeros = cells[:, 0] + 16 * p, cells[:, 1] - cells[:, 0] + 16 * (1 - p)
    return weights.astype(np.float32), (np.log(ones / zeros) - centre).astype(np.float32)


class Model(NamedTuple):
    lexicon: tuple
    logits: list[np.ndarray]  # of each predictor's slots
    levels: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray  # what the adaptive map adds to a logit
    settings: Settings


def text_logs(model: Model, lex: Lexicon, some: Tokens, n_texts: int, path: Paths | None = None) -> np.ndarray:
    """Natural logarithm of each text's coded probability (escaped words' own share left out)."""
    total = np.zeros(n_texts)
    path = path or paths(lex)
    free, sign = np.repeat(model.logits[0], 2), np.array([1, -1], model.logits[0].dtype)
    for a in range(0, len(some.symbol), CHUNK):
        bits = bits_of(path, some, a, model.settings.slots)
        chosen = gate([x.take(place) for x, place in zip(model.levels[1:], bits.slots, strict=True)]).astype(np.intp)
        logits = [free.take(bits.step), *[x.take(place) for x, place in zip(model.logits[1:], bits.slots, strict=True)]]
        z = mixed_logit(model.weights, chosen, logits)
        z += 0.5 * model.refined.take(cell(path.row.take(bits.step), z))
        z *= sign.take(bits.step & 1)
        cost = np.exp(z.astype(np.float64))
        cost += 1
        np.log(cost, out=cost)
        # texts ascend, so a chunk's texts are few
        text = some.text[a : a + CHUNK]
        low = int(text[0])
        part = np.bincount(text - low, np.add.reduceat(cost, bits.first))
        total[low : low + len(part)] -= part
    return total


FIELDS = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_PARTS = "text_row long, n_bytes long, n_escaped long, words array<string>, times array<int>"


def coded(docs: DataFrame, column: str, model) -> DataFrame:
    """Each row's sums over its lexicon tokens, and its other words with how often it has them."""
    sums = "n_tokens long, n_known long, base_score double, score double, n_bytes long, n_escaped long"
    fields = T._parse_datatype_string(f"{sums}, words array<string>, times array<int>")
    kept = [f for f in docs.schema if f.name != column]

    ready = []  # in each task, made for its first slice

    def rows(part: pa.RecordBatch) -> dict:
        own = Model(*model.value)
        lex = Lexicon(*own.lexicon)
        if not ready:
            ready.append(paths(lex))
        words, first = lowered(part.column(column))
        some = tokens(words, first, lex, own.settings.topics)
        inside = some.symbol <= lex.end
        logs = np.append(lex.log_counts, 0.0)[some.symbol]
        n = len(part)
        known = np.bincount(some.text, inside & ((some.symbol != lex.end) | (lex.ends > 0)), n)
        escaped = some.symbol == lex.escape
        text = some.text[escaped]
        rare = words.filter(pa.array(escaped[some.symbol != lex.end])).dictionary_encode()
        many = max(1, len(rare.dictionary))
        pair, times = np.unique(text * many + np.asarray(rare.indices), return_counts=True)
        offsets = pa.array(np.searchsorted(pair // many, np.arange(n + 1)), pa.int32())
        names = rare.dictionary.take(pa.array(pair % many)).cast(pa.string())
        return {f.name: part.column(f.name) for f in kept} | {
            "n_tokens": np.diff(first) + 1,
            "n_known": known.astype(np.int64),
            "base_score": np.bincount(some.text, logs, n),
            "score": text_logs(own, lex, some, n, ready[0]) / np.log(10),
            "n_bytes": np.asarray(pc.fill_null(pc.binary_length(part.column(column)), 0)).astype(np.int64),
            "n_escaped": np.bincount(text, minlength=n),
            "words": pa.ListArray.from_arrays(offsets, names),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        }

    return map_texts(docs, column, T.StructType([*kept, *fields]), rows)


def score(docs: DataFrame, column: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Learns from the training folds of ``docs`` and scores every row; adds the columns of ``FIELDS``."""
    spark = docs.sparkSession
    base = f"{checkpoint_dir(spark)}/context-mixing-{uuid.uuid4().hex}"
    held_out = F.coalesce(fold(F.col(key), settings.folds) == settings.held_out, F.lit(False))
    train = docs.filter(F.col(key).isNotNull() & ~held_out).select(key, column)
    word_counts(train, column).write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    own, total, distinct, rest, rest_distinct = lexicon(counts, settings.lexicon)
    shared = spark.sparkContext.broadcast(tuple(own))
    tables = bit_counts(train, column, shared, settings)
    seen = spark.sparkContext.broadcast([x.astype(np.float32) for x in tables])
    weights, refined = fit(train, column, shared, seen, settings)
    logits = [np.log((x[:, 1] + PRIOR) / (x[:, 0] + PRIOR)).astype(np.float32) for x in tables]
    model = Model(tuple(own), logits, [level(x.sum(axis=1)).astype(np.uint8) for x in tables], weights, refined, settings)
    names = {f.name.lower() for f in T._parse_datatype_string(f"{FIELDS}, {_PARTS}")}
    left = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])
    left = left.withColumns({"held_out": held_out, "text_row": F.monotonically_increasing_id()})
    coded(left, column, spark.sparkContext.broadcast(tuple(model))).write.parquet(f"{base}/coded")
    rows = spark.read.parquet(f"{base}/coded")
    # words outside the lexicon: those of the training rows give log10(count + 1) each, others nothing
    pairs = rows.select("text_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("text_row", "x.words", "x.times")
    known = counts.filter("word is not null").select(F.col("word").alias("words"), F.log10(F.col("n") + 1).alias("log_count"))
    sums = pairs.join(known, "words").groupBy("text_row").agg(
        F.sum(F.col("times") * F.col("log_count")).alias("log_sum"), F.sum("times").alias("n_rare")
    )
    both = rows.join(sums, "text_row", "left").withColumn("log_sum", F.coalesce("log_sum", F.lit(0.0)))
    scored = F.col("score") + F.col("log_sum") - F.col("n_escaped") * F.lit(float(np.log10(rest + rest_distinct + 1)))
    return both.select(
        *[f"`{c}`" for c in left.columns if c not in (column, "held_out", "text_row")],
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        scored.alias("score"),
        F.when(F.col("n_bytes") > 0, -scored * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
