"""The context-mixing model against plain counts, sums to one, and gains on held-out texts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from activity_engine.llm import contextmix as cm
from activity_engine.llm import queries

END = None


def token_lists(rows: list[tuple]) -> list[list]:
    return [[*brute.WORD.findall(brute.lower(t or "")), END] for _, t in rows]


def base_rows(rows: list[tuple]) -> list[tuple]:
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    each = token_lists(rows)
    c = Counter(x for (i, _), h, w in zip(rows, held, each, strict=True) if i is not None and not h for x in w)
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        for (i, _), h, w in zip(rows, held, each, strict=True)
    ]


def texts(n: int = 260) -> list[tuple]:
    r = random.Random(5)
    words = {x: [a + b + x for a in "bdgk" for b in ("a", "or", "ie")] for x in ("", "en", "é")}
    rows = []
    for i in range(n):
        own = words[r.choice(list(words))]
        w = [own[0]]
        for _ in range(r.randrange(2, 60)):
            w.append(own[(own.index(w[-1]) + r.choice((1, 1, 1, 3))) % len(own)])
        rows.append((i, " ".join(w) + r.choice(("", "\n", " Extra" + str(i), " The BORen"))))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "ba bor"), (903, "never seen words"), (5, rows[5][1]), (904, "ba " * 5000)]
    return rows


def near(got, want) -> bool:
    return all(x == y or (isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(got, want, strict=True))


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("settings", [cm.Settings(), cm.Settings(lexicon=9, topics=2, slots=1 << 10, fit_docs=40)])
def test_base_and_gain(spark, settings):
    rows = texts()
    df = spark.createDataFrame([(i, t, "z", 4) for i, t in rows], "doc_id long, text string, SCORE string, extra int").repartition(4)
    got = cm.score(df, settings=settings)
    assert got.columns == ["doc_id", "extra", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    found = got.collect()
    own = by_key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    assert len(own) == len(rows) and all(near(a, b) for a, b in zip(own, by_key(base_rows(rows)), strict=True))
    held = [r for r in found if r.held_out]
    # neighbours tell much in these texts
    assert len(held) > 20 and sum(r.score for r in held) > (0.8 if settings.lexicon > 9 else 0.98) * sum(r.base_score for r in held)
    assert all(r.score < 0 for r in found) and {r.bits_per_byte is None for r in found if r.doc_id in (900, 901)} == {True}
    same = [r.score for r in found if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_texts_of_several_slices(spark):
    rows = [(i, f"Ba {x} " * 500_000) for i, x in enumerate(["bor", "ZIE", "kaé", "bor", "ba"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = cm.score(df, settings=cm.Settings(slots=1 << 12)).collect()
    own = by_key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert all(near(a, b) for a, b in zip(own, by_key(base_rows(rows)), strict=True))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in cm.score(df).collect())
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in got] == [(False, 1, 0, 0, 0.0), (False, 3, 0, 0, 0.0)]
    assert all(x[5] <= 0 for x in got)
    assert cm.score(df.filter("false")).count() == 0


def test_counts_of_bits(spark):
    """The slots hold, for each predictor, what plain counting by (context, node) gives."""
    rows = [x for x in texts(60) if x[0] is not None]
    settings = cm.Settings(lexicon=12, topics=3, slots=1 << 22)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lex, total, distinct, rest, rest_distinct = cm.lexicon(cm.word_counts(df, "text"), settings.lexicon)
    each = token_lists(rows)
    c = Counter(x for w in each for x in w)
    known = lex.words.to_pylist()
    assert (total, distinct) == (sum(c.values()), len(c)) and 0 < len(known) <= 12
    assert rest == sum(n for x, n in c.items() if x is not END and x not in known)
    assert rest_distinct == len(c) - 1 - len(known)
    # a prefix code: no path is another's beginning, and the shares of all leaves make one
    paths = [tuple(zip(lex.nodes[a:b].tolist(), lex.bits[a:b].tolist(), strict=True)) for a, b in zip(lex.first, lex.first[1:], strict=False)]
    assert len(set(paths)) == len(known) + 2 and math.isclose(sum(2.0 ** -len(p) for p in paths), 1)
    want = [Counter() for _ in range(cm.PREDICTORS)]
    for w in each:
        s = [lex.end if x is END else known.index(x) if x in known else lex.escape for x in w]
        for k, x in enumerate(s):
            one, two = (s[k - 1] if k else -1), (s[k - 2] if k > 1 else -1)
            topic = next((y for y in reversed(s[: max(0, k - 1)]) if y < 3), -1)
            for j, context in enumerate(((), (one,), (one, two), (topic,))):
                for node, bit in paths[x]:
                    want[j][context, node, bit] += 1
    tables = cm.bit_counts(df, "text", spark.sparkContext.broadcast(tuple(lex)), settings)
    for table, counted in zip(tables, want, strict=True):
        pairs = Counter((counted[x, n, 0], counted[x, n, 1]) for x, n in {(x, n) for x, n, _ in counted})
        assert Counter(map(tuple, table[table.any(axis=1)].astype(int).tolist())) == pairs


def test_equal_tokens_in_equal_contexts_are_counted_at_once(spark):
    """However often a pair stands in a slice, its bits are hashed once for a context, with its number."""
    rows = [x for x in texts(60) if x[0] is not None]
    lex = cm.lexicon(cm.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text"), 12)[0]
    some = cm.tokens(*cm.lowered(pa.array([t for _, t in rows])), lex, 3)
    n = len(lex.words) + 2
    want = [Counter(zip(some.symbol.tolist(), x.tolist(), strict=True)) for x in some.contexts]
    for (each, times), counted in zip(cm.distinct(some, n), want, strict=True):
        found = zip(each.symbol.tolist(), each.contexts[0].tolist(), times.tolist(), strict=True)
        assert sorted(found) == sorted((*x, k) for x, k in counted.items())
        assert len(times) < len(some.symbol) / 4
    # more symbols than three of which fit 64 bits: each token alone
    for (each, times), counted in zip(cm.distinct(some, 1 << 22), want, strict=True):
        assert Counter(zip(each.symbol.tolist(), each.contexts[0].tolist(), strict=True)) == counted and times.tolist() == [1] * len(some.symbol)


def test_words_of_a_batch():
    rows = ["", None, " A b", "b ", "C", "\t\n", "É\x0b\x0cé x\x1fY", "w" * 70000, "a", ""]
    for part in (pa.array(rows), pa.array(rows).slice(2, 5), pa.array(["", None]), pa.array(["Z"])):
        words, first = cm.lowered(part)
        want = [brute.WORD.findall(brute.lower(t or "")) for t in part.to_pylist()]
        assert words.to_pylist() == [x for w in want for x in w]
        assert np.diff(first).tolist() == [len(w) for w in want] and first[0] == 0


def test_the_weights_are_learned_from_all_training_rows(spark, monkeypatch):
    """Also where there are many more of them than one learner takes."""
    rows = texts()
    settings = cm.Settings(lexicon=12, topics=3, slots=1 << 12, fit_docs=7)
    seen, fit = [], cm.fit

    def noted(docs, column, own, tables, settings):
        lex = cm.Lexicon(*own.value)
        known = lex.words.to_pylist()
        depth = lex.first[1:] - lex.first[:-1]
        each = token_lists([(r.doc_id, r.text) for r in docs.collect()])
        bits = sum(int(depth[lex.end if x is END else known.index(x) if x in known else lex.escape]) for w in each for x in w)
        used = cm.learned(docs, column, own, tables, settings).groupBy("kind").agg(F.sum("b").alias("b")).collect()
        seen.append((len(each), bits, {r.kind: r.b for r in used}))
        return fit(docs, column, own, tables, settings)

    monkeypatch.setattr(cm, "fit", noted)
    cm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), settings=settings).count()
    (n, bits, used), = seen
    assert n == sum(i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    # each bit is in the map once, and in one gate with its weights and bias
    assert used == {0: bits * (cm.PREDICTORS + 1), 1: bits}


def test_a_bit_is_judged_without_its_own_share():
    logits, levels = cm.without_own(np.array([[0.0, 0.0], [1, 0], [3, 2], [0, 20]], np.float32))
    p = cm.PRIOR
    want = {2: 0.0, 4: math.log((2 + p) / (2 + p)), 5: math.log((1 + p) / (3 + p)), 7: math.log((19 + p) / p)}
    assert all(math.isclose(logits[k], x, rel_tol=1e-6, abs_tol=1e-6) for k, x in want.items()) and np.isfinite(logits).all()
    assert levels.tolist() == [0, 0, 2, 3]


def test_choices_sum_to_one(spark):
    """After any beginning, the probabilities of all next tokens make one."""
    rows = texts(80)
    r = np.random.default_rng(2)
    settings = cm.Settings(lexicon=20, topics=4, slots=1 << 8)
    lex = cm.lexicon(cm.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text"), 20)[0]
    sizes = cm.sizes(lex, settings.slots)
    model = cm.Model(
        tuple(lex), [r.normal(0, 2, n) for n in sizes], [r.integers(0, 4, n) for n in sizes],
        r.normal(0.3, 0.2, (cm.PREDICTORS + 1, cm.GATES)), r.normal(0, 0.3, cm.DEPTHS * cm.STEPS), settings,
    )
    n = len(lex.words) + 2
    some = cm.Tokens(np.arange(n), np.arange(n), tuple(np.full(n, x, np.uint64) for x in (12345, 1 << 60, 77)))
    assert math.isclose(np.exp(cm.text_logs(model, lex, some, n)).sum(), 1, rel_tol=1e-9)


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_context_mixing(spark, sf_dir)
    own = by_key(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    assert all(near(a, b) for a, b in zip(own, by_key(base_rows(rows)), strict=True)) and len(own) == len(rows)
    sums = got.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums.s > sums.b
