"""The ten operators against plain versions, on the edge cases that their docstrings define."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from activity_engine.llm import bpe, chat, decontam, langid, neardup, quality, secrets, substring, tokencount, urls
from activity_engine.llm.queries import tokenizer_path
from activity_engine.llm.transducer import Transducer, build, save

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "st", "ra", "vel", "o", "ß", "é")]
_r = random.Random(7)


def prose(n: int) -> str:
    return " ".join(_r.choice(WORDS) for _ in range(n))


PASSAGE, BASE = prose(40), prose(120)
TEXTS = [
    (1, BASE),
    (2, BASE),  # an exact copy
    (3, BASE.replace(WORDS[3], "changed", 1)),  # a near copy
    (4, prose(30) + " " + PASSAGE + "\n" + prose(9)),
    (9, PASSAGE + "\t" + prose(50) + " " + PASSAGE),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (8, "one two"),
    (10, "One  TWO"),
    (None, BASE),
    (11, 'password = "hunter2hunter2" Token:abc secret: token: abcdef99 AKIA' + "A1" * 9 + " " + "0123456789abcdef" * 2),
    (12, "ü\U0001f600 api_key='" + "x" * 40 + "' <|endoftext|> it's 12\u00a0 \u2003 a  b\n\n c<|endoftext|>"),
    (13, "a b " * 4000),  # a long text of repeated words
    (14, "same line here\nsame line here\nother | menu | of | things | here\n" * 5),
    (15, " ".join(f"token=abcdef{i}" for i in range(300))),
    (1, BASE),  # a repeated row
    (16, prose(3000)),
]
ITEMS = [(1, PASSAGE), (2, "one two"), (3, None), (None, BASE), (4, ""), (5, prose(60)), (20, PASSAGE)]


def normal(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "zz", 5, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Words string, ids int, spans string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_secrets_and_ledger(spark, docs, none, tmp_path):
    path = str(tmp_path / "ledger")
    found = secrets.scan(docs, path).select("doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()
    assert normal(found) == normal([(i, brute.secret_row(t)[4]) for i, t in TEXTS])
    n = spark.read.parquet(path).count()
    secrets.update_ledger(docs, path)  # nothing is scanned twice
    assert spark.read.parquet(path).count() == n == 3 * len({t or "" for _, t in TEXTS})
    more = (*secrets.BASE, secrets.Rule("word", "changed", 0, 1))  # a new rule is scanned alone
    again = secrets.scan(docs, path, rules=more).filter(F.exists("spans", lambda s: s["kind"] == "word"))
    assert [r.doc_id for r in again.collect()] == [3]
    assert spark.read.parquet(path).count() == n + n // 3
    assert secrets.scan(none, str(tmp_path / "empty")).count() == 0


def test_redaction(spark, docs, tmp_path):
    found = secrets.scan(docs, str(tmp_path / "ledger"))
    for r in found.select("text", secrets.redacted(F.col("text"), F.col("spans")).alias("out")).collect():
        want, pos = "", 0
        for a, _, b, _ in brute.secret_spans(r.text):
            if a >= pos:
                want += r.text[pos:a] + "[SECRET]"
            pos = max(pos, b)
        assert r.out == (None if r.text is None else want + r.text[pos:])


def test_substring(docs, none):
    got = substring.digest(substring.deduplicate(docs)).collect()
    assert normal(got) == normal(brute.substring_rows(TEXTS))
    assert substring.deduplicate(none).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (3, 30)])
def test_near_duplicates(docs, none, size, percent):
    got = neardup.near_duplicates(docs, neardup.Settings(size, percent)).collect()
    assert normal(got) == normal(brute.near_rows(TEXTS, size, percent))
    assert neardup.near_duplicates(none, neardup.Settings(size, percent)).count() == 0


def test_near_duplicates_near_the_threshold(spark):
    # many edits of one text, most pairs near the threshold, so that the open rest is compared in blocks
    words = prose(80).split()
    texts = []
    for i in range(120):
        own = list(words)
        for k in _r.sample(range(80), 2 + i % 3):
            own[k] = f"edit{i}x{k}"
        texts.append((1000 - i, " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), neardup.Settings(3, 85))
    assert normal(got.collect()) == normal(brute.near_rows(texts, 3, 85))


def test_least_matches():
    assert neardup.least_matches(0.85, 16) <= neardup.least_matches(0.85, 128) <= 0.85 * 128
    rows, bands = neardup.Settings(3, 85).bands()
    assert (1 - 0.85**rows) ** bands <= neardup.MISS


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = bpe.round_trip_digests(docs, path, lexicon=20).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert normal(got.collect()) == normal([(i, *brute.bpe_row(own, t)) for i, t in TEXTS])
    round_trip = bpe.decode(bpe.encode(docs, path), path).select("text", "ids", "decoded").collect()
    assert all(r.decoded == own.decode(r.ids, skip_special_tokens=False) for r in round_trip)
    assert all(r.ids == own.encode(r.text or "", add_special_tokens=False).ids for r in round_trip)
    assert bpe.encode(none, path).count() == 0


def test_transducer(tmp_path):
    words = sorted({w.encode() for w in WORDS} | {b"a", b"ab", b"abc", b"xbc"})
    save(build(words, [[k, k + 1] for k in range(len(words))]), str(tmp_path / "t"))
    t = Transducer(str(tmp_path / "t"))
    asked = [*words, b"", b"zz", b"abcd", b"x"]
    stops = np.cumsum([len(w) for w in asked])
    data = np.frombuffer(b"".join(asked), np.uint8)
    got = t.find(data, stops - [len(w) for w in asked], stops)
    assert got.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(t.first) - 1 < sum(map(len, words))  # suffixes are shared


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = tokencount.count_tokens(docs, path, lexicon=20).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert normal(got.collect()) == normal([(i, *brute.count_row(own, t)) for i, t in TEXTS])
    assert tokencount.count_tokens(none, path).count() == 0


def test_quality(docs, none):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.clean_lines(docs)
    assert normal(got.select("doc_id", *columns).collect()) == normal([(i, *brute.quality_row(t)) for i, t in TEXTS])
    assert got.filter("kept and base_failed").count() == 0
    assert quality.clean_lines(none).count() == 0


def test_quality_lines(spark):
    body = "This is a clean sentence of a page, and it ends here.\n" + prose(60) + "."
    menu = "\n".join(f"home {i} | news | about | contact" for i in range(40))
    rows = [(1, body), (2, body + "\nAll rights reserved\n" + menu[:30]), (3, menu)]
    got = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].cleaned_text == body and got[1].kept
    assert "rights" not in got[2].cleaned_text and got[2].kept and body in got[2].cleaned_text
    assert not got[3].kept


def test_language(spark, docs, none):
    sound = {"aa": "bcdfg", "bb": "lmnpr"}
    rows = [(i, " ".join(_r.choice(sound[x]) + _r.choice("aeiou") for _ in range(30)), x) for i in range(120) for x in [_r.choice("ab") * 2]]
    more = [(500, None, "aa"), (501, "123 !!", "bb"), (502, "ba", None), (None, "da", "bb")]
    got = langid.identify(spark.createDataFrame(rows + more, "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 4 and all(by[i].lang_pred == x for i, _, x in rows)
    assert (by[500].lang_pred, by[501].lang_pred, by[501].score) == ("und", "und", 0.0)
    assert by[502].lang_pred == "aa" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert langid.identify(none.withColumn("lang", F.lit("x"))).count() == 0


def test_language_vectors_and_cosines(spark, monkeypatch):
    """Vectors of texts against n-grams bound and bundled one by one, and the verdicts against plain cosines."""
    import unicodedata

    import pyarrow as pa

    def plain(text: str) -> np.ndarray:
        low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {text} ".lower())
        while "  " in low:
            low = low.replace("  ", " ")
        total = np.zeros(langid.DIMENSIONS)
        for k in range(len(low) - langid.SIZE + 1):
            gram = low[k : k + langid.SIZE]
            if gram.strip():
                points = np.array([0 if c == " " else ord(c) for c in gram])
                bound = np.ones(langid.DIMENSIONS)
                for j, v in enumerate(langid.letter_vectors(points)):
                    bound *= np.roll(v, langid.SIZE - 1 - j)
                total += bound
        return total / (np.linalg.norm(total) or 1)

    texts = [t or "" for _, t in TEXTS if t is None or len(t) < 3000] + ["一二三四 五六七八", "x", "123 !"]
    want = [plain(t) for t in texts]
    for kept, bundled in ((1 << 16, 1 << 13), (3, 5)):  # the second cuts every text's n-grams into pieces
        monkeypatch.setattr(langid, "KEPT_GRAMS", kept)
        monkeypatch.setattr(langid, "BUNDLED", bundled)
        got = dict(langid.text_vectors(langid.padded(pa.array(texts))))
        assert set(got) == {k for k, v in enumerate(want) if v.any()}
        assert all(np.allclose(got[k], want[k], atol=1e-5) for k in got)
    monkeypatch.undo()
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()
    import zlib

    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    proto = {x: sum(want[i] for i in train if "ab"[i % 2] == x) for x in "ab"}
    for r in found:
        cosine = {x: float(p @ want[r.doc_id] / np.linalg.norm(p)) for x, p in proto.items()}
        if not want[r.doc_id].any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert abs(r.score - max(0.0, cosine[r.lang_pred])) < 1e-4 and cosine[r.lang_pred] >= max(cosine.values()) - 1e-4


@pytest.mark.parametrize("block", [3, 50_000])
def test_decontamination(spark, docs, none, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.hits(docs, items, block_windows=block).select("doc_id", "n_words", "n_hit", "items").collect()
    want = brute.benchmark_rows(TEXTS, ITEMS)
    assert normal((r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontam.digest(r["items"])) for r in found) == normal(x[:5] for x in want)
    if block > 3:
        assert decontam.contaminated(docs, items.filter("false")).filter("n_hit > 0 or contaminated").count() == 0
        assert decontam.contaminated(none, items).count() == 0


def test_urls(spark):
    pages = [
        (1, "http://WWW.Example.com/en/x?y=1"), (2, "https://a.example.com/en/"), (3, "x://b.org"), (4, None), (5, "nothing"),
        (6, "http://q.net/es/1#z"), (7, "http://q.net/de/"), (8, "http://c.com?x/"), (9, "http://bad.org/1"), (10, "http://bad.org/2"),
    ]
    outcomes = [(9, True)] * 40 + [(10, True)] * 40 + [(3, False)] * 300 + [(7, None), (99, True)]
    got = urls.judge(
        spark.createDataFrame([*pages, (1, pages[0][1])], "page_id long, url string"),
        spark.createDataFrame(outcomes, "page_id long, bad boolean"),
    ).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == 11
    assert by[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert by[3] == ("b.org", "", None, "allow")
    assert by[4][:3] == by[5][:3] == ("", "", None)
    assert by[6] == ("q.net", "/es/1", "net/es/", "block")
    assert by[8] == ("c.com", "", None, "allow")
    assert by[9] == ("bad.org", "/1", None, "block")


def test_chat(spark):
    rows = [
        (0, 0, "user", "hi"), (1, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 1, "assistant", "bad <|end|>"),
        (1, 1, "assistant", "bad <|end|>"), (0, 2, "user", None), (2, 0, "user", "alone"), (None, 0, "user", "x"),
        (4, 0, "user", "same"), (5, 0, "user", "same"), (4, None, None, "late"),
    ]
    got = chat.preference_turns(chat.paired_by_id(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    by = {(r.pair_id, r.part, r.turn): (r.rendered, r.loss) for r in got.collect()}
    assert by == {
        (0, "prompt", 0): ("<|user|>\nhi<|end|>\n", False),
        (0, "chosen", 1): ("<|assistant|>\ngood<|end|>\n", True),
        (0, "chosen", 2): ("<|user|>\n<|end|>\n", False),
        (0, "rejected", 1): ("<|assistant|>\nbad < |end|><|end|>\n", True),
        (2, "prompt", 0): ("<|user|>\nsame<|end|>\n", False),
        (2, "chosen", None): ("<|unknown|>\nlate<|end|>\n", False),
    }
    pair = {r.pair_id: r for r in chat.assembled(got).collect()}[0]
    assert pair.prompt == "<|user|>\nhi<|end|>\n" and [x.loss for x in pair.chosen] == [True, False]


def test_pairs_by_answer(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "early"), (0, 2, "user", "and?"), (0, 3, "assistant", "good"), (0, 3, "assistant", "good"),
        (0, 4, "user", "late"), (1, 0, "user", "yo"), (1, 1, "assistant", "bad"), (2, 0, "user", "alone"), (None, 0, "assistant", "x"),
        (5, 0, "user", "q"), (5, 1, "assistant", "same"), (6, 0, "assistant", "same"), (6, None, "user", "end"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chosen int")
    got = chat.preference_turns(chat.paired_by_answer(df))
    by = {(r.pair_id, r.part, r.turn): (r.rendered, r.loss) for r in got.collect()}
    user, answer = "<|user|>\n{}<|end|>\n", "<|assistant|>\n{}<|end|>\n"
    assert by == {
        (0, "prompt", 0): (user.format("hi"), False),
        (0, "prompt", 1): (answer.format("early"), False),
        (0, "prompt", 2): (user.format("and?"), False),
        (0, "chosen", 3): (answer.format("good"), True),
        (0, "rejected", 3): (answer.format("bad"), True),
        (5, "prompt", 0): (user.format("q"), False),
        (5, "prompt", 1): (answer.format("same"), False),  # both answers are one: nothing to prefer
    }
    pair = {r.pair_id: r for r in chat.assembled(got).collect()}[0]
    assert pair.prompt == user.format("hi") + answer.format("early") + user.format("and?")
    assert [x.rendered for x in (*pair.chosen, *pair.rejected)] == [answer.format("good"), answer.format("bad")]
    assert chat.preference_turns(chat.paired_by_answer(df.filter("false"))).count() == 0


def masked(text: str) -> str:
    out, pos = "", 0
    for a, _, b, _ in brute.secret_spans(text):
        if a >= pos:
            out += text[pos:a] + "[SECRET]"
        pos = max(pos, b)
    return out + text[pos:]


def test_pipeline_against_a_chain_of_plain_versions(spark, tmp_path):
    """Copies, contaminated texts and texts without letters go, secrets are masked, and every clean row stays."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    item = prose(40)
    rows = [(i, prose(60 + i), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)]  # exact copies
    rows += [(200 + i, rows[10 + i][1] + " extra", "fr") for i in range(5)]  # near copies
    rows += [(300, item + " " + prose(20), "en"), (301, prose(900) + " " + " ".join(item.split()[:13]), "en")]
    rows += [(400, "123 456 !", "en"), (401, None, "en"), (402, "", "fr"), (403, "one two", "fr")]
    rows += [(500, prose(50) + " password = hunter2hunter2 " + "0123456789abcdef" * 2, "en"), (None, prose(70), "en")]
    documents = [(i, t, x, "src", len(t or "")) for i, t, x in rows]
    for name, data, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(1, item), (2, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    left = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    left = [x for x, r in zip(left, brute.near_rows(left, 5, 80), strict=True) if r[3]]
    assert {300, 301} <= {i for i, _ in left} and not {100, 204} & {i for i, _ in left}
    left = [x for x, r in zip(left, brute.benchmark_rows(left, [(1, item)]), strict=True) if not r[5]]
    assert 300 not in {i for i, _ in left} and 301 in {i for i, _ in left}  # a window in a long text is no contamination
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in left:
        ids = own.encode(masked(t), add_special_tokens=False).ids
        want.append((i, len(ids), ids, brute.sha(own.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids", "decoded_sha256").collect()
    assert normal(got) == normal(want) and len(want) == 44


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    sf_dir = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf_dir)
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < out.count() <= before.count()
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, before, sf_dir).schema.names == before.columns
    empty = docs.filter("false").withColumn("lang", F.lit(None).cast("string"))
    assert all(stage(spark, empty, sf_dir).count() == 0 for _, stage in corpus_pipeline.STAGES)
