"""Cases on which an operator once did less than its whole job."""

from __future__ import annotations

import math

import brute
import duckdb
import pytest

from activity_engine.llm import neardup, queries, urls


def test_two_texts_of_one_id(spark):
    import corpus_pipeline

    def text(name: str, edit: str = "") -> str:
        return " ".join(f"{name}{k}" for k in range(80)) + edit

    # an id's unique text and its copy of another's; a copy that must go and a text beside it that must stay;
    # two alike texts of one id, of which the stage keeps one; texts without words
    rows = [(5, text("p")), (5, text("q")), (2, text("q", " x")), (3, text("a")), (7, text("a")), (7, text("c"))]
    rows += [(9, text("r")), (9, text("r", " x")), (9, text("r")), (11, ""), (11, text("s")), (None, text("p"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    settings = neardup.Settings(5, 80)
    assert sorted(map(repr, map(tuple, neardup.near_duplicates(docs, settings).collect()))) == sorted(
        map(repr, brute.near_rows(rows, 5, 80))
    )
    kept = sorted(map(repr, map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())))
    sure = [(5, text("p")), (2, text("q", " x")), (3, text("a")), (7, text("c")), (11, ""), (11, text("s")), (None, text("p"))]
    assert kept in [sorted(map(repr, [*sure, (9, text("r", x))])) for x in ("", " x")]


def test_outcomes_belong_to_the_page_of_their_document(spark, tmp_path):
    def page(i: int, url: str, text: str) -> tuple:
        body = text.replace("&", "&amp;").replace("<", "&lt;")
        html = f"<html><title>x</title><nav><p>menu</p></nav><article><h1>{body[:9]}</h1>\n<p><b>{body[:8]}<br>{body[8:]}</b></p></article></html>"
        return i, url, html

    texts = [(1000 + i, f"document {i} holds a & b < c\n and more words of its own", "en", "s", 9) for i in range(240)]
    texts += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0)]
    ends = ("", "/", ".html", "?a=/1", "#top")
    # page ids are other documents' ids; the first 40 documents are bad and all on one host
    host = lambda i: "spam.example.org" if i < 40 else f"h{i % 20}.example.org"
    pages = [page(1239 - i, f"http://{host(i)}/de/{1000 + i}{ends[i % 5]}", texts[i][1]) for i in range(240)]
    # pages that show no document: another text, an unknown id, no id, no text, no html
    pages += [page(3000 + i, f"http://other.example.org/de/{1000 + i}", "another text") for i in range(40)]
    pages += [page(4000, "http://other.example.org/de/99", "x"), page(4001, "http://other.example.org/de/", "x"), page(4002, None, "x")]
    pages += [page(4003, "http://other.example.org/de/5000", "x"), page(4004, "http://other.example.org/de/5001", "x")]
    pages += [(4005, "http://other.example.org/de/1000", None), pages[0]]  # and a repeated row
    labels = [(1000 + i, int(i >= 40), 0) for i in range(240)] + [(5000, 0, 1), (5001, 0, 1)]
    for name, rows, schema in (
        ("documents", texts, "doc_id long, text string, lang string, source string, n_chars long"),
        ("pages", pages, "page_id long, url string, html string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    shown = urls.with_documents(spark.read.parquet(f"{tmp_path}/pages.parquet"), spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = {(r.page_id, r.doc_id) for r in shown.collect()}
    assert got == {(1239 - i, 1000 + i) for i in range(240)} | {(p[0], None) for p in pages[240:-1]}
    assert shown.count() == len(pages)
    verdicts = queries.op8_url_reputation(spark, str(tmp_path)).collect()
    assert len(verdicts) == len(pages)
    assert {r.host for r in verdicts if r.verdict == "block"} == {"spam.example.org"}
    assert sum(r.verdict == "block" for r in verdicts) == 41
    # and the SQL blocks the same
    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict"]
    sql = con.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op8_url_reputation']}) x").fetchall()
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r[c] for c in names)) for r in verdicts)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_all_checks_together_miss_rarely(size, percent):
    steps, least = neardup.checks(neardup.Settings(size, percent))
    t, alive, done = percent / 100, {0: 1.0}, 0
    for n, m in zip(steps, least, strict=True):
        new: dict[int, float] = {}
        for x, p in alive.items():
            for k in range(n - done + 1):
                new[x + k] = new.get(x + k, 0.0) + p * math.comb(n - done, k) * t**k * (1 - t) ** (n - done - k)
        alive, done = {x: p for x, p in new.items() if x >= m}, n
    missed = 1 - math.fsum(alive.values())
    print(f"a pair at {t} is pruned with probability {missed:.2e}")
    assert missed <= neardup.MISS
