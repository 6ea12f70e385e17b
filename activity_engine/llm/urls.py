"""URL filters with empirical-Bayes host reputation (operator 8), native.

Page outcomes (good or bad) are counted by host. The bad share of a suffix is
shrunk toward the overall share, that of a registered domain toward its
suffix's, that of a host toward its domain's: each a beta-binomial posterior
whose prior strength is fitted for the level by moments. A host is blocked if
the lower bound of its posterior share is above a limit. Hosts without outcomes
have their domain's, suffix's or the overall share as posterior.

A rule list (bounded: a setting of the job) goes before the method.

``with_documents`` finds the document that a page shows, for outcomes that are
known by document: its id ends the url's path, and its text must open the
article of the page's html (the first OPENING characters other than white
space; the heading is passed over).

Defined cases: a null url, or one without "://", has an empty host and path; a
page with several outcomes counts each; outcomes of unknown pages and null
outcomes count nothing; without any outcome every host is allowed; each page
row gives one row, repeated rows and null ids included; a page whose path ends
in no id, in an unknown one or in that of another or an empty text shows no
document; of several texts under one id any may be the one shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: A host is blocked if its bad share is above LIMIT by BOUND standard deviations of the posterior.
LIMIT = 0.5
BOUND = 1.645
LEVELS = ("suffix", "domain", "host")

#: So many characters of a document's text, white space left out, must open the page.
OPENING = 200
BLANK = "[\\x09-\\x0d\\x20]+"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def named_document(of_path: Column) -> Column:
    """The id that ends a path, before an extension and a slash; else null."""
    return F.regexp_extract(of_path, r"/([0-9]+)(?:\.[A-Za-z0-9]+)?/?$", 1).try_cast("long")


def text_opening(text: Column) -> Column:
    return F.left(F.regexp_replace(text, BLANK, ""), F.lit(OPENING))


def page_opening(html: Column) -> Column:
    """The opening of the article's text after its heading."""
    article = F.regexp_replace(html, "(?s)^.*?<article[^>]*>(?:[\\x09-\\x0d\\x20]*<h1.*?</h1>)?", "")
    shown = F.regexp_replace(article, "(?s)<!--.*?-->|<[^>]*>", "")
    for entity, char in ENTITIES:
        shown = F.replace(shown, F.lit(entity), F.lit(char))
    return text_opening(shown)


def with_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``pages`` (url, html and others) with doc_id, the document (doc_id, text) that each shows, for html."""
    own = pages.select(
        *[c for c in pages.columns if c not in ("html", "doc_id")],
        named_document(path(F.col("url"))).alias("named"),
        page_opening(F.col("html")).alias("opening"),
    )
    texts = documents.select(F.col("doc_id").alias("named"), text_opening(F.col("text")).alias("start"))
    shown = (
        own.select("named", "opening")
        .distinct()
        .join(texts.filter("start != ''").distinct(), "named")
        .filter(F.col("opening").startswith(F.col("start")))
        .select("named", "opening", F.col("named").alias("doc_id"))
        .distinct()
    )
    return own.join(shown, ["named", "opening"], "left").drop("named", "opening")


def fitting_rule(of_host: Column, of_path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of rules as long, the one with the longer host, then block."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])):
        fits = ((of_host == h) | of_host.endswith("." + h)) & of_path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_levels(pages: DataFrame) -> DataFrame:
    return pages.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def reputation(pages: DataFrame, outcomes: DataFrame, by: str = "page_id") -> DataFrame:
    """One row for each host of ``pages`` (``by``, host): share and deviation, the posterior of its bad share.

    ``outcomes`` has ``by`` and bad (boolean).
    """
    labelled = pages.select(by, "host").join(outcomes.filter(F.col("bad").isNotNull()), by, "left")
    hosts = with_levels(
        labelled.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")
        )
    )
    every = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    parent = every.select(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("mean"))
    key: list[str] = []
    for level in LEVELS:
        keys = [x for x in LEVELS[: LEVELS.index(level) + 1]]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        # the parent of a suffix is one row: a join without a key, broadcast
        groups = groups.join(parent, key) if key else groups.join(F.broadcast(parent))
        groups = groups.join(F.broadcast(_strength(groups)))  # one row
        a = F.col("k") + F.col("strength") * F.col("mean")
        b = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("mean"))
        posterior = groups.withColumns({"a": a, "b": b}).withColumn("share", F.col("a") / (F.col("a") + F.col("b")))
        parent, key = posterior.select(*keys, F.col("share").alias("mean")), keys
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return posterior.select("host", "n", "share", deviation.alias("deviation"))


def _strength(groups: DataFrame) -> DataFrame:
    """Prior observations at this level: from the variance of the groups' shares beyond binomial noise."""
    own = F.col("mean") * (1 - F.col("mean"))
    share = F.col("k") / F.col("n")
    seen = groups.filter(F.col("n") > 0)
    fitted = seen.agg(
        F.sum(F.col("n") * (share - F.col("mean")) * (share - F.col("mean"))).alias("spread"),
        F.sum(own).alias("noise"),
        F.sum((F.col("n") - 1) * own).alias("room"),
    )
    rho = F.when(F.col("room") > 0, (F.col("spread") - F.col("noise")) / F.col("room")).otherwise(0.0)
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.999), rho))
    return fitted.select(((1 - rho) / rho).alias("strength"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, bound: float = BOUND, by: str = "page_id"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, share), one row for each row of ``pages`` (page_id, url and ``by``)."""
    more = [by] if by != "page_id" else []
    own = pages.select("page_id", *more, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    known = reputation(own, outcomes, by)
    blocked = F.coalesce(F.col("share") - bound * F.col("deviation") > limit, F.lit(False))
    by_method = F.when(blocked, "block").otherwise("allow")
    return own.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_method).alias("verdict"), "share"
    )
