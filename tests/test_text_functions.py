"""Text scalars against plain Python on small frames."""

import posixpath
import random
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


def test_question_terms(spark):
    assert one(spark, "What is the Security policy of the Security team?", X.question_terms("t")) == ["security", "policy", "team"]
    assert one(spark, "what is it", X.question_terms("t")) == []
    assert one(spark, "Où est le café 中文", X.question_terms("t")) == ["où", "est", "le", "café", "中文"]
    assert len(one(spark, " ".join(f"w{i}" for i in range(30)), X.question_terms("t"))) == 12
    assert one(spark, "alpha beta", X.fts_query("t")) == '"alpha" OR "beta"'


@pytest.mark.parametrize("value,want", [("Hello, World!", "hello-world"), ("  --a--b ", "a-b"), ("éé", "item"), ("", "item")])
def test_slugify(spark, value, want):
    assert one(spark, value, X.slugify("t")) == want


def test_clip_words(spark):
    assert one(spark, "short", X.clip_words("t", 10)) == "short"
    got = one(spark, "alpha beta, gamma delta", X.clip_words("t", 13))
    assert got == "alpha beta…" and one(spark, got, X.clip_words("t", 13)) == got
    assert one(spark, "x" * 20, X.clip_words("t", 10)) == "x" * 9 + "…"


def test_estimate_tokens(spark):
    got = spark.createDataFrame([(0,), (1,), (7,), (9,)], "n int").select(X.estimate_tokens("n").alias("x")).collect()
    assert [r["x"] for r in got] == [0, 1, 1, 2]


def test_links_and_footnotes(spark):
    body = 'See [a](x.md) ![img](y.png) [b](/z.md "title") and [^n1] [^n2].\n\n[^n1]: def'
    assert [(r["text"], r["target"]) for r in one(spark, body, X.links("t"))] == [("a", "x.md"), ("b", "/z.md")]
    assert one(spark, body, X.footnote_references("t")) == ["n1", "n2"] and one(spark, body, X.footnote_definitions("t")) == ["n1"]


@pytest.mark.parametrize("target,source", [("b.md", "a/c.md"), ("../x.md", "a/c.md"), ("../../x.md", "a/c.md"), ("/top.md", "a/b/c.md"), ("./d/../e.md#frag", "c.md"), ("#frag", "c.md"), ("/", "c.md"), ("..", "a/b.md"), ("../..", "a/b.md"), ("x//y.md", "")])
def test_resolve_target(spark, target, source):
    path = target.split("#")[0]
    joined = path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(source), path)
    normal = posixpath.normpath(joined)
    want = None if not path or normal.startswith("..") else normal
    got = spark.createDataFrame([(target, source)], "t string, s string").select(X.resolve_target("t", "s").alias("x")).first()["x"]
    assert got == want


@pytest.mark.parametrize("url,want", [("HTTP://Ex.COM:80", "http://ex.com/"), ("https://a.b:443/P?q=1#f", "https://a.b/P?q=1"), ("https://a.b:8443/", "https://a.b:8443/"), ("not a url", "not a url")])
def test_canonical_url(spark, url, want):
    assert one(spark, url, X.canonical_url("t")) == want


def test_prose(spark):
    assert one(spark, "See [the [inner](a) text](b) now[^1].", X.digest_text("t")) == "See the inner text now."
    assert one(spark, "First one. Second one.", X.first_sentence("t")) == "First one."
    assert one(spark, "[x](y.md) and z[^2]", X.visible_prose("t")) == "x and z"


def test_small_scalars(spark):
    r = one(spark, 'text/HTML; charset="UTF-8"', X.content_type("t"))
    assert (r["media_type"], r["charset"]) == ("text/html", "utf-8")
    r = one(spark, "- rev-0123456789ab — built", X.log_entry("t"))
    assert (r["revision"], r["summary"]) == ("rev-0123456789ab", "built")
    assert one(spark, "u", X.doc_id("t")).startswith("doc-") and one(spark, None, X.question_terms("t")) is None
    assert one(spark, "x", X.title_matches(F.lit(3), F.lit(2))) and not one(spark, "x", X.title_matches(F.lit(2), F.lit(1)))


SEGMENTS = ["a", "b", "..", ".", "", "c d", "x;p=1", "%20", "..."]


def test_resolved_urls_equal_the_standard_library(spark):
    """References of every form against bases with user information, ports, IPv6 literals, queries."""
    r = random.Random(1)

    def path():
        return "/".join(r.choice(SEGMENTS) for _ in range(r.randint(1, 5)))

    def reference():
        p = r.choice(["", "/"]) + (path() if r.random() < 0.9 else "")
        k = r.random()
        if k < 0.6:
            u = p.lstrip("/") if p.startswith("//") else p
        elif k < 0.7:
            u = "//" + r.choice(["h", "U:p@Host:80", "[::1]:8080"]) + ("/" + p if p else "")
        elif k < 0.85:
            u = r.choice(["http:", "mailto:", "HTTP://", "https://Us:Pw@"]) + r.choice(["x", "Host.Example:443/", "[FE80::1]:080/"]) + p
        else:
            u = ""
        return u + r.choice(["", "", "?q=1", "?a/../b"]) + r.choice(["", "", "#f", "#f/x"])

    def canonical(url):
        p = urlsplit(url)
        host = f"[{p.hostname}]" if ":" in (p.hostname or "") else p.hostname or ""
        user = "".join(p.netloc.rpartition("@")[:2])
        port = "" if p.port in (None, {"http": 80, "https": 443}.get(p.scheme)) else f":{p.port}"
        return urlunsplit((p.scheme, user + host + port, p.path or "/", p.query, ""))

    bases = [f"{s}://{h}{p}{q}" for s in ("http", "https") for h in ("Host", "u@h.example:8080", "[::1]") for p in ("", "/", "/a/b", "/a/./b/../c/") for q in ("", "?z=1")]
    rows = [(reference(), r.choice(bases)) for _ in range(10_000)]
    for x in spark.createDataFrame(rows, "u string, b string").select("u", "b", X.canonical_url("u", "b").alias("c")).collect():
        assert x["c"] == canonical(urljoin(x["b"], x["u"])), (x["u"], x["b"])


@pytest.mark.parametrize("value,want", [(" https://U:P@EX.org:443 ", "https://U:P@ex.org/"), ("HTTP://[::A]:81/x#y", "http://[::a]:81/x"), ("plain/path#z", "plain/path"), ("Mailto:A@B", "mailto:A@B"), ("http://h:99/?", "http://h:99/")])
def test_canonical_url_parts(spark, value, want):
    assert one(spark, value, X.canonical_url("t")) == want


def test_a_resolved_url_takes_each_part_once(spark):
    """Inside a lambda Spark computes an expression each time it is named; parts named in parts multiplied to over a hundred patterns a link."""
    df = spark.createDataFrame([(["../x?y#z", "b"], "HTTP://h:80/p/q/")], "hs array<string>, base string")
    found = df.select(F.transform("hs", lambda h: X.canonical_url(h, "base")).alias("x"))
    assert found.first()["x"] == ["http://h/p/x?y", "http://h/p/q/b"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("regexp_replace") < 40
