"""Connectors and the fetch policy over a network made of a dictionary."""

import gzip
import json
import zlib

import pytest

from marlstone.sources import connectors
from marlstone.sources.fetch import Fetcher, FetchError, Policy, Response

HTML = {"Content-Type": "text/html; charset=utf-8"}
NET = {
    "https://s.example/": (200, HTML, b"<title>Home</title><h1>Home</h1><p>Hello.</p><a href='/b.html#x'>b</a><a href='https://other.example/'>o</a><a href='/private/p'>p</a>"),
    "https://s.example/b.html": (200, HTML, b"<h1>B</h1><p>Bee.</p><a href='/'>home</a>"),
    "https://s.example/c": (301, {"Location": "/b.html"}, b""),
    "https://s.example/d.txt": (200, {"Content-Type": "text/plain"}, b"Plain.\n\nText."),
    "https://s.example/img": (200, {"Content-Type": "image/png"}, b"x"),
    "https://s.example/robots.txt": (200, {}, b"User-agent: *\nDisallow: /private\nSitemap: /maps.xml"),
    "https://s.example/maps.xml": (200, {}, b"<sitemapindex xmlns='x'><sitemap><loc>/one.xml</loc></sitemap><sitemap><loc>/evil.xml</loc></sitemap></sitemapindex>"),
    "https://s.example/one.xml": (200, {}, b"<urlset><url><loc>https://s.example/d.txt</loc></url><url><loc>/c</loc></url><url><loc>/img</loc></url></urlset>"),
    "https://s.example/evil.xml": (200, {}, b"<!DOCTYPE x><urlset><url><loc>/never</loc></url></urlset>"),
    "https://s.example/zip": (200, {"Content-Encoding": "gzip"}, gzip.compress(b"z" * 1000)),
    "https://s.example/raw": (200, {"Content-Encoding": "deflate"}, zlib.compress(b"r" * 1000)[2:-4]),
    "https://s.example/in": (302, {"Location": "http://127.0.0.1/"}, b""),
    "https://s.example/loop": (302, {"Location": "/loop"}, b""),
    "https://api.github.com/repos/o/r/commits/HEAD": (200, {}, b'{"sha": "abc"}'),
    "https://api.github.com/repos/o/r/git/trees/abc?recursive=1": (200, {}, json.dumps({"tree": [{"path": p, "type": "blob", "mode": "100644", "size": 5} for p in ("README", "docs/a.md", "src/x.py", ".ci/y.md", "skip/z.md")] + [{"path": "l.md", "type": "blob", "mode": "120000"}]}).encode()),
    "https://raw.githubusercontent.com/o/r/abc/README": (200, {}, b"Read me."),
    "https://raw.githubusercontent.com/o/r/abc/docs/a.md": (200, {}, b"# A\n\nText."),
}
NAMES = {"s.example": ["93.184.216.34"], "other.example": ["93.184.216.35"], "api.github.com": ["93.184.216.36"], "raw.githubusercontent.com": ["93.184.216.37"], "mixed.example": ["93.184.216.34", "10.0.0.1"]}


def make_fetcher(net=NET, names=NAMES):
    def transport(r):
        assert r.address == (names.get(r.host) or [r.host])[0]
        status, headers, body = net.get(f"{r.scheme}://{r.host}{r.target}", (404, {}, b""))
        return Response(status, dict(headers), body)

    return Fetcher(transport, lambda h: names.get(h, []), Policy(per_second=1e9), sleep=lambda s: None)


def fetcher():
    """A fetcher that executors can make for themselves."""
    net, names, policy, kind, answer = dict(NET), dict(NAMES), Policy(per_second=1e9), Fetcher, Response
    return kind(lambda r: answer(*net.get(f"{r.scheme}://{r.host}{r.target}", (404, {}, b""))), lambda h: names.get(h, []), policy)


def test_policy():
    f = make_fetcher()
    assert f.fetch("https://s.example/c")[0] == "https://s.example/b.html"
    assert f.fetch("https://s.example/zip")[1].body == b"z" * 1000 and f.fetch("https://s.example/raw")[1].body == b"r" * 1000
    for url, category in (("ftp://s.example/", "scheme"), ("https://u:p@s.example/", "credentials"), ("http://127.0.0.1/", "loopback"), ("http://2130706433/", "loopback"), ("http://localhost/", "loopback"),
                          ("https://mixed.example/", "private"), ("https://s.example/in", "loopback"), ("https://s.example/loop", "redirect"), ("https://none.example/", "resolve"), ("https://s.example/nope", "status"), ("https:///x", "malformed")):
        with pytest.raises(FetchError) as e:
            f.fetch(url)
        assert e.value.category == category, url
    for policy in (Policy(inflated_bytes=10, per_second=1e9), Policy(item_bytes=10, per_second=1e9)):
        with pytest.raises(FetchError) as e:
            Fetcher(f.transport, f.resolve, policy).fetch("https://s.example/zip")
        assert e.value.category == "size"
    waits, at = [], [0.0]
    slow = Fetcher(f.transport, f.resolve, Policy(), clock=lambda: at[0], sleep=waits.append)
    slow.fetch("https://s.example/"), slow.fetch("https://s.example/d.txt")
    assert waits == [1.0]


def test_web(spark):
    c = connectors.Web(make_fetcher())
    items = c.acquire(spark, "https://s.example")
    assert sorted(r["uri"] for r in items.collect()) == ["https://s.example/", "https://s.example/b.html", "https://s.example/d.txt"]
    docs = {r["uri"]: r for r in c.normalize(items).collect()}
    assert docs["https://s.example/"]["title"] == "Home" and [b["text"] for b in docs["https://s.example/b.html"]["blocks"]] == ["B", "Bee."] and len(docs["https://s.example/d.txt"]["blocks"]) == 2
    cursor = c.checkpoint(items)
    assert cursor["last_uri"] == "https://s.example/d.txt" and c.acquire(spark, "https://s.example", {"last_uri": "https://s.example/"}).count() == 2
    assert c.probe(spark, "https://s.example/nope") == {"supported": False, "reason": "status"} and c.probe(spark, "https://s.example/")["supported"]
    shut = make_fetcher(NET | {"https://s.example/robots.txt": (200, {}, b"User-agent: *\nDisallow: /")})
    with pytest.raises(connectors.ConnectorError):
        connectors.Web(shut).acquire(spark, "https://s.example/")
    assert connectors.Web(make_fetcher(), max_pages=1).acquire(spark, "https://s.example").count() == 1


def test_repository(spark):
    c = connectors.Repository(fetcher, ignore=["skip/"])
    items = c.acquire(spark, "https://github.com/o/r")
    assert {r["uri"]: r["media_type"] for r in items.collect()} == {"https://github.com/o/r/blob/abc/README": "text/plain", "https://github.com/o/r/blob/abc/docs/a.md": "text/markdown"}
    assert {r["title"] for r in c.normalize(items).collect()} == {"README", "A"}
    cursor = c.checkpoint(items)
    assert cursor["sha"] == "abc" and c.acquire(spark, "https://github.com/o/r", cursor).count() == 0
    assert c.probe(spark, "https://github.com/o/r")["items"] == 2 and not c.probe(spark, "https://example.org/o/r")["supported"]


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.bin").write_text("x")
    c = connectors.Files()
    assert c.probe(spark, str(tmp_path)) == {"supported": True, "items": 1} and isinstance(c, connectors.Connector)
    assert [r["uri"] for r in c.acquire(spark, str(tmp_path)).collect()] == ["a.md"]
    assert set(connectors.REGISTRY) == {"files", "web", "repository"}
    with pytest.raises(TypeError):
        connectors.register(type("Half", (), {"id": "half"}))
    with pytest.raises(ValueError):
        connectors.register(type("Other", (connectors.Files,), {}))
