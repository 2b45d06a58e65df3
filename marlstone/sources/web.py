"""Web sources: address policy, robots and sitemaps, crawling over a fetched-page table, HTML blocks."""

from __future__ import annotations

import ipaddress
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import canonical_url
from marlstone.sources.markdown import ANCHORS, BLOCKS, slug
from marlstone.sources.slices import map_slices

MAX_PAGES, MAX_SITEMAPS = 100, 10
SKIP = frozenset({"script", "style", "noscript", "template", "svg"})


def parse_ip(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """An address literal, also in the old integer, hexadecimal and octal forms; None for a name."""
    host = host.strip("[]").split("%")[0]
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        pass
    parts = host.split(".")
    if not 1 <= len(parts) <= 4 or not all(re.fullmatch(r"0[xX][0-9a-fA-F]*|\d+", p) for p in parts):
        return None
    try:
        values = [int(p, 16) if p[:2].lower() == "0x" else int(p, 8) if p[0] == "0" and len(p) > 1 else int(p) for p in parts]
    except ValueError:
        return None
    *head, last = values
    if any(v > 255 for v in head) or last >= 256 ** (5 - len(parts)):
        return None
    return ipaddress.IPv4Address(sum(v << 8 * (3 - i) for i, v in enumerate(head)) + last)


def blocked_reason(host: str | None) -> str | None:
    """Why an address literal must not be fetched; None if it may, or is a name."""
    ip = parse_ip(host or "")
    if ip is None:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    for reason in ("loopback", "link_local", "multicast", "unspecified", "private", "reserved"):
        if getattr(ip, f"is_{reason}"):
            return reason.replace("_", "-")
    return None if ip.is_global else "non-global"


def url_policy(df: DataFrame, url: str) -> DataFrame:
    """Adds ``blocked``: scheme, credentials, or the reason an address is refused; null if it may be fetched."""

    @F.pandas_udf("string")
    def check(urls: pd.Series) -> pd.Series:
        def one(u: str | None) -> str | None:
            try:
                p = urlsplit(u or "")
                host = p.hostname
            except ValueError:
                return "malformed"
            if p.scheme not in ("http", "https"):
                return "scheme"
            if not host:
                return "malformed"
            if p.username or p.password:
                return "credentials"
            return "loopback" if host == "localhost" or host.endswith(".localhost") else blocked_reason(host)

        return urls.map(one)

    return df.withColumn("blocked", check(url))


def robots(text: str, agent: str = "*") -> tuple[list[tuple[bool, str]], list[str]]:
    """Rules ``(allow, prefix)`` for an agent, and the sitemaps, of a robots.txt."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    maps, names, fresh = [], [], False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [*names, value.lower()] if fresh else [value.lower()]
            fresh = True
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            fresh = False
            for n in names:
                if value:
                    groups[n].append((key == "allow", value))
        elif key == "sitemap" and value:
            maps.append(value)
    return groups.get(agent.lower(), groups.get("*", [])), maps


def allowed(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching prefix decides; allowed if none matches."""
    best = max(((len(p), ok) for ok, p in rules if path.startswith(p)), default=(0, True))
    return best[1]


def sitemap_urls(df: DataFrame, xml: str) -> DataFrame:
    """``(loc)`` of sitemap bodies; one that declares a DTD or entity is refused."""
    safe = df.where(~F.col(xml).rlike(r"(?i)<!(DOCTYPE|ENTITY)"))
    return safe.select(F.explode(F.expr(f"xpath({xml}, \"//*[local-name()='loc']/text()\")")).alias("loc")).select(F.trim("loc").alias("loc"))


def in_scope(url: Column, host: Column) -> Column:
    """Whether a URL is http or https and of the host, whatever its port; case doesn't matter."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:]*)", 1)) == F.lower(host), F.lit(False)) & (host != "")


def crawl(pages: DataFrame, seeds: DataFrame, edges: DataFrame, host: str, limit: int = MAX_PAGES, rounds: int = 20) -> DataFrame:
    """Breadth-first crawl over ``pages(url, html)`` along ``edges(src, dst)``; at most ``limit`` pages of one host.

    Each round is a join of the frontier with the edges and an anti-join with what was seen; the
    frontier never exceeds the page limit.
    """
    known = pages.select(canonical_url("url").alias("url"), "html").dropDuplicates(["url"])
    ours = lambda c: in_scope(c, F.lit(host))
    frontier = seeds.select(canonical_url("url").alias("url")).where(ours(F.col("url"))).distinct()
    seen: list[str] = []
    for _ in range(rounds):
        new = [r["url"] for r in frontier.orderBy("url").limit(limit - len(seen)).collect()]  # bounded by the page limit
        if not new or len(seen) >= limit:
            break
        seen += new
        step = edges.select(canonical_url("src").alias("src"), canonical_url("dst").alias("url")).where(F.col("src").isin(new))
        frontier = step.select("url").where(ours(F.col("url")) & ~F.col("url").isin(seen)).distinct()
    return known.where(F.col("url").isin(seen)).orderBy("url")


class _Blocks(HTMLParser):
    """Headings, paragraphs, cells, lists, code and quotes of a page, its title, heading anchors and links.

    A block is what stands between its start and end tag; one that another start tag cuts off gives
    nothing.  A list is one block of its items; a list inside it starts the items anew.
    """

    PLAIN = {"p": "paragraph", "td": "paragraph", "th": "paragraph", "pre": "code", "blockquote": "quote"} | {f"h{i}": "heading" for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.anchors: list[dict] = []
        self.links: list[dict] = []
        self.title: str | None = None
        self.slugs: set[str] = set()
        self.hidden = 0
        self.head: list[str] | None = None  # parts of an open title
        self.parts: list[str] | None = None  # of an open block
        self.items: list[str] | None = None  # of an open list
        self.link: tuple[str, list[str]] | None = None

    def _taken(self) -> str:
        parts, self.parts = self.parts or [], None
        return "".join(parts)

    def _put(self, kind: str, text: str, level: int | None = None, anchor: str | None = None) -> None:
        if text:
            self.blocks.append({"kind": kind, "text": text, "level": level, "language": None, "anchor_id": anchor})

    def _close_link(self) -> None:
        if self.link:
            self.links.append({"target": self.link[0], "text": one_line("".join(self.link[1]))})
        self.link = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in SKIP
        if self.hidden:
            return
        if tag == "title":
            self.head = []
        elif tag == "a" and dict(attrs).get("href"):
            self._close_link()
            self.link = (dict(attrs)["href"], [])
        elif tag == "br" and self.parts is not None:
            self.parts.append("\n")
        elif tag in ("ul", "ol"):
            self._taken()
            self.items = []
        elif tag in self.PLAIN or (tag == "li" and self.items is not None):
            self.parts = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden or tag in SKIP:
            return
        if tag == "title":
            self.title = self.title or one_line("".join(self.head or [])) or None
            self.head = None
        elif tag == "a":
            self._close_link()
        elif tag == "li":
            text = one_line(self._taken())
            if text and self.items is not None:
                self.items.append(f"- {text}")
        elif tag in ("ul", "ol"):
            self._put("list", "\n".join(self.items or []))
            self.items = None
        elif tag in self.PLAIN:
            raw, kind = self._taken(), self.PLAIN[tag]
            text = raw.strip("\n") if kind == "code" else one_line(raw)
            if kind == "heading" and text:
                name = slug(text, self.slugs)
                self.anchors.append({"id": name, "kind": "heading", "value": text})
                self._put(kind, text, int(tag[1]), name)
            else:
                self._put(kind, text)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.head is not None:
            self.head.append(data)
            return
        for parts in (self.link and self.link[1], self.parts):
            if parts is not None:
                parts.append(data)

    def close(self) -> None:
        super().close()
        self._close_link()


def one_line(text: str) -> str:
    return " ".join(text.split())


def links_of(page: str) -> list[str]:
    """Targets of a page's links, in order."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    return [x["target"] for x in parser.links]


def html_blocks(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``(key, title, blocks, anchors, links)``; the title falls back to the first h1, the URL's stem, then its host."""

    def run(b: dict[str, list]) -> dict[str, list]:
        rows = []
        for k, u, h in zip(b["key"], b["url"], b["html"]):
            p = _Blocks()
            p.feed(h or "")
            p.close()
            parts = urlsplit(u or "")
            stem = re.sub(r"[-_]+", " ", parts.path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip()
            h1 = next((x["text"] for x in p.blocks if x["kind"] == "heading" and x["level"] == 1), "")
            links = [{"target": urljoin(u or "", x["target"]), "text": x["text"]} for x in p.links]
            rows.append((k, p.title or h1 or stem or parts.netloc, p.blocks, p.anchors, links))
        return {c: [r[i] for r in rows] for i, c in enumerate(("key", "title", "blocks", "anchors", "links"))}

    kind = dict(df.dtypes)[key]
    out = map_slices(df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")), run, f"key {kind}, title string, blocks {BLOCKS}, anchors {ANCHORS}, links array<struct<target:string,text:string>>")
    return out.withColumnRenamed("key", key)


def hrefs(html: Column) -> Column:
    """Link targets by pattern, in order; quick, for well-formed attributes."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))
