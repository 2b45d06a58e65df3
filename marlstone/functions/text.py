"""Text scalars as column expressions: terms, slugs, clips, links, footnotes, paths, URLs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without lexical signal in a question.
STOPWORDS = (
    "a about an and are as at be been by can could did do does for from had has have here how i if in into is it its "
    "may me must not of on or our over should so than that the their them then there these they this those to under us "
    "was we were what when where which who whom why will with would you your"
).split()
MAX_QUERY_TERMS = 12
#: Patterns of tokens, Markdown links and footnotes.
TOKEN = r"[\p{L}\p{N}_]+"
LINK = r'(?<!\!)\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
FOOTNOTE_DEF = r"(?m)^\[\^([^\]]+)\]:"
FOOTNOTE_REF = r"\[\^([^\]]+)\](?!:)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trims every Unicode blank at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def tokens(x: Column | str) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(TOKEN), F.lit(0))


def question_terms(x: Column | str, most: int = MAX_QUERY_TERMS) -> Column:
    """The first distinct tokens that are no stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.slice(F.array_distinct(F.filter(tokens(x), lambda t: ~F.array_contains(stop, t))), 1, most)


def fts_query(x: Column | str) -> Column:
    """A safe OR-query over quoted terms."""
    return F.array_join(F.transform(question_terms(x), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def term_occurrences(text: Column | str, terms: Column | str) -> Column:
    """Tokens of the text that are among the terms, repeats included."""
    return F.size(F.filter(tokens(text), lambda t: F.array_contains(col(terms), t)))


def distinct_hits(text: Column | str, terms: Column | str) -> Column:
    """How many of the terms occur in the text."""
    return F.size(F.array_intersect(F.array_distinct(tokens(text)), col(terms)))


def title_shaped(terms: Column | str, title: Column | str) -> Column:
    """Whether every term, of at least one, is in the title."""
    return (F.size(col(terms)) > 0) & (F.size(F.array_except(col(terms), tokens(title))) == 0)


def title_matches(terms: Column, shared: Column) -> Column:
    """Whether all title terms are shared, or all but one of three or more."""
    return (terms > 0) & ((shared == terms) | ((terms >= 3) & (shared >= terms - 1)))


def slugify(x: Column | str, default: str = "item") -> Column:
    """Lower-case letters and digits of the first 128 code points, joined by single hyphens."""
    slug = F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def clip_words(x: Column | str, cap: int) -> Column:
    """At most ``cap`` characters, cut at a blank and marked with an ellipsis; idempotent."""
    x = col(x)
    head = F.substring(x, 1, cap - 1)
    kept = F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" ,;:—-"))
    clipped = F.concat(F.when(kept == "", head).otherwise(kept), F.lit("…"))
    return F.when(F.length(x) <= cap, x).otherwise(clipped)


def estimate_tokens(chars: Column | str) -> Column:
    """A quarter of the characters, at least one unless there are none."""
    chars = col(chars).cast("long")
    return F.when(chars == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(chars / 4)))


def links(body: Column | str) -> Column:
    """``array<struct<text, target>>`` of Markdown links that are no images."""
    body = col(body)
    pair = F.arrays_zip(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(body, F.lit(LINK), F.lit(2)).alias("target"))
    return F.transform(pair, lambda p: F.struct(p["text"].alias("text"), p["target"].alias("target")))


def footnote_definitions(body: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(body), F.lit(FOOTNOTE_DEF), F.lit(1)))


def footnote_references(body: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(body), F.lit(FOOTNOTE_REF), F.lit(1)))


def is_external(target: Column | str) -> Column:
    """A target with a scheme, or a pure fragment."""
    return col(target).rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|#)")


def normalize_path(path: Column) -> Column:
    """POSIX normal form of a relative path: empty and ``.`` parts go, ``..`` takes one part back where there is one."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(out: Column, part: Column) -> Column:
        last = F.element_at(out, -1)
        back = (part == "..") & (F.size(out) > 0) & (F.when(F.size(out) > 0, last).otherwise(F.lit("..")) != "..")
        return F.when(back, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def resolve_target(target: Column | str, from_path: Column | str) -> Column:
    """Root-relative path of a link, or null if it is empty or leaves the root."""
    target = F.substring_index(col(target), "#", 1)
    folder = F.regexp_replace(col(from_path), r"[^/]*$", "")
    path = F.when(target.startswith("/"), F.ltrim(target, F.lit("/"))).otherwise(F.concat(folder, target))
    normal = normalize_path(path)
    return F.when((target != "") & ~normal.startswith("..") & ~(folder.startswith("/") & ~target.startswith("/")), normal)


#: Parts of a URI reference: scheme, authority, path, query; the fragment is left out.
_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _uri(x: Column, k: int) -> Column:
    return F.regexp_extract(x, _REFERENCE, k)


def _dotless(segments: Column) -> Column:
    """The path of segments: ``.`` goes, ``..`` takes one segment back."""
    back = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    step = lambda out, x: F.when(x == "..", back(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    path = F.array_join(F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; inside lambdas Spark would repeat it each time."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _parts(x: Column) -> Column:
    return F.struct(*[_uri(x, k).alias(name) for k, name in enumerate(("scheme", "authority", "path", "query"), 1)])


def resolve_url(url: Column | str, base: Column | str) -> Column:
    """A URI reference against the absolute http or https URL it stands in, without its fragment.

    Blanks around it, tabs and line ends don't count; another scheme's reference stays as it is; an
    empty one is the base; null on either side gives null.
    """
    url = F.regexp_replace(strip(F.regexp_replace(col(url), r"[\t\r\n]", "")), r"#.*$", "")
    return _let(F.struct(url.alias("url"), _parts(col(base)).alias("base")), lambda x: _let(F.lower(_uri(x["url"], 1)), lambda own: _resolved(x["url"], own, x["base"])))


def _resolved(url: Column, own: Column, base: Column) -> Column:
    rest = F.when(own == "", url).otherwise(F.regexp_replace(url, r"^[^:]*:", ""))
    scheme = F.lower(base["scheme"])
    asked = lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))
    here = F.concat(scheme, F.lit("://"), base["authority"])

    def against(x: Column) -> Column:
        """``x``: the reference without its scheme, its path and its query."""
        path, query = x["path"], x["query"]
        segments = F.split(base["path"], "/")
        folder = F.slice(segments, F.lit(1), F.size(segments) - 1)
        inner = lambda all_: F.filter(all_, lambda s, i: (s != "") | (i == 0) | (i == F.size(all_) - 1))  # noqa: E731  # a merged path has no empty segment inside
        merged = _let(F.when(path.startswith("/"), F.split(path, "/")).otherwise(_let(F.concat(folder, F.split(path, "/")), inner)), _dotless)
        return (
            F.when((own != "") & (own != scheme), url)
            .when(x["rest"].startswith("//"), F.concat(scheme, F.lit(":"), x["rest"]))
            .when(path == "", F.concat(here, base["path"], asked(F.when(query == "", base["query"]).otherwise(query))))
            .otherwise(F.concat(here, merged, asked(query)))
        )

    split = lambda rest: F.struct(rest.alias("rest"), *[F.regexp_extract(rest, r"^([^?#]*)(?:\?([^#]*))?", k).alias(name) for k, name in ((1, "path"), (2, "query"))])
    return _let(_let(rest, split), against)


def canonical_url(url: Column | str, base: Column | str | None = None) -> Column:
    """Lower-case scheme and host, no fragment, no default port, ``/`` for an empty path; resolved against ``base``, if given.

    User information stays as it is, an IPv6 literal keeps its brackets.  What has no authority stays
    but for its fragment.
    """
    url = strip(col(url)) if base is None else resolve_url(url, base)
    return _let(F.regexp_replace(url, r"#.*$", ""), lambda url: _let(_parts(url), lambda p: _let(F.lower(p["scheme"]), lambda scheme: _canonical(url, scheme, p))))


def _canonical(url: Column, scheme: Column, parts: Column) -> Column:
    authority = parts["authority"]

    def named(at: Column) -> Column:
        port = F.when((at["port"] == "") | ((scheme == "http") & (at["port"] == "80")) | ((scheme == "https") & (at["port"] == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), at["port"]))
        return F.when(at["host"] == "", authority).otherwise(F.concat(at["user"], F.lower(at["host"]), port))

    at = F.struct(*[F.regexp_extract(authority, r"^(.*@)?(\[[^\]]*\]|[^:]*)(?::0*([0-9]*))?$", k).alias(name) for k, name in ((1, "user"), (2, "host"), (3, "port"))])
    path = F.when(parts["path"] == "", F.lit("/")).otherwise(parts["path"])
    query = F.when(parts["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), parts["query"]))
    bare = F.when(scheme == "", url).otherwise(F.concat(scheme, F.regexp_replace(url, r"^[^:]*", "")))
    return F.when((scheme == "") | (authority == ""), bare).otherwise(F.concat(scheme, F.lit("://"), _let(at, named), path, query))


def visible_prose(x: Column | str) -> Column:
    """Text as read: link text stays, targets and footnote marks go."""
    return F.regexp_replace(F.regexp_replace(col(x), r"\[([^\]]*)\]\(([^)]*)\)", "$1"), r"\[\^[^\]]+\]", "")


def strip_links(x: Column | str, rounds: int = 4) -> Column:
    """Link text instead of links, nested ones too, and no ``](`` left over."""
    once = lambda t: F.regexp_replace(t, r"!?\[([^\[\]]*)\]\(([^()]*)\)", "$1")
    bare = F.regexp_replace(reduce(lambda t, _: once(t), range(rounds), col(x)), r"\]\(", "] (")
    return F.when(col(x).contains("]("), bare).otherwise(col(x))


def digest_text(x: Column | str) -> Column:
    """One line of prose: links and footnotes stripped, blanks collapsed."""
    plain = strip_links(x)
    plain = F.when(col(x).contains("[^"), F.regexp_replace(plain, r"\[\^[^\]]+\]:?", "")).otherwise(plain)
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def first_sentence(x: Column | str, cap: int = 200) -> Column:
    """The first sentence of the prose, clipped."""
    return clip_words(F.get(F.split(digest_text(x), r"(?<=[.!?])\s", 2), F.lit(0)), cap)


def content_type(x: Column | str) -> Column:
    """``struct<media_type, charset>`` of a Content-Type header."""
    x = F.lower(col(x))
    charset = F.regexp_extract(x, r';\s*charset\s*=\s*"?([^\s;"]+)', 1)
    return F.struct(F.trim(F.substring_index(x, ";", 1)).alias("media_type"), F.nullif(charset, F.lit("")).alias("charset"))


def ratio(count: Column, total: Column) -> Column:
    """Share rounded to four places, null for no total."""
    return F.round(F.try_divide(count, total), 4)


def doc_id(uri: Column | str) -> Column:
    """``doc-`` and twelve hexadecimal digits of the URI's SHA-256."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(col(uri), 256), 1, 12))


def content_hash(blocks: Column | str) -> Column:
    """SHA-256 over the blocks' kind, level, language and text; a missing value reads ``None``."""
    sep, none = F.lit("\x01"), F.lit("None")
    row = lambda b: F.concat_ws("\x01", b["kind"], F.coalesce(b["level"].cast("string"), none), F.coalesce(b["language"], none), b["text"])
    return F.sha2(F.array_join(F.transform(col(blocks), row), "\x00"), 256)


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a null character; a null part reads as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def log_entry(line: Column | str) -> Column:
    """``struct<revision, summary>`` of a revision log line, nulls for any other."""
    at = lambda k: F.nullif(F.regexp_extract(col(line), r"^- (rev-[0-9a-f]{12}) — (.*)$", k), F.lit(""))
    return F.struct(at(1).alias("revision"), at(2).alias("summary"))
