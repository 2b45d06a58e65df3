"""WARC packages, HTML extraction, quality rules, fingerprints, toxicity, pipeline."""

import hashlib
import io
import os
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import fingerprints, html_extract, quality, toxicity, warc

TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x " * 3000, "line\nline\n\nother\n \nline", "# $5 * & <b> | %", "naïve 中文 🙂 ²", "a b c d a b c e b c d", "\x0b\x0c"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, h int")


# -- WARC ---------------------------------------------------------------------------------------

def test_round_trip_and_revisits(spark):
    rows = [(5, "http://a/\n", "x" * 200), (3, None, "x" * 200), (9, "u", "y"), (10, "u", "y"), (11, "u", None), (12, "", ""), (None, "u", "é" * 300)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if k == 5} == {5: ("revisit", 3)}
    assert all(r["record_type"] == "response" and r["refers_to"] is None for k, r in got.items() if k != 5)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_equal_pages_many(spark):
    rows = [(i, "u", "same " * 50 if i % 3 == 0 else f"page {i} " * 30) for i in range(3000)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3000 and sum(r["record_type"] == "revisit" for r in got) == 999 and {r["refers_to"] for r in got} == {None, 0}


def zip64_package(members):
    """A ZIP whose sizes and offsets all stand in ZIP64 fields, written by hand."""
    import struct
    import zlib

    out, central = io.BytesIO(), b""
    for name, data in members:
        at, n = out.tell(), name.encode()
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data)
        extra = struct.pack("<HHHBB", 0xCAFE, 2, 0, 0, 0)[:6] + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra
    start = out.tell()
    out.write(central)
    end64 = out.tell()
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(central), start))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, end64, 1) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return out.getvalue()


def test_zip64_directory():
    data = zip64_package([("a", b"first"), (warc.DATA, b"0123456789")])
    assert zipfile.ZipFile(io.BytesIO(data)).read("a") == b"first"
    p = warc.Package(io.BytesIO(data), len(data))
    assert p.range("a", 1, 3) == b"irs" and p.range(warc.DATA, 9, 1) == b"9"
    with pytest.raises(ValueError):
        p.range(warc.DATA, 9, 2)


def test_damaged_packages_are_errors():
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"not a zip"), 9)
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.describe(data.replace(b"payload", b"paYload", 1) if data.count(b"payload") == 1 else data.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload"))
    with pytest.raises(ValueError):
        warc.parse_record(data[:-20])


def test_compressed_members_are_not_range_readable():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
        z.writestr("stored", "abc", zipfile.ZIP_STORED)
        z.comment = b"a comment PK\x05"
    p = warc.Package(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert list(p.members) == ["stored"] and p.range("stored", 0, 3) == b"abc"


# -- HTML ---------------------------------------------------------------------------------------

def test_parse_mends_markup():
    tree, blocks = html_extract.parse("<html><body><p><b>One.<br><p>Two &amp; a<b>b</b><ul><li>x<li>y</ul></p><script>var a='</p>'</script><!-- c --><td>z")
    assert [t for _, t, _ in blocks] == ["One.", "Two & ab", "x", "y", "z"]
    assert tree == "#(html(body(p,ul(li),td)))"
    assert html_extract.parse(None) == ("#", []) and html_extract.parse("  \n ") == ("#", [])
    deep = html_extract.parse("<div>" * 5000 + "end")
    assert [t for _, t, _ in deep[1]] == ["end"]
    assert html_extract.parse("<p>a<script>never closed <p>b")[1] == [(1, "a", False)]


def brute_match(a, b):
    """Largest order-keeping match by trying every choice."""
    if a[0] != b[0]:
        return 0

    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + brute_match(a[1][i], b[1][j]))

    return 1 + best(0, 0)


def random_tree(rnd, depth=3):
    return rnd.choice("abc"), [random_tree(rnd, depth - 1) for _ in range(rnd.randrange(4))] if depth else []


def test_simple_tree_matching_matches_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("r", [random_tree(rnd, 2) for _ in range(3)]), ("r", [random_tree(rnd, 2) for _ in range(3)])
        assert html_extract.match(a, b)[0] == brute_match(a, b)


def test_merge_and_place():
    read, write = html_extract.read_tree, html_extract.write_tree
    a, b = read("#(html(nav(ul(li)),article(h1,p),footer))"), read("#(html(div.ad,article(p,h2),aside))")
    w = html_extract.merge(a, b)
    for t in (a, b):
        at = html_extract.place(t, w)
        assert len(at) == len(set(at)) == write(t).count(",") + write(t).count("(") + 1 and -1 not in at
    assert read(write(w)) == w
    labels, parents = html_extract.flatten(w)
    keep = html_extract.main_nodes(labels, parents, *[[float(x in ("p", "h1", "h2", "li", "div.ad", "aside", "footer")) * k for x in labels] for k in (50, 60, 0, 60, 1)])
    kept = {x for x, k in zip(labels, keep) if k}
    assert {"article", "p", "h1", "h2"} == kept


def test_fold_keeps_containers_apart():
    tree, blocks = html_extract.parse("<ul><li>a<li>b</ul><div><p>c<p>d</div><div><p>e</div><div><p>f</div><div><p>g</div>")
    assert tree == "#(ul(li),div(p),div(p),div(p))"
    assert [n for n, _, _ in blocks] == [2, 2, 4, 4, 6, 8, 8]


def page(i, body):
    return f"<html><body><nav><a href='/{i}'>menu {i}</a></nav><header>Site</header><div class='cookie-notice'>We use cookies {i}</div>{body}<footer>(c)</footer></body></html>"


def texts_of(spark, pages):
    rows = [(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(rows)))
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_extract(spark):
    pages = [(i, f"http://h.example/{i}", page(i, f"<article><h1>Title {i}</h1><p>Text  {i} &lt;x&gt;</p><p>Share this</p><form>f</form><section class='comments'><p>nice {i}</p></section></article>")) for i in range(12)]
    pages += [(100, "http://g.example/", page(1, "<div id='content'><p>Only text</p><p><a href='x'>only a link</a></p></div>")), (101, None, None), (102, "nonsense", ""), (103, "http://h.example/z", "<p>bare")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i in range(12):
        assert got[i]["text"] == f"Title {i}\nText {i} <x>" and got[i]["n_chars"] == len(got[i]["text"])
    # a paragraph that is one link is text of the article like the others
    assert got[100]["text"] == "Only text\nonly a link" and got[101]["text"] == got[102]["text"] == "" and got[103]["text"] == "bare"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WORDS = "river stone market winter letter garden engine copper harbour signal meadow lantern".split()


def prose(seed, n=40):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_near_copies_prove_nothing(spark):
    """Pages of a host that share their article but for a line keep it whole, however many there are."""
    body = "".join(f"<p>{prose(k)}</p>" for k in range(6))
    near = lambda host, n: [(host, page(i, f"<article><h1>A shared heading</h1>{body}<p>Edition number {chr(97 + i)}.</p></article>")) for i in range(n)]
    got = texts_of(spark, near("a.example", 12) + near("b.example", 7))
    for i, text in enumerate(got):
        lines = text.split("\n")
        assert lines[0] == "A shared heading" and lines[1:7] == [prose(k) for k in range(6)] and len(lines) == 8, i


def unlabelled(host, i, comments):
    talk = "".join(f"<div><p>{prose((i, k, 'c').__hash__(), 12)}</p></div>" for k in range(comments))
    return host, (
        f"<body><div><ul><li><a href=/a>Home {i}</a><li><a href=/b>About</a></ul></div><div>Cookies help us. We keep some of them for a long time to serve you.</div>"
        f"<div><h1>Heading {i}</h1><p>{prose(i)}</p><p><a href='/x'>{prose(i + 500, 9)}</a></p><p>Get our letter each week, free of charge.</p><p>{prose(i + 900)}</p></div>{talk}<div>All rights are ours.</div></body>"
    )


def test_unlabelled_layout(spark):
    """Plain divs: what varies and carries the text is the article; comments, notices, constant lines go."""
    pages = [unlabelled("u.example", i, i % 3) for i in range(9)]
    for i, text in enumerate(texts_of(spark, pages)):
        assert text == f"Heading {i}\n{prose(i)}\n{prose(i + 500, 9)}\n{prose(i + 900)}", i


def test_the_wrapper_decides(spark):
    """The same pages, each on a host of its own, keep the line that only the host shows to be template."""
    alone = texts_of(spark, [unlabelled(f"u{i}.example", i, 1) for i in range(4)])
    assert all("Get our letter each week, free of charge." in t for t in alone)


def test_two_layouts_of_a_host(spark):
    pages = [("l.example", f"<body><div class='top'>Daily</div><article><h1>H {i}</h1><p>{prose(i)}</p><p>Write to the desk with your own news.</p></article></body>") for i in range(6)]
    pages += [("l.example", f"<body><div class='top'>Daily</div><div class='story'><h1>S {i}</h1><p>{prose(i + 50)}</p></div></body>") for i in range(20)]
    got = texts_of(spark, pages)
    assert got[:6] == [f"H {i}\n{prose(i)}" for i in range(6)]
    assert got[6:] == [f"S {i}\n{prose(i + 50)}" for i in range(20)]


def test_deep_parts_keep_their_role(spark):
    deep = "<div>" * 400
    html = f"<body><article><h1>Top</h1><p>{prose(1)}</p>{deep}<nav><ul><li>menu one<li>menu two</ul></nav><div class='comments'><div><p>I say so</p></div></div><p>{prose(2)}</p></article></body>"
    assert texts_of(spark, [("d.example", html)]) == [f"Top\n{prose(1)}\n{prose(2)}"]


def test_parts_of_an_article_stay_together(spark):
    halves = f"<body><div><h1>T</h1></div><div><div><p>{prose(5)}</p></div><div><p>{prose(6)}</p></div></div></body>"
    headed = "<body><div><ul><li><a href=/>Home</a></ul></div><div><h1>T</h1>" + "".join(f"<div><h2>Part {k}</h2><p>{prose(k, 20 * k)}</p></div>" for k in (1, 2, 6)) + "</div></body>"
    got = texts_of(spark, [("q.example", halves), ("r.example", headed)])
    assert set(prose(5).splitlines() + prose(6).splitlines()) <= set(got[0].splitlines())
    assert got[1] == "\n".join(["T", *(f"Part {k}\n{prose(k, 20 * k)}" for k in (1, 2, 6))])


def test_no_part_of_an_article_is_left_out(spark):
    """However the article is dealt into plain containers, alone on a host or ten to a host, nested once or twice."""
    q = lambda k, n=60: prose(k, n)
    p = lambda k, n=60: f"<p>{q(k, n)}</p>"
    layouts = {
        "even": lambda i: (f"<div><div>{p(i)}</div><div>{p(i + 50)}</div></div>", [q(i), q(i + 50)]),
        "uneven": lambda i: (f"<div><div>{p(i, 50)}</div><div>{p(i + 50, 80)}</div></div>", [q(i, 50), q(i + 50, 80)]),
        "main": lambda i: (f"<main><div class=a>{p(i, 90)}</div><div class=b>{p(i + 50)}</div></main>", [q(i, 90), q(i + 50)]),
        "nested": lambda i: (f"<div><div><div>{p(i, 30)}</div><div>{p(i + 20)}</div></div><div><div>{p(i + 50)}{p(i + 70)}</div></div></div>", [q(i, 30), *map(q, (i + 20, i + 50, i + 70))]),
        "three": lambda i: (f"<div><div>{p(i, 20)}</div><div>{p(i + 50, 150)}</div><div>{p(i + 70, 40)}</div></div>", [q(i, 20), q(i + 50, 150), q(i + 70, 40)]),
        "headed": lambda i: (f"<div><h1>H{i}</h1><div><h2>A{i}</h2>{p(i, 30)}</div><div><h2>B{i}</h2>{p(i + 50, 90)}</div></div>", [f"H{i}", f"A{i}", q(i, 30), f"B{i}", q(i + 50, 90)]),
    }
    menu = "<div><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></div>"
    pages, want = [], []
    for name, make in layouts.items():
        for i in range(10):
            body, parts = make(1000 * len(pages) + i)
            for host in (f"{name}.example", f"{name}{i}.example"):
                pages.append((host, f"<body>{menu}{body}</body>")), want.append("\n".join(parts))
    assert texts_of(spark, pages) == want


def test_very_long_blocks(spark):
    long = "word " * 40_000
    assert texts_of(spark, [("v.example", f"<article><p>{long}</p><p>b</p></article>")]) == [f"{long.strip()}\nb"]


def test_class_words_yield_to_weight(spark):
    """A class word on the element that holds the text is a name of the layout, not of a part to drop."""
    html = f"<body class='has-sidebar'><div class='sidebar content'><h1>T</h1><p>{prose(3)}</p></div><div class='sidebar'><p>{prose(4, 8)}</p></div></body>"
    assert texts_of(spark, [("w.example", html)]) == [f"T\n{prose(3)}"]


# -- quality ------------------------------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cover = Counter(tri), set()
    for i, x in enumerate(tri):
        if c[x] > 1:
            cover |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed


def test_base_counts(spark):
    rnd = random.Random(7)
    texts = [*TEXTS, *(" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(120))) for _ in range(60)), *("\n".join(rnd.choice(("x y", "", "z #")) for _ in range(rnd.randrange(30))) for _ in range(20))]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.assess(frame(spark, texts), labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality.assess(frame(spark, texts).limit(0), labels).count() == 0


def test_cut_hashes_fall_back_to_full_ones(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE", 62)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(90)) for _ in range(30)]
    got = quality.assess(frame(spark, texts), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r["n_repeat_words"] == brute_counts(texts[r["doc_id"]])[4] for r in got)


def test_ratio_tells_junk_from_trusted(spark):
    rnd = random.Random(9)
    good = [" ".join(rnd.choice(("the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "far", "away", "home")) + rnd.choice(("", "s")) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(rnd.choice(("buy", "now", "!!!", "$$$", "click", "win", "prize", "cash", "free")) + rnd.choice(("%%", "**", "##")) for _ in range(80)) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.assess(frame(spark, good + bad), labels).collect()}
    assert sum(got[i]["kept"] for i in range(300) if not got[i]["base_failed"]) >= 0.97 * sum(not got[i]["base_failed"] for i in range(300))
    assert not any(got[i]["kept"] for i in range(300, 360))


# -- fingerprints -------------------------------------------------------------------------------

def test_edits_and_neighbours(spark):
    texts = [t for t in TEXTS] * 3 + [f"document {i} " * (i % 7) for i in range(1200)]
    rows = [(i * 7 - 500, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + (after[1] or "")[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i]["n1"], got[i]["n2"]) == (got[after[0]]["fp1"], got[after[0]]["fp2"])
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", (got[i]["fp1"], got[i]["fp2"])) == (got[i]["fp1"], got[i]["fp2"])


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, None), (7, "q")]
    assert fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
    assert fingerprints.compare(spark.createDataFrame([(4, "alone here")], "doc_id long, text string")).count() == 1
    assert fingerprints.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_radius_search_is_exact(spark, radius):
    rnd = random.Random(radius)
    centres = [rnd.getrandbits(128) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(128), rnd.randrange(8))) for c in centres for _ in range(10)} | set(centres)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(f >> 64), signed(f & (1 << 64) - 1)) for f in fps]
    index = spark.createDataFrame(rows, "fp1 long, fp2 long")
    asked = spark.createDataFrame([(signed(c >> 64), signed(c & (1 << 64) - 1)) for c in centres], "fp1 long, fp2 long")
    got = Counter((r["q1"], r["q2"]) for r in fingerprints.within_radius(asked, index, radius).collect())
    assert got == {(signed(c >> 64), signed(c & (1 << 64) - 1)): sum((c ^ f).bit_count() <= radius for f in fps) for c in centres}


# -- toxicity -----------------------------------------------------------------------------------

def toxic_table(spark, n=600):
    rnd = random.Random(11)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 60))]
        toxic, poor = i % 6 == 0, i % 5 == 0
        if toxic:
            words[3] = rnd.choice(("nastyone", "nastytwo", "vileword"))
        if poor:
            words.append("@@@")
        rows.append((i, " ".join(words)))
        labels.append((i, int(poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int"), labels


def test_chain_learns_and_spares(spark):
    docs, labels, truth = toxic_table(spark)
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 1"), ["low_quality", "toxic"])
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    held = [x for x in truth if x[0] % 4 == 1]
    assert all(got[i]["rejected"] == bool(t) for i, _, t in held)
    assert all(len(r["probabilities"]) == 2 and all(0 <= p <= 1 for p in r["probabilities"]) for r in got.values())


def test_later_models_see_out_of_fold_probabilities():
    chain = toxicity.Chain(["a", "b"], [["x"], []])
    x = np.array([0, 1] * 50)
    chain.fit([[0] if v else [] for v in x], np.column_stack((x, x)), np.arange(100) % toxicity.FOLDS)
    assert chain.models[1].v[0] > 1 and (chain.predict(["x", "y"])[:, 1] > 0.5).tolist() == [True, False]


def test_toxicity_edges(spark):
    docs, labels, _ = toxic_table(spark, 60)
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    got = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "nastyone " * 20000)], "doc_id long, text string"), chain).collect()
    assert len(got) == 4 and not any(r["rejected"] for r in got[:3])
    none = toxicity.train(docs, labels.limit(0), ["low_quality", "toxic"])
    assert not any(r["rejected"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def brute_chain(texts, labels):
    """The chain fitted on a dense table, term by term and row by row: probabilities of the rows, and thresholds."""
    import xxhash

    def features(text):
        words = set(re.findall(r"\w+|[^\w\s]+", text.lower()))
        return words | {w[:n] + " " for n in (4, 5) for w in words if len(w) > n}

    has = [features(t) for t in texts]
    seen = Counter(x for h in has for x in h)
    chosen = []
    for k in range(labels.shape[1]):
        n1, n0 = float(labels[:, k].sum()), float((1 - labels[:, k]).sum())
        keep = []
        for term in seen:
            pos = float(sum(1 for h, y in zip(has, labels[:, k]) if y and term in h))
            neg = float(sum(1 for h, y in zip(has, labels[:, k]) if not y and term in h))
            if pos + neg < toxicity.MIN_DOCS:
                continue
            share = (pos + neg) / (n1 + n0)
            g = 2 * sum(a * np.log(a / e) for a, e in ((pos, share * n1), (neg, share * n0), (n1 - pos, n1 - share * n1), (n0 - neg, n0 - share * n0)) if a > 0 and e > 0)
            odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
            if abs(odds) >= toxicity.LEAST_ODDS and g >= toxicity.LEAST_G:
                keep.append(term)
        chosen.append(set(keep))
    vocabulary = sorted(set().union(*chosen))
    x = np.array([[float(v in h) for v in vocabulary] for h in has]).reshape(len(texts), -1)
    fold = np.array([(xxhash.xxh64_intdigest(t, 42) ^ (1 << 63)) - (1 << 63) for t in texts], object) % toxicity.FOLDS

    def fit(rows, k, earlier):
        z = np.column_stack((x[rows] * np.array([v in chosen[k] for v in vocabulary]), earlier[rows]))
        y, w, b = labels[rows, k].astype(float), np.zeros(z.shape[1]), 0.0
        weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
        m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, 401):
            error = weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -40, 40))) - y)
            grad = np.append(z.T @ error + 1e-5 * w, error.sum())
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return lambda rows, earlier: 1 / (1 + np.exp(-np.clip(np.column_stack((x[rows] * np.array([v in chosen[k] for v in vocabulary]), earlier[rows])) @ w + b, -40, 40)))

    every, earlier, shown, limits = np.arange(len(texts)), np.zeros((len(texts), 0)), np.zeros((len(texts), 0)), []
    for k in range(labels.shape[1]):
        out = np.zeros(len(texts))
        for f in range(toxicity.FOLDS):
            rest = np.flatnonzero(fold == f)
            out[rest] = fit(np.flatnonzero(fold != f), k, earlier)(rest, earlier)
        shown = np.column_stack((shown, fit(every, k, earlier)(every, shown)))
        grid = np.linspace(0.02, 0.98, 97)
        y = labels[:, k]
        f1 = np.array([2 * ((out >= t) & (y == 1)).sum() / (((out >= t) & (y == 1)).sum() + ((out >= t) & (y == 0)).sum() + y.sum()) for t in grid])
        limits.append(float(np.median(grid[f1 >= f1.max() - 1e-12])))
        earlier = np.column_stack((earlier, out))
    return shown, limits


def test_chain_equals_brute_force(spark):
    docs, labels, _ = toxic_table(spark, 150)
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    known = {r["doc_id"]: (r["low_quality"], r["toxic"]) for r in labels.collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known)
    want, limits = brute_chain([t for _, t in rows], np.array([known[i] for i, _ in rows]))
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert np.allclose(chain.thresholds, limits)
    for (i, _), p in zip(rows, want):
        assert np.allclose(got[i]["probabilities"], p, atol=1e-6) and got[i]["rejected"] == (p[-1] >= limits[-1])


# -- pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs, labels, truth = toxic_table(spark, 300)
    english = " the house and the garden were quiet in the long evening of that day"
    rows = [(r["doc_id"], r["text"] + english, "en", "s", 1) for r in docs.collect()]
    rows += [(900, rows[1][1], "en", "s", 1), (901, "12345 67", "en", "s", 1), (902, None, None, None, None), (None, "no number here but words" + english * 2, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", (1 - labels.low_quality).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {i for i, _, t in truth if t} and not kept & {900, 901, 902} and None in kept
    assert kept >= {i for i, _, t in truth if not t}


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = toxic_table(spark, 60)
    labels.select("doc_id", (1 - labels.low_quality).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    wide = docs.selectExpr("doc_id", "text", "'en' lang", "'mine' score", "'mine' rejected", "'mine' lang_pred", "'mine' k0", "1 fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and out.where("score = 'mine' and rejected = 'mine' and lang_pred = 'mine' and k0 = 'mine' and fp = 1").count() == out.count() > 0, name
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0


FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun väriin sukupuoleen kieleen uskontoon poliittiseen tai muuhun mielipiteeseen"


def test_language_stage_rejects_unlearned_languages_and_junk(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rnd = random.Random(13)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    clean = [r["text"] for r in docs.where("length(text) > 2000").orderBy("doc_id").limit(60).collect()]
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(1, 11))) for _ in range(n))
    base64 = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    finnish = lambda n: " ".join(rnd.choice(FINNISH.split()) for _ in range(n))
    junk = [f(n) for n in (25, 60, 400) for f in (letters, finnish)] + [FINNISH] + [base64(n) for n in (200, 2000)]
    short = [" ".join(t.split()[200:][: 12 + i % 20]) for i, t in enumerate(clean)]
    rows = [(10**9 + i, t, None) for i, t in enumerate(junk + short)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, both, sf).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(len(junk))}
    assert len(kept & {10**9 + i for i in range(len(junk), len(rows))}) == len(short)
    assert len(kept & {r["doc_id"] for r in docs.collect()}) >= 0.997 * docs.count()


def test_every_trusted_document_is_learned_or_held(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    n, learn = quality.trusted_documents(labels.unionAll(labels.limit(3).selectExpr("doc_id", "0", "0"))).selectExpr("count(*)", "count_if(learn)").first()
    assert n == 49_997 and abs(learn - n / 2) < 1000
