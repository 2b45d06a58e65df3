"""Corpus operators on hand-made frames; lexical ranking against SQLite's full-text search."""

import hashlib
import random
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone.functions import stem
from marlstone.operators import ask, bundle, chunks, compile, conversation, evaluate, graph, lint, search
from marlstone.sources import files, markdown, web
from marlstone.streaming import incremental

CONCEPT = "---\ntype: Concept\ntitle: {t}\nstatus: draft\nsources:\n- id: source-001\n  resource: references/r.md\n---\n\n{b}\n"


def tree(spark, files_):
    return spark.createDataFrame([(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in files_.items()], "rel_path string, content binary")


def codes(spark, files_, manifest=None):
    f = tree(spark, files_)
    m = spark.createDataFrame(manifest, "rel_path string, sha256 string") if manifest else None
    return {(r["code"], r["path"]) for r in lint.lint(f, markdown.parse_files(f), m).collect()}


GOOD = {
    "index.md": "# Index\n\n[a](/concepts/a.md) [b](/concepts/b.md)", "log.md": "# Revision log\n\n- rev-0123456789ab — one\n- rev-0123456789ac — two\n",
    "concepts/a.md": CONCEPT.format(t="A", b="Text[^source-001] [b](b.md).\n\n[^source-001]: r"), "concepts/b.md": CONCEPT.format(t="B", b="Text [a](a.md)."), "references/r.md": "raw",
}


def test_lint_clean(spark):
    assert codes(spark, GOOD) == set()


@pytest.mark.parametrize("change,want", [
    ({"index.md": None}, {("conformance/missing-index", ""), ("quality/unindexed-concept", "concepts/a.md"), ("quality/unindexed-concept", "concepts/b.md")}),
    ({"log.md": None}, {("hygiene/missing-log", "")}),
    ({"concepts/a.md": "no frontmatter [b](b.md)"}, {("conformance/missing-frontmatter", "concepts/a.md")}),
    ({"concepts/a.md": "---\na: [\n---\nx"}, {("conformance/unparseable-frontmatter", "concepts/a.md")}),
    ({"concepts/a.md": "---\n- x\n---\nx"}, {("conformance/invalid-frontmatter-shape", "concepts/a.md")}),
    ({"concepts/a.md": b"\xff\xfe"}, {("conformance/invalid-encoding", "concepts/a.md")}),
    ({"concepts/c.md": CONCEPT.format(t="C", b="[x](../../up.md) [gone](gone.md)")}, {("integrity/path-traversal", "concepts/c.md"), ("hygiene/broken-link", "concepts/c.md"), ("hygiene/orphan-concept", "concepts/c.md")}),
    ({"references/r.md": None}, {("provenance/missing-source-resource", "concepts/a.md"), ("provenance/missing-source-resource", "concepts/b.md")}),
    ({"concepts/a.md": "---\ntype: ''\nstatus: odd\ngenerated: x\nverified: 3\nstale_after: soon\nsources:\n- id: s\n- id: s\n- 7\n- id: t\n  resource: /abs\n---\n\n[^source-9] [b](b.md)"}, {
        ("conformance/missing-type", "concepts/a.md"), ("hygiene/missing-title", "concepts/a.md"), ("provenance/invalid-status", "concepts/a.md"), ("provenance/invalid-generated", "concepts/a.md"),
        ("provenance/invalid-verified", "concepts/a.md"), ("provenance/invalid-stale-after", "concepts/a.md"), ("integrity/duplicate-id", "concepts/a.md"), ("provenance/malformed-source", "concepts/a.md"),
        ("integrity/path-traversal", "concepts/a.md"), ("hygiene/missing-footnote", "concepts/a.md"), ("provenance/unsupported-claim", "concepts/a.md"), ("provenance/missing-source-resource", "concepts/a.md")}),
])
def test_lint_findings(spark, change, want):
    assert codes(spark, {k: v for k, v in (GOOD | change).items() if v is not None}) == want


def test_lint_manifest_and_verdict(spark):
    entries = [("index.md", hashlib.sha256(GOOD["index.md"].encode()).hexdigest()), ("log.md", "0" * 64), ("gone.md", "0" * 64), ("../x.md", "0" * 64)]
    got = codes(spark, GOOD, entries)
    assert got == {("integrity/checksum-mismatch", "log.md"), ("integrity/manifest-missing-file", "manifest.json"), ("integrity/path-traversal", "manifest.json")}
    f = tree(spark, {k: v for k, v in GOOD.items() if k != "log.md"})
    found = lint.lint(f, markdown.parse_files(f))
    assert lint.verdict(found).first()["passes"] and not lint.verdict(found, strict=True).first()["passes"]


def test_health(spark):
    f = tree(spark, GOOD | {"concepts/o.md": "---\ntype: C\ntitle: O\nstale_after: '2020-01-01'\n---\n\nalone", "references/u.md": "uncited"})
    p = markdown.parse_files(f)
    r = lint.health(f, p, lint.lint(f, p), "2024-01-01").first()
    assert (r["concepts"], r["sourced"], r["orphans"], r["stale"], r["uncited_references"], r["source_coverage"]) == (3, 2, 1, 1, 1, 0.6667)


def test_bm25_equals_sqlite(spark):
    docs = [("a", "alpha beta", "about alpha", "x", "alpha gamma gamma delta"), ("b", "beta", "none", "alpha", "the beta and the gamma"), ("c", "gamma", "", "", "delta delta delta epsilon " * 5), ("d", "zeta", "words", "y", "nothing here")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE docs USING fts5(path UNINDEXED, title, description, tags, body)")
    con.executemany("INSERT INTO docs VALUES (?,?,?,?,?)", docs)
    for q in ("alpha", "beta gamma", "delta epsilon zeta"):
        match = " OR ".join(f'"{t}"' for t in q.split())
        want = con.execute("SELECT path, bm25(docs, 0.0, 5.0, 3.0, 2.0, 1.0) FROM docs WHERE docs MATCH ? ORDER BY 2, path", (match,)).fetchall()
        frame = spark.createDataFrame(docs, "path string, title string, description string, tags string, body string")
        got = search.bm25(frame, spark.createDataFrame([(1, q)], "qid int, text string"), "path", "qid", search.FIELD_WEIGHTS).orderBy("rank").collect()
        assert [(r["path"], r["score"]) for r in got] == [(p, round(s, 6)) for p, s in want]


def test_stemmed_bm25_equals_sqlite(spark):
    words = "running runs ran relational conditional rationally valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky café naïve"
    docs = [(f"d{i:03d}", w) for i, w in enumerate(words.split())]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE docs USING fts5(path UNINDEXED, body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO docs VALUES (?,?)", docs)
    frame = spark.createDataFrame(docs, "path string, text string")
    asked = [(i, w) for i, w in enumerate([*words.split(), "run", "relate", "hope", "adjust", "operate", "hop", "cafe"])]
    got = {}
    for r in search.bm25(frame, spark.createDataFrame(asked, "qid int, text string"), "path", "qid", split=stem.stems).collect():
        got.setdefault(r["qid"], set()).add((r["path"], r["score"]))
    for q, w in asked:
        want = {(p, round(s, 6)) for p, s in con.execute("SELECT path, bm25(docs) FROM docs WHERE docs MATCH ?", (f'"{w}"',))}
        assert got.get(q, set()) == want, w


def test_snippet():
    text = " ".join(f"w{i}" for i in range(40)) + " Running dogs bark. End"
    assert stem.snippet(text, {"run", "dog"}) == " … " + " ".join(f"w{i}" for i in range(30, 40)) + " [Running] [dogs] … "
    assert stem.snippet("", {"x"}) == "" and stem.snippet("one two", set()) == "one two"


def test_chunker(spark):
    df = spark.createDataFrame([(1, "x" * 1100), (2, "a\n\nb\n\n" + "c" * 498), (3, ""), (4, None)], "k int, t string")
    got = [(r["k"], r["seq"], len(r["chunk"])) for r in chunks.chunks(df, "k", "t").orderBy("k", "seq").collect()]
    assert got == [(1, 0, 500), (1, 1, 500), (1, 2, 100), (2, 0, 3), (2, 1, 498)]


def test_vector_ties(spark):
    v = spark.createDataFrame([("b#0", [1.0, 0.0]), ("a#1", [1.0, 0.0]), ("a#0", [1.0, 0.0]), ("z", [0.0, 1.0])], "id string, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, v array<double>")
    assert [r["id"] for r in chunks.vector_topk(q, v, "qid", "id", "v").orderBy("rank").collect()] == ["a#0", "a#1", "b#0"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves, depth):
    """The root digest of a hash tree over ``{path: sha256}``, level by level."""
    nodes = {}
    for p, h in leaves.items():
        nodes.setdefault(sha(p)[:depth], []).append(f"{sha(p)}\0{sha(p + chr(0) + h)}")
    for d in range(depth, -1, -1):
        digests = {k: sha("\n".join(sorted(v))) for k, v in nodes.items()}
        nodes = {}
        for k, v in digests.items():
            nodes.setdefault(k[: max(d - 1, 0)], []).append(f"{k}\0{v}")
    return digests[""]


def test_hash_trees(spark):
    """The root by plain Python; a difference by going down is the difference of all files; equal and empty trees."""
    rnd = random.Random(4)
    a = {f"d{i % 3}/f{i}.md": sha(str(i)) for i in range(700)}
    assert [bundle.tree_depth(n) for n in (0, 16, 17, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3]
    frame = lambda t: spark.createDataFrame(list(t.items()), "rel_path string, sha256 string").repartition(3)
    for depth in (0, 1, 2):
        assert bundle.hash_tree(frame(a), depth)[0].first()["digest"] == plain_root(a, depth)
    b = dict(a)
    for p in rnd.sample(sorted(a), 5):
        b[p] = sha("new")
    for p in rnd.sample(sorted(a), 3):
        b.pop(p, None)
    b["new/x.md"] = sha("x")
    for x, y in ((a, b), (b, a), (a, a), ({}, b), (a, {}), ({}, {})):
        want = {(p, "added" if p not in x else "removed" if p not in y else "changed") for p in x.keys() | y.keys() if x.get(p) != y.get(p)}
        assert {(r["rel_path"], r["change"]) for r in bundle.diff_trees(frame(x), frame(y)).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_names_are_taken_one_after_another(spark, seed):
    rnd = random.Random(seed)
    slugs = [rnd.choice(["x", "x", "x-2", "x-2-2", "x-3", "y", "y-2", "x-10"]) for _ in range(60)]
    taken, want = set(), []
    for s in slugs:
        k, name = 1, s
        while name in taken:
            k += 1
            name = f"{s}-{k}"
        taken.add(name), want.append(name)
    df = spark.createDataFrame(list(enumerate(slugs)), "nth int, slug string").repartition(3)
    assert [r["unique_slug"] for r in bundle.unique_slugs(df, "slug", "nth").orderBy("nth").collect()] == want


def test_bundle_views(spark):
    f = tree(spark, GOOD)
    roles = {r["rel_path"]: r["x"] for r in f.select("rel_path", bundle.role(F.col("rel_path")).alias("x")).collect()}
    assert roles == {"index.md": "index", "log.md": "log", "concepts/a.md": "concept", "concepts/b.md": "concept", "references/r.md": "reference"}
    kept = {p: sha(t) for p, t in GOOD.items() if p != "log.md"}
    assert bundle.revision_id(f) == "rev-" + sha(f"{len(kept)} {plain_root(kept, 0)}")[:12]
    assert [r["summary"] for r in bundle.history(f.where("rel_path = 'log.md'")).collect()] == ["two", "one"]
    asked = spark.createDataFrame([(p,) for p in ("concepts/a.md", "/concepts/a.md", "../a.md", "Concepts/a.md", ".x.md", "")], "rel_path string")
    assert [r["rel_path"] for r in bundle.safe_path(asked, f).collect()] == ["concepts/a.md"]
    g = tree(spark, {**GOOD, "concepts/a.md": "other", "new.md": "n"} | {}).where("rel_path <> 'concepts/b.md'")
    diff = {(r["rel_path"], r["change"]) for r in bundle.tree_diff(bundle.manifest(f), bundle.manifest(g)).collect()}
    assert diff == {("concepts/a.md", "changed"), ("concepts/b.md", "removed"), ("new.md", "added")}
    assert bundle.revision_id(f) == bundle.revision_id(f.repartition(3)) != bundle.revision_id(g)


def test_graph(spark):
    e = graph.link_edges(tree(spark, GOOD))
    assert {(r["src"], r["dst"]) for r in e.collect()} == {("index.md", "concepts/a.md"), ("index.md", "concepts/b.md"), ("concepts/a.md", "concepts/b.md"), ("concepts/b.md", "concepts/a.md")}
    r = graph.neighbours(e, spark.createDataFrame([("concepts/a.md",)], "path string"), 1).first()
    assert (r["outbound"], r["inbound"], r["total_inbound"]) == (["concepts/b.md"], ["concepts/b.md"], 2)
    h = graph.hops(spark.createDataFrame([(1, "index.md", 1), (1, "concepts/a.md", 2)], "qid int, path string, pos int"), e, 4).collect()
    assert [(r["path"], r["via"]) for r in h] == [("concepts/b.md", "index.md")]
    assert graph.projection(spark.createDataFrame([("concepts/a.md",), ("concepts/b.md",)], "path string"), e).count() == 2


def test_answers(spark):
    schema = "path string, title string, description string, tags array<string>, body string, status string, stale_after string, verified array<struct<by:string,at:string>>, resources array<string>"
    docs = spark.createDataFrame([
        ("concepts/tokens.md", "Token policy", "How tokens rotate", ["auth"], "# Summary\n\nTokens rotate weekly; see [storage](/concepts/store.md).\n\n# Sources\n\n- token token", "draft", None, [], ["references/t.md"]),
        ("concepts/store.md", "Vault", "Where secrets live", [], "Secrets sit hash-only in the vault storage.", "stable", "2020-01-01", [("human:x", "2020")], []),
        ("references/t.md", "Raw", "", [], "Tokens rotate weekly in the raw file about tokens.", None, None, [], []),
        ("concepts/other.md", "Other", "", [], "Nothing in common at all.", None, None, [], []), ("concepts/fifth.md", "Fifth", "", [], "Further prose.", None, None, [], []),
    ], schema)
    edges = spark.createDataFrame([("concepts/tokens.md", "concepts/store.md", "storage")], "src string, dst string, anchor string")
    q = spark.createDataFrame([("q1", "How do tokens rotate?"), ("q2", "What about zebras?")], "qid string, text string")
    got = {r["qid"]: r for r in ask.answer(q, docs, edges, today="2024-01-01").collect()}
    assert got["q1"]["citations"] == ["concepts/tokens.md", "concepts/store.md"] and not got["q1"]["abstained"]
    assert got["q1"]["warnings"] == ["concepts/tokens.md: status is draft — content is unreviewed", "concepts/tokens.md: unverified — no verification record", "concepts/store.md: stale since 2020-01-01"]
    assert got["q2"]["abstained"] and "No concept mentions: zebras" in got["q2"]["answer"]
    assert ask.policy_for() == ask.Policy("2", 6, 4, 8, 1000)


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "user", "q2"), (1, 2, "assistant", "a" * 700), (1, 3, "system", "s"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3")], "conv_id int, turn int, role string, text string")
    p = conversation.qa_pairs(t)
    assert [(r["question"], r["turn"]) for r in p.orderBy("turn").collect()] == [("q2", 2), ("q3", 5)]
    assert {len(r["answer"]) for r in conversation.recent(p).collect()} == {600, 2}
    assert conversation.user_turns(t).first()["user_turns"] == 3


def test_evaluation(spark):
    rows = [("pd", False, True, True, True, 1, 5, 10, 7, 0.5, False), ("pd", True, False, False, False, 0, 2, 13, 8, None, False), ("rag", False, True, False, True, 0, 1, 4, 1, None, True)]
    df = spark.createDataFrame(rows, "condition string, abstained boolean, appropriate boolean, gold_hit boolean, retrieval_hit boolean, warnings int, tool_calls int, spent_tokens int, latency_ms int, cost_usd double, exhausted boolean")
    got = {r["condition"]: r for r in evaluate.summary(df).collect()}
    assert (got["pd"]["answered"], got["pd"]["median_tokens"], got["pd"]["cost_usd"], got["rag"]["cost_usd"]) == (1, 11, 0.5, None)


def test_markdown(spark):
    text = "# Title\n\nPara one\nstill\n\n## Part\n\n- a\n  b\n- c\n\n> quote\n> more\n\n```py\ncode\n\nx\n```\n\n## Part\n"
    blocks, anchors = markdown.segment(text)
    assert [(b["kind"], b["level"]) for b in blocks] == [("heading", 1), ("paragraph", None), ("heading", 2), ("list", None), ("quote", None), ("code", None), ("heading", 2)]
    assert [a["id"] for a in anchors] == ["title", "part", "part-2"]
    df = markdown.normalize(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert df.select(markdown.render(F.col("blocks")).alias("x")).first()["x"] == "# Title\n\nPara one\nstill\n\n## Part\n\n- a\n  b\n- c\n\n> quote\n> more\n\n```py\ncode\n\nx\n```\n\n## Part"
    p = markdown.paragraphs(spark.createDataFrame([(1, "a \nb\n\n\nc"), (2, ""), (3, "\n\n")], "k int, t string"), "k", "t").orderBy("k", "start_line").collect()
    assert [(r["k"], r["start_line"], r["paragraph"]) for r in p] == [(1, 1, "a\nb"), (1, 5, "c")]
    data, body, error, _ = markdown.split_frontmatter("---\nz: 1\nx_own: 2\ntitle: T\nat: 2020-01-01\n---\nbody")
    assert error is None and data["at"] == "2020-01-01" and markdown.write_frontmatter(data, body).startswith("---\ntitle: T\nx_own: 2\nz: 1\n")
    assert markdown.plain_profile({"title": 1, "status": 2, "x_own": 3, "own": 4}) == {"title": 1, "own": 4}


def test_compile(spark):
    page = lambda t, b: [{"kind": "heading", "text": t, "level": 1, "language": None, "anchor_id": None}] + b
    para = lambda x: {"kind": "paragraph", "text": x, "level": None, "language": None, "anchor_id": None}
    head = lambda x: {"kind": "heading", "text": x, "level": 2, "language": None, "anchor_id": None}
    docs = spark.createDataFrame([("u/a", "h1", "t", "Wire Protocol", page("Wire Protocol", [para("Lead [x](y)."), head("Frames"), para("Frames carry data."), head("Bare")])), ("u/b", "h2", "t", "Guide", page("Guide", [para("Uses the wire protocol.")]))], f"uri string, source_hash string, retrieved_at string, title string, blocks {markdown.BLOCKS}")
    got = {r["rel_path"]: r["content"] for r in compile.compile_bundle(docs, "Kb").collect()}
    assert set(got) == {"index.md", "concepts/wire-protocol.md", "concepts/guide.md", "references/wire-protocol.md", "references/guide.md"}
    assert "Lead x.\n\n# Sections\n\n**Frames** — Frames carry data.\n\n**Bare**" in got["concepts/wire-protocol.md"]
    assert "# Related\n\n- [Wire Protocol](/concepts/wire-protocol.md)" in got["concepts/guide.md"] and "# Related" not in got["concepts/wire-protocol.md"]
    f = tree(spark, got | {"log.md": "# Revision log\n"})
    assert {r["code"] for r in lint.lint(f, markdown.parse_files(f)).where("severity <> 'info'").collect()} == set()
    ok = spark.range(1).select(compile.plan_valid(F.from_json(F.lit(json.dumps([{"title": "a", "sections": [0, 2]}, {"title": "b", "sections": [1]}])), "array<struct<title:string,sections:array<int>>>"), F.lit(3)).alias("x"))
    assert ok.first()["x"]


def test_web(spark):
    urls = ["http://127.0.0.1/", "http://0x7f.1/", "http://2130706433/", "http://[::ffff:10.0.0.1]/", "http://169.254.1.1/", "ftp://x/", "http://u:p@x/", "http://localhost/", "https://example.com/", "http://8.8.8.8/"]
    got = [r["blocked"] for r in web.url_policy(spark.createDataFrame([(u,) for u in urls], "u string"), "u").collect()]
    assert got == ["loopback", "loopback", "loopback", "private", "link-local", "scheme", "credentials", "loopback", None, None]
    rules, maps = web.robots("User-agent: *\nDisallow: /private\nAllow: /private/ok\nSitemap: http://x/s.xml")
    assert maps == ["http://x/s.xml"] and not web.allowed(rules, "/private/a") and web.allowed(rules, "/private/ok/1") and web.allowed(rules, "/")
    maps_ = spark.createDataFrame([("<urlset xmlns='x'><url><loc> http://x/a </loc></url></urlset>",), ("<!DOCTYPE x><urlset><loc>bad</loc></urlset>",)], "xml string")
    assert [r["loc"] for r in web.sitemap_urls(maps_, "xml").collect()] == ["http://x/a"]
    pages = spark.createDataFrame([("http://x/a", "A"), ("http://x/b", "B"), ("http://y/c", "C")], "url string, html string")
    edges = spark.createDataFrame([("http://x/a", "http://x/b#f"), ("http://x/b", "http://x/a"), ("http://x/b", "http://y/c")], "src string, dst string")
    assert [r["url"] for r in web.crawl(pages, pages.where("html = 'A'").select("url"), edges, "x").collect()] == ["http://x/a", "http://x/b"]
    r = web.html_blocks(spark.createDataFrame([(1, "http://h/my-page.html", "<h1>Head</h1><p>a  b<script>no</script></p><ul><li>i</li></ul><pre>x\n y</pre><a href='/l'>t</a>")], "k int, u string, h string"), "k", "u", "h").first()
    assert r["title"] == "Head" and [(b["kind"], b["text"]) for b in r["blocks"]] == [("heading", "Head"), ("paragraph", "a b"), ("list", "- i"), ("code", "x\n y")] and r["links"][0]["target"] == "http://h/l"


def test_files(spark, tmp_path):
    root = tmp_path / "src"
    for p, c in {"a.md": "# A\n\ntext", "sub/b.txt": "plain", ".hidden/c.md": "x", "skip/d.md": "x", "e.bin": "x"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    (root / "sub" / "_kept.md").write_text("# K")
    (root / "link.md").symlink_to(root / "a.md")
    (root / "far").symlink_to(root / "skip")
    assert sorted(r["rel_path"] for r in files.bundle(spark, str(root)).collect()) == ["a.md", "e.bin", "skip/d.md", "sub/_kept.md", "sub/b.txt"]
    (root / "sub" / "_kept.md").unlink()
    rows = files.scan(spark, str(root), ["skip/"])
    assert sorted(r["rel_path"] for r in rows.collect()) == ["a.md", "sub/b.txt"]
    assert [r["rel_path"] for r in files.scan(spark, str(root), ["skip/"], after="a.md").collect()] == ["sub/b.txt"]
    assert {(r["uri"], r["title"]) for r in files.documents(rows).collect()} == {("a.md", "A"), ("sub/b.txt", "b")}
    with pytest.raises(ValueError):
        files.capped(rows, 1)
    t = tree(spark, GOOD)
    a, b = str(tmp_path / "a.tar.gz"), str(tmp_path / "b.tar.gz")
    assert files.pack(t, a) == files.pack(t.repartition(3), b)
    assert bundle.revision_id(files.unpack(spark, a)) == bundle.revision_id(t)
    with open(a, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        files.unpack(spark, a)
    repo = lambda u: spark.createDataFrame([(u,)], "u string").select(files.repository(F.col("u")).alias("r")).first()["r"]
    assert tuple(repo("https://github.com/o/r.git")) == ("o", "r", None) and tuple(repo("https://github.com/o/r/tree/v1")) == ("o", "r", "v1") and tuple(repo("git@github.com:o/r.git"))[:2] == ("o", "r")


def test_incremental(spark, tmp_path):
    src, target, mark = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    (src / "a.md").write_text("one")
    (src / "b.md").write_text("one")
    incremental.upsert(incremental.file_stream(spark, str(src)), target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 1
    (src / "c.md").write_text("two")
    (src / "d.md").write_text("one")
    incremental.upsert(incremental.file_stream(spark, str(src)), target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    folder = f"file://{tmp_path}/rev"
    assert incremental.publish(tree(spark, GOOD), folder, "rev-1") and not incremental.publish(tree(spark, GOOD), folder, "rev-1")


def test_blocks_rank_as_all_postings_do(spark):
    """Passing over groups changes nothing, ties at the bar and questions with few hits included; rare terms keep most groups unread."""
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(20)]
    docs = [(i, " ".join(rnd.choices(common, k=rnd.randrange(1, 40)) + ([f"rare{i % 25}"] * rnd.randrange(1, 4) if i % 4 == 0 else []))) for i in range(1500)] + [(2000, None), (2001, "")]
    docs += [(3000 + i, "tie tie c1") for i in range(30)]
    asked = [(1, "rare3 c1 c2"), (2, "c1 c2 c3 c4"), (3, "rare7 rare8"), (4, "tie"), (5, "unknown words"), (6, "rare1 tie c5")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid int, text string")
    weighed = search.weigh(d, "doc_id", {"text": 1.0}).cache()
    terms = search.asked_terms(q, "qid")
    rows = lambda x: sorted(map(tuple, x.collect()))
    for group in (1, 8, 32, 4000):
        blocks = search.postings_blocks(weighed, "doc_id", group).cache()
        for top in (1, 10, 50):
            assert rows(search.block_rank(blocks, terms, "doc_id", "qid", top)) == rows(search.rank(weighed, terms, "doc_id", "qid", top)), (group, top)
    rare = search.asked_terms(q.where("qid in (1, 3, 6)"), "qid")
    read, all_ = search.blocks_read(search.postings_blocks(weighed, "doc_id", 8), rare, "doc_id", "qid", 5)
    assert read < all_ / 2


def test_budgets_of_large_groups(spark):
    """One group has most rows; nulls are a group and cost nothing; the running sum is that of all rows in order."""
    rnd = random.Random(6)
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), i, rnd.choice([0, 1, 5, None, 40])) for i in range(3000)]
    want = []
    for g in ("a", "b", None):
        total = 0
        for _, i, c in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total += c or 0
            if total > 900:
                break
            want.append((str(g), i, total))
    df = spark.createDataFrame(rows, "g string, i long, c int").repartition(7)
    got = chunks.budget_prefix(df, "g", ["i"], F.col("c"), 900)
    assert got.columns == ["g", "i", "c", "running"] and sorted((str(r["g"]), r["i"], r["running"]) for r in got.collect()) == sorted(want)
