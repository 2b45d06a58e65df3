"""Priced calls, candidates and conversations against plain Python."""

import json
import random
import re

import pytest

from marlstone import cli
from marlstone.explorer import Explorer
from marlstone.operators import ask, bundle, conversation, navigate

DOC = "path string, title string, description string, tags array<string>, body string, status string, stale_after string, verified array<struct<by:string,at:string>>, resources array<string>"
ODD = 'quote " back \\ tab \t bell \x07 é 漢 [a "b"](./x.md#y) [out](https://e.org) \x85'


def bundle_of(n, rnd):
    docs, edges = [], []
    for i in range(n):
        kind = "references" if i % 7 == 6 else "concepts"
        body = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randrange(3, 400))) + (ODD if i % 3 == 0 else "\n" * (i % 30))
        docs.append((f"{kind}/d{i}.md", None if i % 5 == 4 else f"Title {i} \"q\"", ODD if i % 4 == 0 else None, ["t", ODD][: i % 3], body, "draft", "2020-01-01" if i % 6 == 0 else None, [], []))
    paths = [d[0] for d in docs] + ["concepts/gone.md"]
    for d in docs:
        edges += [(d[0], t, "see") for t in rnd.sample(paths, rnd.choice((0, 1, 5, 30)) % len(paths))]
    return docs, edges


def said(x):
    return len(json.dumps(x, ensure_ascii=False))


def matter(d):
    return {k: v for k, v in (("title", d[1]), ("description", d[2]), ("tags", d[3]), ("status", d[5])) if v is not None}


def seen(d, today):
    """What a peek and a read return."""
    import posixpath

    path, body = d[0], d[4]
    lines = body.split("\n")
    start = "\n".join(lines[:20])[:8000]
    found = [{"text": t, "target": u.split(" ")[0], "external": "://" in u, "resolved": None if "://" in u else posixpath.normpath(posixpath.join(posixpath.dirname(path), u.split("#")[0]))} for t, u in re.findall(r"\[([^\]]*)\]\(([^)]*)\)", body)]
    peek = {"path": path, "frontmatter": matter(d), "body_start": start, "body_lines_total": len(lines), "truncated": len(lines) > 20 or len(start) < len(body)}
    read = {"path": path, "frontmatter": matter(d), "body": body[:40000], "chars": len(body[:40000]), "start_char": 0, "body_total_chars": len(body), "next_start": 40000 if len(body) > 40000 else None,
            "truncated": len(body) > 40000, "links": found, "stale_after": d[6], "stale": bool(d[6] and d[6] < today)}
    return peek, read


def test_prices_are_the_length_of_the_json(spark):
    rnd = random.Random(2)
    docs, _ = bundle_of(40, rnd)
    docs.append(("concepts/long.md", "L", None, [], "x" * 39_990 + '"' * 50, "stable", None, [], []))
    got = {r["path"]: (r["peek"], r["read"]) for r in navigate.prices(spark.createDataFrame(docs, DOC), "2024-01-01").collect()}
    for d in docs:
        assert got[d[0]] == tuple(map(said, seen(d, "2024-01-01"))), d[0]


def reference_log(qid_hits, carried, docs, edges, reads, fanout, budget, overview, searched):
    """The calls of one question, made one after another."""
    by = {d[0]: d for d in docs}
    concept = lambda p: not p.startswith("references/")
    carry = [p for p in dict.fromkeys(carried) if concept(p)][:2]
    wanted = list(dict.fromkeys(carry + [p for p in qid_hits if concept(p)]))[:reads] or [p for p in qid_hits if not concept(p)][:reads]
    calls, spent, exhausted = [], 0, False

    def call(tool, path, chars):
        nonlocal spent
        spent += chars
        calls.append((tool, path, chars, spent))

    tokens = lambda: max(1, spent // 4) if spent else 0
    call("overview", None, overview)
    call("search", None, searched)
    for p in wanted:
        if tokens() >= budget:
            exhausted = True
            break
        if p in by:
            call("peek", p, said(seen(by[p], "2024-01-01")[0]))
    done = []
    for p in wanted:
        if tokens() >= budget:
            exhausted = True
            break
        if p in by:
            call("read", p, said(seen(by[p], "2024-01-01")[1]))
            done.append(p)
    followed, known = 0, set(done)
    out = lambda p: sorted({t for s, t, _ in edges if s == p and t in by})
    into = lambda p: sorted({s for s, t, _ in edges if t == p})
    for p in list(done):
        if followed >= fanout or tokens() >= budget:
            break
        if not concept(p):
            continue
        call("links", p, said({"path": p, "outbound": out(p)[:16], "inbound": into(p)[:16], "outbound_total": len(out(p)), "inbound_total": len(into(p))}))
        for t in out(p)[:16]:
            if followed >= fanout:
                break
            if tokens() >= budget:
                exhausted = True
                break
            if t in known or not concept(t):
                continue
            known.add(t)
            call("read", t, said(seen(by[t], "2024-01-01")[1]))
            followed += 1
    return calls, exhausted


@pytest.mark.parametrize("budget", [1, 900, 2500, 6000, 10**9])
def test_call_log_equals_one_call_after_another(spark, budget):
    rnd = random.Random(budget)
    docs, edges = bundle_of(40, rnd)
    paths = [d[0] for d in docs]
    hits = {f"q{k}": rnd.sample(paths, rnd.choice((0, 1, 3, 10))) for k in range(25)}
    hits["refs"] = [p for p in paths if p.startswith("references/")][:3]
    carried = {q: rnd.sample(paths + ["concepts/gone.md", "../escape.md"], rnd.choice((0, 0, 1, 4))) for q in hits}
    prices = {q: rnd.randrange(100, 3000) for q in hits}
    q = spark.createDataFrame([(x,) for x in hits], "qid string")
    found = spark.createDataFrame([(x, p, i + 1, "concept" if p.startswith("concepts/") else "reference") for x, ps in hits.items() for i, p in enumerate(ps)], "qid string, path string, rank int, kind string")
    brought = spark.createDataFrame([(x, p, i) for x, ps in carried.items() for i, p in enumerate(ps)], "qid string, path string, nth int")
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(edges, "src string, dst string, anchor string")
    seeds = navigate.candidates(found, 4, brought).join(d.select("path"), "path", "left_semi")
    searched = spark.createDataFrame(list(prices.items()), "qid string, chars int")
    log = navigate.call_log(q, seeds, searched, d, e, 4, budget, 700, "2024-01-01").orderBy("qid", "nth").collect()
    for x in hits:
        mine = [r for r in log if r["qid"] == x]
        calls, exhausted = reference_log(hits[x], carried[x], docs, edges, 4, 4, budget, 700, prices[x])
        assert [(r["tool"], r["path"], r["chars"], r["spent"]) for r in mine] == calls and all(r["exhausted"] == exhausted for r in mine), x


def test_bounded_frontmatter(spark):
    assert bundle.bounded({"a": "x", "b": 1}, 100) == {"a": "x", "b": 1}
    assert bundle.bounded({"a": "xxxx", "b": "yyyy", "c": 1}, 8) == {"a": "xxxx", "b": '"y…[truncated]', "_truncated": True}
    assert bundle.bounded({"a": "xxxx", "b": "yyyy"}, 6) == {"a": "xxxx", "_truncated": True}
    rows = [(json.dumps({"a": "é" * 10, "b": [1, 2]}, ensure_ascii=False),), (None,), (json.dumps({"z": "w" * 9000, "k": 1}),)]
    got = [json.loads(r["m"]) for r in spark.createDataFrame(rows, "f string").select(bundle.bounded_json("f").alias("m")).collect()]
    assert got[:2] == [{"a": "é" * 10, "b": [1, 2]}, {}] and got[2]["_truncated"] and len(got[2]["z"]) == 8000 + len("…[truncated]") and "k" not in got[2]


# -- over a built bundle ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def explorer(spark, tmp_path_factory):
    src, out = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("bundle")
    (src / "release.md").write_text("# Release process\n\nA release is signed by the lead. Incidents follow [incident response](incident.md).\n")
    (src / "incident.md").write_text("# Incident response\n\nThe pager wakes the operator at night.\n")
    (src / "broken.md").write_text("# Broken\n\nZephyr winds.\n")
    cli.build(spark, str(src), str(out), "Kb")
    return Explorer(spark, str(out), "2024-01-01")


def test_prices_are_those_of_the_views(explorer):
    for r in navigate.prices(explorer.docs, explorer.today).collect():
        if r["path"].startswith("concepts/"):
            assert r["peek"] == said(explorer.peek(r["path"])) and r["read"] == said(explorer.read(r["path"])), r["path"]
    seeds = explorer.docs.where(bundle.is_concept(explorer.docs["path"])).selectExpr("'q' AS qid", "path", "1 AS pos")
    for r in navigate._edge_prices(seeds, explorer.edges, explorer.docs).collect():
        assert r["edges"] == said(explorer.links(r["path"]))


def test_trace_and_budget(explorer, tmp_path):
    question = "Who signs a release?"
    got = explorer.ask(question, trace=f"{tmp_path}/t.json")
    trace = json.loads((tmp_path / "t.json").read_text())
    tools = [t["tool"] for t in trace["tools"]]
    assert tools[:2] == ["overview", "search"] and tools.index("peek") < tools.index("read") and "links" in tools
    assert all(set(t) == {"tool", "args", "chars", "tokens"} for t in trace["tools"]) and trace["paths_read"] == sorted(trace["paths_read"])
    assert trace["budget"]["spent_chars"] == sum(t["chars"] for t in trace["tools"]) and not trace["budget"]["exhausted"] and not got["abstained"]
    explorer.ask(question, trace=f"{tmp_path}/u.json", budget=1)
    trace = json.loads((tmp_path / "u.json").read_text())
    assert [t["tool"] for t in trace["tools"]] == ["overview", "search"] and trace["budget"]["exhausted"] and trace["paths_read"] == []
    rag = explorer.ask(question, mode="rag")
    assert not rag["abstained"] and all(p.startswith("references/") for p in rag["citations"])
    with pytest.raises(ValueError, match="unknown mode"):
        explorer.ask(question, mode="guess")


def test_search_and_ask_rank_alike(explorer):
    """Stems find what plain words don't: the index that answers is the one that searches."""
    assert "concepts/release-process.md" in [h["path"] for h in explorer.search("signing releases")["results"]]
    assert ("read", "concepts/release-process.md") in [(c["tool"], c["path"]) for c in explorer.ask("signing releases")["calls"]]


def test_broken_frontmatter_is_found(spark, tmp_path):
    """By its whole text, under its path; so is a file without a title."""
    (tmp_path / "concepts").mkdir()
    (tmp_path / "concepts" / "torn-sail.md").write_text("---\ntitle: [open\n---\n\nZephyr winds carry salt and sand.\n")
    (tmp_path / "concepts" / "bare-mast.md").write_text("---\ntype: Concept\n---\n\nQuiet water.\n")
    (tmp_path / "index.md").write_text("# Index\n")
    e = Explorer(spark, str(tmp_path))
    assert [(h["path"], h["title"]) for h in e.search("zephyr")["results"]] == [("concepts/torn-sail.md",) * 2]
    assert [h["path"] for h in e.search("mast")["results"]] == ["concepts/bare-mast.md"]
    assert e.ask("zephyr winds blow")["citations"] == ["concepts/torn-sail.md"]


def test_carried_documents_come_first(explorer):
    plain = explorer.ask("Who wakes at night?", carried=["../escape.md", "concepts/gone.md", "concepts/release-process.md"], turns=1)
    assert plain["carried"] == []  # of the first two neither can be read, and there is no third
    assert plain["answer"].startswith("Based on") and "and 1 prior turn(s):" in plain["answer"]
    on = explorer.ask("And who then?", carried=["concepts/incident-response.md"], turns=7)
    assert on["carried"] == ["concepts/incident-response.md"] and any(c["path"] == "concepts/incident-response.md" and c["tool"] == "read" for c in on["calls"])


def test_chat_goes_on(spark, explorer, tmp_path):
    import io

    log, sink = f"{tmp_path}/c.jsonl", io.StringIO()
    assert cli.chat(explorer, log, io.StringIO("Who signs a release?\n\nWho wakes the operator?\n"), sink) == 2
    assert "and 1 prior turn(s)" in sink.getvalue()
    again = io.StringIO()
    assert cli.chat(explorer, log, io.StringIO("When does the pager ring, the operator?\n"), again) == 1
    assert "and 2 prior turn(s)" in again.getvalue()


def test_conversations_of_no_one(spark):
    docs, edges = bundle_of(5, random.Random(1))
    turns = spark.createDataFrame([(1, 0, "assistant", "hello"), (2, 0, "user", "  "), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(edges, "src string, dst string, anchor string").dropDuplicates(["src", "dst"])
    assert conversation.answers(conversation.questions_of(turns), d, e).collect() == []


def test_rounds_leave_only_their_answers_and_read_only_what_they_reach(spark):
    """Each round equals ``ask.answer`` over all documents, its working tables are gone, and a small round writes a few of the documents aside."""
    from marlstone import session

    docs, edges = bundle_of(400, random.Random(4))
    edges = list({e[0]: e for e in edges}.values())  # one link each, so that few documents are reached
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(edges, "src string, dst string, anchor string").dropDuplicates(["src", "dst"])
    turns = [(c, t, "user", f"Is alpha {'beta' if t % 2 else 'gamma'} number {c * 7 + t}?") for c in range(2) for t in range(3 + c)]
    asked = conversation.questions_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    before, name, wrote = session.scratch_count(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    conf = spark.conf.get(name)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(conversation, "materialize", lambda df, name: wrote.append(name) or session.materialize(df, name))
        out = conversation.answers(asked, d, e)
    got = {r["qid"]: r for r in out.collect()}
    left = [x.rsplit("/", 1)[1].split("-")[0] for x in session._SCRATCH[before:]]
    assert left == ["questions", "found"] + ["answers"] * 4 and spark.conf.get(name) == conf
    assert "near" in wrote
    carried = {}
    for k in range(1, 5):
        now = asked.where(f"nth = {k}").selectExpr("*", f"{k - 1} AS turns")
        rows = [(f"{c}#{k}", p, i) for c, cited in carried.items() for i, p in enumerate(cited)]
        carried = {}
        for r in ask.answer(now, d, e, carried=spark.createDataFrame(rows, "qid string, path string, nth int") if k > 1 else None).collect():
            assert r.asDict() == {c: got[r["qid"]][c] for c in r.asDict()}, r["qid"]
            carried[r["qid"].split("#")[0]] = r["citations"]
    assert len(got) == len(turns) and any(r["carried"] for r in got.values())


def test_tool_schemas():
    assert cli.schema("peek") == {"type": "object", "properties": {"path": {"type": "string"}, "lines": {"type": "integer", "default": 20}}, "required": ["path"], "additionalProperties": False}
    assert cli.schema("overview")["properties"] == {} and cli.schema("list")["properties"]["tag"] == {"type": "string"}
    assert ask.BUDGET == 25_000
