"""Explorer, command line, server and providers over a small bundle folder."""

import io
import json

import pytest

from marlstone import cli, providers
from marlstone.explorer import Explorer, Refused


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("src")
    (src / "wire-protocol.md").write_text("# Wire Protocol\n\nFrames carry data.\n\n## Frames\n\nA frame has a header.\n")
    (src / "guide.md").write_text("# Guide\n\nUses the wire protocol daily.\n")
    out = tmp_path_factory.mktemp("bundle")
    first = cli.build(spark, str(src), str(out), "Kb")
    assert cli.build(spark, str(src), str(out), "Kb") == first
    return str(out)


def test_views(spark, root):
    e = Explorer(spark, root, "2024-01-01")
    o = e.overview()
    assert (o["concepts"], o["references"], o["unverified"], o["types"]) == (2, 2, 2, {"Concept": 2})
    assert [x["rel_path"] for x in e.list("concepts/")["entries"]] == ["concepts/guide.md", "concepts/wire-protocol.md"]
    hits = e.search("frames")["results"]
    assert {h["path"]: h["kind"] for h in hits} == {"concepts/wire-protocol.md": "concept", "references/wire-protocol.md": "reference"} and all("[" in h["snippet"] for h in hits)
    peeked = e.peek("concepts/guide.md", 3)
    assert peeked["frontmatter"]["title"] == "Guide" and peeked["body_start"].count("\n") == 2 and peeked["truncated"]
    r = e.read("concepts/guide.md", 10)
    assert len(r["body"]) == 10 and r["next_start"] == 10 and any(x["target"] == "/concepts/wire-protocol.md" for x in r["links"])
    assert "concepts/wire-protocol.md" in e.links("concepts/guide.md")["outbound"]
    assert len(e.history()["revisions"]) == 1
    with pytest.raises(Refused):
        e.read("../x.md")
    assert e.graph()["edges"] == [{"src": "concepts/guide.md", "dst": "concepts/wire-protocol.md"}]
    assert not e.ask("What is the wire protocol?")["abstained"]
    assert e.lint().where("severity <> 'info'").count() == 0 and e.diff(Explorer(spark, root)) == []


def test_server(spark, root):
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "peek", "arguments": {"path": "/etc/passwd"}}},
             {"id": 4, "method": "tools/call", "params": {"name": "history", "arguments": {}}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "tools/call", "params": {"name": "read", "arguments": {"wrong": 1}}}]
    sink = io.StringIO()
    cli.serve(Explorer(spark, root), io.StringIO("not json\n" + "\n".join(map(json.dumps, lines))), sink)
    got = {r["id"]: r for r in map(json.loads, sink.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6} and len(got[2]["result"]["tools"]) == 7
    assert got[3]["result"]["isError"] and not got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and "invalid" in got[6]["result"]["content"][0]["text"]


def test_completions_must_end_well(monkeypatch, tmp_path):
    assert providers.clean("ok", "x", "p").text == "ok"
    for bad in ("", "  ", providers.Completion("cut", "length"), providers.Completion("no", "refusal")):
        with pytest.raises(providers.ProviderError):
            providers.clean(bad, "x", "p")
    (tmp_path / "m.toml").write_text('model = "stub:large"\n')
    machine = providers.machine_settings(str(tmp_path / "m.toml"))
    assert providers.setting(None, machine.get("model")) == "stub:large" and providers.setting("flag", machine.get("model")) == "flag" and providers.machine_settings(str(tmp_path / "none.toml")) == {}
    monkeypatch.setenv("MARLSTONE_STUB_URL", "http://env/")
    assert providers.endpoint("stub", "http://file/") == "http://env/" and providers.endpoint("other", None, "http://file/") == "http://file/"
    said = providers.StubModel().complete("chat-answer", {"evidence": [{"path": "a.md", "title": " ", "excerpt": " x "}], "history": [1, 2]})
    assert said == "Based on 1 passage(s) and 2 prior turn(s):\n- a.md: x [a.md]" and providers.StubModel().complete("concept-plan", {}) == '{"concepts": []}'


def test_providers(spark):
    df = spark.createDataFrame([('{"title": "X"}', "a b a"), ("{}", None)], "p string, t string")
    got = [r["completion"] for r in providers.completions(df, "reference-description", "p").collect()]
    assert got == ["Acquired source snapshot of X.", "Acquired source snapshot of this source."]
    v = [r["vector"] for r in providers.embeddings(df, "t").collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and sum(v[1]) == 0
    from marlstone.operators.chunks import hashed_bow

    sparse = {r["bucket"]: r["weight"] for r in hashed_bow(df.where("t is not null"), "p", "t").collect()}
    assert {i: round(x, 12) for i, x in enumerate(v[0]) if x} == {k: round(x, 12) for k, x in sparse.items()}
    with pytest.raises(ValueError):
        providers.resolve("nobody:model")
    assert providers.setting(None, "", "machine") == "machine" and providers.setting() == "stub"
    assert providers.StubModel().complete("chat-answer", {"evidence": [{"path": "a", "excerpt": "e"}], "history": [1]}).splitlines() == ["Based on 1 passage(s) and 1 prior turn(s):", "- a: e [a]"]


def test_records_and_evaluation(spark, root, tmp_path):
    from marlstone.operators import evaluate
    from marlstone.sources import records
    from marlstone.streaming.incremental import publish

    log = tmp_path / "logs"
    log.mkdir()
    for role, text in (("user", "q"), ("assistant", "a")):
        records.append_turn(f"{log}/c1.jsonl", "c1", role, text, ["p.md"])
    with open(log / "c1.jsonl", "a") as f:
        f.write('broken {\n{"type": "other"}\n')
    records.append_turn(f"{log}/c1.jsonl", "c1", "user", "again")
    rows = records.conversations(spark, str(log)).orderBy("turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in rows] == [("c1", "user", "q"), ("c1", "assistant", "a"), ("c1", "user", "again")]
    (tmp_path / "project.toml").write_text('[project]\nname = "P"\n[[sources]]\nconnector = "files"\nuri = "docs"\n')
    assert records.project(str(tmp_path / "project.toml"))["sources"][0]["uri"] == "docs"
    spec = '[benchmark]\nname = "b"\n[bundles]\nkb = "{}"\n[[questions]]\nid = "1"\nbundle = "kb"\nclass = "lookup"\nquestion = "What do frames carry?"\ngold_evidence = ["references/wire-protocol.md"]\n[[questions]]\nid = "2"\nbundle = "kb"\nclass = "unanswerable"\nquestion = "zebras?"\n'
    (tmp_path / "spec.toml").write_text(spec.format(root))
    name, bundles, questions = records.benchmark(spark, str(tmp_path / "spec.toml"))
    assert name == "b" and bundles == {"kb": root}
    got = {(r["qid"], r["condition"]): r for r in evaluate.run(Explorer(spark, root), questions).collect()}
    assert got["1", "pd"]["gold_hit"] and got["1", "rag"]["gold_hit"] and got["1", "rag"]["retrieval_hit"] and got["2", "pd"]["abstained"] and got["2", "pd"]["appropriate"]
    (tmp_path / "bad.toml").write_text(spec.format(root).replace('"lookup"', '"odd"'))
    with pytest.raises(ValueError):
        records.benchmark(spark, str(tmp_path / "bad.toml"))
    files = Explorer(spark, root).files
    publish(files, f"file://{tmp_path}/r", "rev-a")
    assert records.revisions(spark, f"file://{tmp_path}/r") == ["rev-a"] and records.revisions(spark, f"file://{tmp_path}/none") == []
    assert {r["rel_path"] for r in records.manifest(files).collect()} >= {"index.md", "log.md", "concepts/guide.md"}  # a build writes one
