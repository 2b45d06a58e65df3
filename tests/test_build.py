"""Builds, imports and the persisted index."""

import json

import pytest

from marlstone import build, index, store
from marlstone.explorer import Explorer
from marlstone.providers import MODELS, StubModel


@pytest.fixture
def source(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "wire-protocol.md").write_text("# Wire Protocol\n\nFrames carry data.\n\n## Frames\n\nA frame has a header.\n\n## Errors\n\nErrors close the link.\n")
    (src / "guide.md").write_text("# Guide\n\nUses the wire protocol daily.\n")
    return src


def test_build_publishes_once(spark, source, tmp_path):
    out = str(tmp_path / "kb")
    times = iter(["2025-01-01T00:00:00Z"] * 3 + ["2026-01-01T00:00:00Z"] * 9)
    first = build.build(spark, [str(source)], out, "Kb", clock=lambda: next(times))
    assert first.published and first.changed and first.passed and store.Store(spark, out).current() == first.revision
    assert (tmp_path / "kb" / "concepts" / "guide.md").exists() and json.loads((tmp_path / "kb" / "manifest.json").read_text())["files"]["index.md"]["bytes"] > 0
    again = build.build(spark, [str(source)], out, "Kb", clock=lambda: next(times))
    assert again.revision == first.revision and not again.changed and not again.published  # times are those of the first build
    assert (tmp_path / "kb" / "log.md").read_text().count("- rev-") == 1
    assert build.drift(spark, [str(source)], out, "Kb", clock=lambda: "2027-01-01T00:00:00Z") == []
    (source / "guide.md").unlink()
    (source / "new.md").write_text("# New\n\nFresh text.\n")
    third = build.build(spark, [str(source)], out, "Kb", clock=lambda: "2027-01-01T00:00:00Z")
    assert third.published and not (tmp_path / "kb" / "concepts" / "guide.md").exists() and (tmp_path / "kb" / "concepts" / "new.md").exists()
    assert (tmp_path / "kb" / "log.md").read_text().count("- rev-") == 2 and set(store.Store(spark, out).revisions()) == {first.revision, third.revision}
    old = Explorer(spark, out)
    assert [x["rel_path"] for x in old.overview()["contents"]] == ["concepts/new.md", "concepts/wire-protocol.md"]
    assert old.index.stats()["edges"] > 0


def test_index_is_written_once_and_searched(spark, source, tmp_path):
    out = str(tmp_path / "kb")
    built = build.build(spark, [str(source)], out, "Kb")
    idx = index.Index(store.Store(spark, out), built.revision)
    assert not idx.ensure()  # it is there
    q = spark.createDataFrame([(1, "frame headers"), (2, "nothing at all here zzz")], "qid int, text string")
    hits = idx.search(q).collect()
    assert {r["path"] for r in hits} == {"concepts/wire-protocol.md", "references/wire-protocol.md"} and all(r["qid"] == 1 for r in hits)
    assert idx.retrieve(q.where("qid = 1")).orderBy("rank").first()["path"] == "references/wire-protocol.md"
    (tmp_path / "kb" / ".marlstone" / "passing").mkdir(exist_ok=True)
    lost = tmp_path / "kb" / ".marlstone" / "passing" / "late"
    lost.mkdir()
    assert not idx.store.settle(str(lost.as_uri()), idx.folder) and not lost.exists() and idx.search(q).count() == 2


class Splitter(StubModel):
    """Splits each document into its sections; counts what it is asked."""

    id = "splitter"

    def complete(self, prompt_id, payload):
        if prompt_id == "concept-plan":
            return json.dumps({"concepts": [{"title": h, "sections": [i]} for i, h in enumerate(payload["sections"])]})
        if prompt_id == "concept-description" and payload["title"] == "Bad":
            raise RuntimeError("refused")
        return super().complete(prompt_id, payload)


def test_plans_split_documents_and_lint_gates(spark, source, tmp_path, monkeypatch):
    from marlstone.sources.files import bundle as read

    out = str(tmp_path / "kb")
    import marlstone.build as b

    monkeypatch.setattr(b, "completions", lambda df, prompt, payload, spec: said(spark, df, prompt, payload))
    asked = []

    def said(spark, df, prompt, payload):
        rows = [r.asDict() for r in df.collect()]
        asked.extend((prompt, r["key"]) for r in rows)
        return spark.createDataFrame([(*r.values(), Splitter().complete(prompt, json.loads(r[payload]))) for r in rows], df.schema.simpleString()[7:-1] + ",completion:string") if rows else df.selectExpr("*", "'' as completion")

    first = build.build(spark, [str(source)], out, "Kb", provider="splitter")
    paths = {r["rel_path"] for r in read(spark, out).collect()}
    assert {"concepts/frames.md", "concepts/errors.md", "concepts/guide.md", "references/wire-protocol.md"} <= paths and first.passed
    assert "Frames carry data." in (tmp_path / "kb" / "concepts" / "frames.md").read_text()  # the lead goes to the first concept
    n = len(asked)
    build.build(spark, [str(source)], out, "Kb", provider="splitter")
    assert len(asked) == n  # everything was remembered
    (source / "bad.md").write_text("# Bad\n\nText.\n")
    (source / "good.md").write_text("# Good\n\nText.\n")
    with pytest.raises(RuntimeError):
        build.build(spark, [str(source)], out, "Kb", provider="splitter")
    assert store.Store(spark, out).current() == first.revision


def test_import(spark, tmp_path):
    src = tmp_path / "foreign"
    (src / "sub").mkdir(parents=True)
    (src / "index.md").write_text("# Root\n\n[a](sub/a.md)\n")
    (src / "sub" / "a.md").write_text("---\ntype: Note\ntitle: A\nown: 1\n---\n\nText.\n")
    (src / "_kept.md").write_text("---\ntype: Note\ntitle: K\n---\n\nText.\n")
    out = build.import_bundle(spark, str(src), str(tmp_path / "kb"))
    assert out.published and (tmp_path / "kb" / "sub" / "a.md").read_text() == (src / "sub" / "a.md").read_text() and (tmp_path / "kb" / "_kept.md").exists()
    assert not build.import_bundle(spark, str(src), str(tmp_path / "kb")).changed
    (src / "sub" / "b.md").write_text("---\ntitle: [open\n---\n\nText.\n")
    bad = build.import_bundle(spark, str(src), str(tmp_path / "kb"))
    assert not bad.passed and not bad.published and not (tmp_path / "kb" / "sub" / "b.md").exists()
    with pytest.raises(build.BuildError):
        build.import_bundle(spark, str(tmp_path / "none"), str(tmp_path / "kb"))


def test_command_line(spark, source, tmp_path, monkeypatch, capsys):
    from marlstone import cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    kb = str(tmp_path / "kb")

    def said(*argv):
        code = cli.main(["--bundle", kb, *argv])
        return code, json.loads(capsys.readouterr().out or "null")

    assert said("init", "Kb")[0] == 0 and said("init", "Kb")[0] == 1
    assert said("add", str(source))[1]["sources"] == 1 and said("add", str(source))[0] == 1 and said("add", "x", "--connector", "no")[0] == 1
    assert said("config")[1]["model"] == "stub" and set(said("plugin")[1]["connectors"]) >= {"files", "web", "repository"} and said("keys")[0] == 1
    code, out = said("build")
    assert code == 0 and out["published"] and out["counts"] == {"source_files": 2, "concepts": 2}
    assert said("check") == (0, {"drift": []}) and said("doctor")[1]["revision"] == out["revision_id"]
    (source / "guide.md").write_text("# Guide\n\nOther text.\n")
    code, out = said("check")
    assert code == 1 and ["concepts/guide.md", "changed"] in out["drift"]
    trace = tmp_path / "trace.json"
    assert not said("ask", "What is the wire protocol?", "--trace", str(trace))[1]["abstained"] and json.loads(trace.read_text())["budget"]["spent_tokens"] > 0
    assert said("viz", str(tmp_path / "g.html"))[0] == 0 and "concepts/guide.md" in (tmp_path / "g.html").read_text()
    assert said("pack", str(tmp_path / "k.tar.gz"), "--profile", "plain")[0] == 0
    assert Explorer(spark, kb).frontmatter("concepts/guide.md", 40)["_truncated"]


def test_chat_keeps_its_log(spark, source, tmp_path):
    import io

    from marlstone import cli
    from marlstone.sources import records

    build.build(spark, [str(source)], str(tmp_path / "kb"), "Kb")
    sink = io.StringIO()
    assert cli.chat(Explorer(spark, str(tmp_path / "kb")), str(tmp_path / "c1.jsonl"), io.StringIO("What do frames carry?\n\n"), sink) == 1 and "passage" in sink.getvalue()
    rows = records.conversations(spark, str(tmp_path / "c1.jsonl")).orderBy("turn").collect()
    assert [r["role"] for r in rows] == ["user", "assistant"] and rows[1]["citations"]


def test_build_of_a_folder_and_a_site(spark, source, tmp_path):
    from marlstone import cli
    from marlstone.build import build
    from marlstone.sources.connectors import ConnectorError
    from tests.test_connectors import fetcher

    sources = [str(source), ("web", "https://s.example")]
    out = build(spark, sources, f"{tmp_path}/kb", "Kb", fetcher=fetcher)
    paths = {r["rel_path"] for r in out.files.collect()}
    assert out.passed and {"concepts/home.md", "concepts/b.md", "concepts/wire-protocol.md"} <= paths and len([p for p in paths if p.startswith("concepts/")]) == out.report["counts"]["concepts"]
    assert build(spark, sources, f"{tmp_path}/kb", "Kb", fetcher=fetcher).revision == out.revision
    with pytest.raises(ConnectorError, match="needs a transport"):
        build(spark, [("web", "https://s.example")], f"{tmp_path}/no", "No")
    with pytest.raises(ConnectorError, match="unknown connector"):
        build(spark, [("smoke", "x")], f"{tmp_path}/no", "No", fetcher=fetcher)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / cli.PROJECT).write_text('[project]\nname = "P"\n[[sources]]\nuri = "docs"\n[[sources]]\nconnector = "web"\nuri = "https://s.example"\n')
    assert cli.project_sources(f"{tmp_path}/p") == ("P", [f"{tmp_path}/p/docs", ("web", "https://s.example")])


def test_init_from_a_folder_or_an_archive(spark, source, tmp_path, monkeypatch, capsys):
    from marlstone import cli
    from marlstone.sources import files

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    first = cli.build(spark, str(source), f"{tmp_path}/kb", "Kb")
    from marlstone.explorer import Explorer

    tree = Explorer(spark, f"{tmp_path}/kb").files
    files.pack(tree, f"{tmp_path}/kb.tar.gz")
    assert cli.main(["--bundle", f"{tmp_path}/copy", "init", "Copy", "--from", f"{tmp_path}/kb.tar.gz"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["passes"] and said["published"] and said["revision_id"] == first
    assert cli.main(["--bundle", f"{tmp_path}/copy", "init", "Copy", "--from", f"{tmp_path}/kb.tar.gz"]) == 1  # there already


def test_exports():
    import marlstone

    assert all(getattr(marlstone, n) is not None for n in marlstone.__all__) and marlstone.Explorer.__name__ == "Explorer"
    with pytest.raises(AttributeError):
        marlstone.nothing
