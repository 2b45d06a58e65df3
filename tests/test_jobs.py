"""The jobs: growing input, reruns, interrupted runs, options; the report on a small site."""

import json
import logging
import os
import subprocess
import sys

import pytest

from jobs import _run, document_feed, queries, site_report

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"line {i} " + "word " * 30 for i in range(40))
FIRST = [(1, "alpha beta\ngamma", "en", "s", 1), (2, LONG, "de", "s", 1), (3, "alpha beta\ngamma", "en", "t", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
SECOND = [(6, LONG, "fr", "u", 1), (7, "delta " * 300, None, "u", 1), (1, "alpha beta, changed", "en", "s", 1), (8, "alpha beta\ngamma", "en", "s", 1)]


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(folder)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def run(spark, base, **how):
    document_feed.feed(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", state_partitions=2, **how)


def want(docs):
    """Documents with their passages, by plain Python."""
    import hashlib
    import re

    out = []
    for doc_id, text, lang, source, _ in docs:
        pieces = [p[i : i + 500] for p in (x.strip() for x in (text or "").split("\n")) if p for i in range(0, len(p), 500)]
        packed = []
        for p in pieces:
            if packed and len(packed[-1]) + 1 + len(p) <= 500:
                packed[-1] += "\n" + p
            else:
                packed.append(p)
        h = hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        rows = [(k, p, len(re.findall(r"\w+", p))) for k, p in enumerate(packed)] or [(None, None, None)]
        out += [(doc_id, source, lang or "und", h, len(text) if text is not None else None, *r) for r in rows]
    return sorted(map(str, out))


def got(spark, base):
    return sorted(str(tuple(r)) for r in document_feed.output_of(spark, f"{base}/out").collect())


def test_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    base = str(tmp_path)
    add(spark, f"{base}/in", FIRST)
    with caplog.at_level(logging.INFO, "jobs"):
        run(spark, base)
        assert got(spark, base) == want(FIRST)
        first = files(f"{base}/out")
        add(spark, f"{base}/in", SECOND)
        caplog.clear()
        run(spark, base)
        assert "read 4 rows, items written 4" in caplog.text and "new texts 2" in caplog.text
        assert got(spark, base) == want(FIRST + SECOND)
        both = files(f"{base}/out")
        assert first.items() <= both.items()  # what was there is neither written again nor removed
        caplog.clear()
        run(spark, base)
        assert "items: nothing new" in caplog.text and "passages: nothing new" in caplog.text
    assert files(f"{base}/out") == both


def test_feed_in_small_batches_and_from_one_file(spark, tmp_path):
    base = str(tmp_path)
    for r in FIRST + SECOND:
        add(spark, f"{base}/in", [r])
    run(spark, base, files_per_batch=1)
    assert got(spark, base) == want(FIRST + SECOND)
    one = next(p for p in files(f"{base}/in"))
    document_feed.feed(spark, one, f"{base}/one", f"{base}/one-checkpoint", state_partitions=2)
    assert document_feed.output_of(spark, f"{base}/one").select("doc_id").distinct().count() == 1


def test_a_run_that_broke_off_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    add(spark, f"{base}/in", FIRST)
    run(spark, base)
    add(spark, f"{base}/in", SECOND)
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(document_feed, "passages_of", broken)
        with pytest.raises(OSError):
            run(spark, base)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    # and one that ends inside a batch: its offsets are written, its commit isn't
    run(spark, base)
    last = max(int(f) for f in os.listdir(f"{base}/checkpoint/passages/commits") if f.isdigit())
    os.remove(f"{base}/checkpoint/passages/commits/{last}")
    os.remove(f"{base}/checkpoint/passages/commits/.{last}.crc")
    run(spark, base)
    assert got(spark, base) == want(FIRST + SECOND)


def test_feed_of_an_empty_table(spark, tmp_path):
    base = str(tmp_path)
    add(spark, f"{base}/in", [])
    run(spark, base)
    assert got(spark, base) == []
    add(spark, f"{base}/in", FIRST)
    run(spark, base)
    assert got(spark, base) == want(FIRST)


# -- the report ----------------------------------------------------------------------------------


def page(title, *links):
    return f"<html><title>{title}</title><body>" + "".join(f'<a class="x" href="{h}">l</a>' for h in links) + "</body></html>"


PAGES = [
    (1, "https://A.example/", page("Home", "/docs/a", "b#part", "https://other.example/x", "mailto:x@y")),
    (2, "https://a.example/docs/a", page("A", "../b", "./c", "../docs/", "?q=1", "")),
    (3, "https://a.example:443/b", page(" ", "//a.example/docs/a")),
    (4, "https://a.example/lonely", page("Alone", "/lonely")),
    (5, "https://a.example/copy", page("A", "../b", "./c", "../docs/", "?q=1", "")),
    (6, "https://a.example/b", page("B again", "/copy")),
    (6, "https://a.example/b", page("B again", "/copy")),
    (7, None, None),
    (8, "nonsense", ""),
]
FOUND = {
    ("broken-link", 2, "https://a.example/docs/c"), ("broken-link", 2, "https://a.example/docs/a?q=1"), ("broken-link", 5, "https://a.example/c"), ("broken-link", 5, "https://a.example/copy?q=1"),
    ("orphan", 1, ""), ("orphan", 4, ""), ("orphan", 7, ""), ("orphan", 8, ""), ("copy", 5, "https://a.example/docs/a"), ("same-address", 6, "https://a.example:443/b"),
    ("missing-title", 3, ""), ("missing-title", 7, ""), ("missing-title", 8, ""),
}


def test_report(spark, tmp_path, caplog):
    base = str(tmp_path)
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{base}/in")
    results = []
    with caplog.at_level(logging.INFO, "jobs"):
        for _ in range(2):
            site_report.report(spark, f"{base}/in", f"{base}/out")
            results.append(sorted(map(str, site_report.output_of(spark, f"{base}/out").collect())))
    assert results[0] == results[1] and caplog.text.count(f"wrote {len(FOUND)} findings") == 2
    rows = site_report.output_of(spark, f"{base}/out").collect()
    assert {(r["code"], r["page_id"], r["detail"]) for r in rows if r["code"]} == FOUND
    counts = {r["page_id"]: r["n_findings"] for r in rows}
    assert counts == {p: sum(f[1] == p for f in FOUND) for p in range(1, 9)}
    assert {os.path.basename(d) for d in os.listdir(f"{base}/out/findings") if "=" in d} == {f"code={f[0]}" for f in FOUND}


def test_report_of_an_empty_table(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{base}/in")
    site_report.report(spark, f"{base}/in", f"{base}/out")
    assert site_report.output_of(spark, f"{base}/out").collect() == []


# -- the command line ----------------------------------------------------------------------------


def test_options(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": "d", "output": "o", "checkpoint": "c"}))
    found = _run.options(spark, str(config), document_feed.DEFAULTS, {"output": "p", "passage_chars": "200", "documents": None})
    assert found == {"documents": "d", "output": "p", "checkpoint": "c", "files_per_batch": 1000, "passage_chars": 200, "state_partitions": 64}
    with pytest.raises(ValueError, match="without a value: checkpoint"):
        _run.options(spark, None, document_feed.DEFAULTS, {"documents": "d", "output": "o"})
    config.write_text(json.dumps({"pages": "d", "output": "o", "speed": 1}))
    with pytest.raises(ValueError, match="unknown options: speed"):
        _run.options(spark, str(config), site_report.DEFAULTS, {})
    for job in (document_feed, site_report):
        name = job.__name__.rpartition(".")[2]
        assert set(json.load(open(f"{os.path.dirname(job.__file__)}/{name}.json"))) == set(job.DEFAULTS)


def test_command_line(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    root = os.path.dirname(os.path.dirname(document_feed.__file__))
    done = subprocess.run([sys.executable, "-m", "jobs.site_report", "--master", "local[2]", "--pages", f"{tmp_path}/in", "--output", f"{tmp_path}/out"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and f"wrote {len(FOUND)} findings" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/out/findings").count() == len(FOUND)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in result.fetchall())
