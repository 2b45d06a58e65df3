"""Queries on tables made to stand at a limit, against their oracles."""

import pytest

from marlstone.plans import bundles, catalog

duckdb = pytest.importorskip("duckdb")


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def wanted(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    return columns, sorted(map(repr, found.fetchall()))


def same(spark, folder, name, *tables):
    columns, rows = wanted(folder, name, *tables)
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, folder).select(*columns).collect()) == rows
    return rows


def test_lint_counts_the_body_without_the_line_that_parts_it(spark, tmp_path):
    """Bodies of one character less than the limit, at the limit, and one more."""
    con, rows = duckdb.connect(), []
    for i, n in enumerate((-1, 0, 1)):
        for doc_id in (100 + i * 10, 67 * 4 + 4 + i * 67):  # with frontmatter, and mostly without
            used = con.execute(f"SELECT length({bundles.BODY}) FROM (SELECT CAST({doc_id} AS BIGINT) AS doc_id, '' AS text, 'en' AS lang)").fetchone()[0]
            rows.append((doc_id, "x" * (bundles.LARGE + n - used), "en", "s", 1))
    folder = documents(spark, tmp_path, rows)
    found = same(spark, folder, "lint_concepts", "documents")
    assert 0 < sum("large-concept" in r for r in found) < len(rows)
    same(spark, folder, "lint_report", "documents")
    same(spark, folder, "lint_verdict", "documents")


def test_python_stages_hold_a_slice_of_a_batch(spark):
    """However many rows a batch has, a stage turns at most a slice of it into objects, and loses no row."""
    from marlstone.sources.slices import ROWS, map_slices

    n = 5 * ROWS + 3
    sizes = map_slices(spark.range(n).coalesce(1).selectExpr("id", "repeat('x', 10) AS text"), lambda b: {"id": b["id"], "n": [len(b["text"])] * len(b["id"])}, "id long, n long").collect()
    assert sorted(r["id"] for r in sizes) == list(range(n)) and max(r["n"] for r in sizes) == ROWS


def test_vectors_meet_a_block_of_queries_a_slice_at_a_time():
    import numpy as np

    from marlstone.operators import chunks

    class Seen(chunks._Best):
        most = 0

        def _add(self, keys, vectors):
            self.most = max(self.most, len(keys))
            super()._add(keys, vectors)

    rnd = np.random.default_rng(5)
    q, v = rnd.normal(size=(7, 16)), rnd.normal(size=(3 * chunks.SLICE + 5, 16))
    held = Seen(list(range(7)), q, 4)
    held.add(list(range(len(v))), v)
    scores = np.round(v @ q.T, 6)
    for c in range(7):
        want = sorted((-s, k) for k, s in enumerate(scores[:, c].tolist()) if s > 0)[:4]
        assert [k for _, k in held.best[c]] == [k for _, k in want]
    assert held.most == chunks.SLICE


def test_overlap_shuffles_asked_terms_only(spark, capsys):
    from marlstone.operators import search

    docs = spark.createDataFrame([(1, "red stone wall"), (2, "red red river"), (3, "red"), (4, None)], "doc_id long, text string")
    found = search.overlap_rank(docs, spark.createDataFrame([(7, "red stone")], "qid long, text string"), "doc_id", "qid")
    assert sorted(map(tuple, found.collect())) == [(7, 1, 2, 2, 1), (7, 2, 1, 2, 2)]
    found.explain("extended")
    assert "LeftSemi" in capsys.readouterr().out


def most_rows(df):
    """The most rows that a step of the plan of ``df`` makes, once it has run."""
    df.collect()

    def walk(node):
        inner = [getattr(node, name)() for kind, name in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if node.getClass().getSimpleName().endswith(kind)]
        children = node.children()
        for child in inner or [children.apply(i) for i in range(children.length())]:
            yield from walk(child)
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            yield found.get().value()

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_many_questions_make_no_row_for_each_document_they_share_a_term_with(spark):
    from marlstone.operators import search

    n = 400
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('common other word', id % 7) AS text")
    asked = spark.range(n).selectExpr("id AS qid", "concat('common word', id % 7) AS text")
    best = search.bm25(docs, asked, "doc_id", "qid")
    assert most_rows(best) < n * n / 4
    for r in best.collect():
        assert r["doc_id"] == r["qid"] % 7 + 7 * (r["rank"] - 1)  # equal scores by key
    assert best.count() == n * 10


def test_related_titles_make_no_row_for_each_text_they_share_a_term_with(spark):
    from marlstone.operators import graph

    n = 400
    docs = spark.range(n).selectExpr("id AS key", "concat('common own', id) AS title", "concat('common text with own', (id + 1) % 400, ' and common') AS text")
    docs = docs.unionAll(spark.sql("SELECT 1000L, 'common words here', 'words here own3 own5'"))
    found = graph.related(docs, "key", "title", "text")
    assert most_rows(found) < n * n / 4
    want = {(i, (i + 1) % n, 1) for i in range(n)}  # two terms need both; of three one may lack
    assert {tuple(r) for r in found.collect()} == want

    many = spark.range(30).selectExpr("id AS key", "'alpha beta gamma' AS title", "if(id = 7, 'nothing', 'gamma or alpha') AS text")
    assert {tuple(r) for r in graph.related(many, "key", "title", "text").collect()} == {(i, o, k + 1) for i in range(30) if i != 7 for k, o in enumerate([x for x in range(30) if x != i][:5])}


def test_titles_of_the_same_terms_are_dealt_a_few_times(spark):
    """No document can have more than the first few of them, so the others aren't sent to every part."""
    from marlstone.operators import graph

    n = 3000
    docs = spark.range(n).selectExpr("id AS key", "if(id % 2 = 0, 'gamma alpha', 'alpha gamma') AS title", "if(id < 20, 'alpha or gamma', 'other words') AS text")
    docs = docs.unionAll(docs.where("key < 3"))  # repeated rows are titles of their own
    found = graph.related(docs, "key", "title", "text")
    assert most_rows(found) < 2 * n
    got = {}
    for r in found.where("key >= 6").collect():
        got.setdefault(r["key"], {})[r["nth"]] = r["other"]
    assert set(got) == set(range(6, 20)) and all(x == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2} for x in got.values())


def test_compiling_moves_blocks_with_their_names_once(spark, monkeypatch):
    """Only the documents and the named documents are written with their blocks, and names don't carry any."""
    from marlstone.operators import bundle, compile
    from marlstone.sources.markdown import BLOCKS

    wide = []

    def seen(write):
        def run(df, name):
            wide.extend([name] if "blocks" in df.columns else [])
            return write(df, name)

        return run

    for module in (bundle, compile):
        monkeypatch.setattr(module, "materialize", seen(module.materialize))
    block = {"kind": "paragraph", "text": "Some text.", "level": None, "language": None, "anchor_id": None}
    rows = [("u/b", "2", "t", "Same", [block]), ("u/a", "2", "t", "Same", [block]), ("u/a", "1", "t", "Same", [block, block]), ("u/c", "1", "t", "Same-2", [])]
    docs = spark.createDataFrame(rows, f"uri string, source_hash string, retrieved_at string, title string, blocks {BLOCKS}")
    got = {r["rel_path"]: r["content"] for r in compile.compile_bundle(docs, "Kb").collect()}
    assert sorted(p for p in got if p.startswith("ref")) == ["references/same-2-2.md", "references/same-2.md", "references/same.md"]
    assert "source_hash: 1" in got["references/same.md"] and "uri: \"u/a\"" in got["references/same.md"]
    assert wide == ["documents", "named"]


def test_postings_are_moved_once(spark):
    """Terms are counted where a document is read, and blocks neither meet the counts of their terms nor are sorted by ranges."""
    from marlstone.operators import search
    from marlstone.session import materialize

    docs = spark.createDataFrame([(1, "a b a", "x"), (2, None, None), (3, "", "y y"), (4, "b", "b")], "k long, t string, h string")
    weighed = search.weigh(docs, "k", {"t": 1.0, "h": 5.0})
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(weighed) == 0 and exchanges(search.postings_blocks(materialize(weighed, "postings"), "k", 2)) == 1
    assert sorted(map(str, map(tuple, weighed.collect()))) == sorted(map(str, [
        (1, 4, None, 0.0), (1, 4, "a", 2.0), (1, 4, "b", 1.0), (1, 4, "x", 5.0), (2, 0, None, 0.0), (3, 2, None, 0.0), (3, 2, "y", 10.0), (4, 2, None, 0.0), (4, 2, "b", 6.0)]))
    got = search.postings_blocks(weighed, "k", 1000).collect()  # all in one group
    assert {r["term"]: [e["key"] for e in r["entries"]] for r in got} == {"a": [1], "b": [1, 4], "x": [1], "y": [3]}
    assert all(r["best"] == max(e["value"] for e in r["entries"]) and r["n"] == 4 for r in got)
    assert search.postings_blocks(search.weigh(docs.limit(0), "k", {"t": 1.0}), "k").count() == 0


def test_a_question_leaves_few_rows_however_many_parts_the_documents_have(spark, monkeypatch):
    """Tokens aren't shuffled, blocks of questions go past the parts one after another, and bars and ties hold over parts."""
    from marlstone.operators import search

    n = 400
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('common ', repeat(concat('word', id % 7, ' '), 1 + int(id % 3)), 'rare', id % 31, ' x', id) AS text").repartition(40)
    asked = spark.range(n).selectExpr("id AS qid", "concat('common word', id % 7, ' rare', id % 31, ' x', id) AS text")
    want = search.bm25(docs.coalesce(1), asked, "doc_id", "qid").collect()
    monkeypatch.setattr(search, "PART", 8)
    monkeypatch.setattr(search, "BLOCK", 50, raising=False)
    best = search.bm25(docs, asked, "doc_id", "qid")
    assert most_rows(best) <= n * 10
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want))
    assert sorted(r["qid"] for r in want if r["rank"] == 1 and r["doc_id"] == r["qid"]) == list(range(n))
    assert "Exchange" not in search.parts_of(docs.coalesce(1).localCheckpoint(), "doc_id", {"text": 1.0})._jdf.queryExecution().executedPlan().toString()
