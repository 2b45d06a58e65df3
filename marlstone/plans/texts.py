"""Queries over Markdown texts, pages, plans, caches and evaluation, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import ask, bundle, chunks, compile, conversation, evaluate, navigate
from marlstone.plans.bundles import BODY, PATH, TITLE, FLAW, STATUS, STALE, TYPE, files
from marlstone.session import materialize, table
from marlstone.sources import files as F_
from marlstone.sources import markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def clipped(x: str, cap: int) -> str:
    """``clip_words`` in SQL."""
    head = f"substr({x}, 1, {cap - 1})"
    kept = f"rtrim(regexp_replace({head}, ' [^ ]*$', ''), ' ,;:—-')"
    return f"CASE WHEN length({x}) <= {cap} THEN {x} ELSE (CASE WHEN {kept} = '' THEN {head} ELSE {kept} END) || '…' END"


# -- Markdown ---------------------------------------------------------------------------------------

#: Blocks of every kind behind the body of ``bundles``.
MORE = "chr(10) || chr(10) || '- item a' || chr(10) || '- item b' || chr(10) || chr(10) || '> quoted' || chr(10) || '> more' || chr(10) || chr(10) || '```py' || chr(10) || 'code # x' || chr(10) || chr(10) || 'x' || chr(10) || '```' || chr(10) || chr(10) || '## Note tail ##'"
_SEE = "regexp_extract({0}, 'See \\[next\\][^\\n]*')"
_BLOCKS = f"""
    b AS (SELECT doc_id, doc_id % 61 = 0 AS bare, {BODY} AS body, regexp_replace(text, '[ \\t\\r]+(\\n|$)', '\\1', 'g') AS prose, doc_id % 3 = 0 AS n0, doc_id % 5 = 0 AS s1 FROM documents),
    k AS (SELECT *, list_filter([
        CASE WHEN NOT bare THEN {{'kind': 'heading', 'level': '1', 'language': 'None', 'text': 'Note ' || doc_id}} END,
        CASE WHEN NOT bare AND trim(prose) <> '' THEN {{'kind': 'paragraph', 'level': 'None', 'language': 'None', 'text': prose}} END,
        CASE WHEN NOT bare THEN {{'kind': 'paragraph', 'level': 'None', 'language': 'None', 'text': {_SEE.format('body')}}} END,
        CASE WHEN NOT bare THEN {{'kind': 'paragraph', 'level': 'None', 'language': 'None', 'text': 'Claimed[^source-' || (doc_id % 3) || '] and noted[^n' || (doc_id % 2) || '].'}} END,
        CASE WHEN NOT bare AND n0 THEN {{'kind': 'paragraph', 'level': 'None', 'language': 'None', 'text': '[^n0]: a note'}} END,
        CASE WHEN NOT bare AND s1 THEN {{'kind': 'paragraph', 'level': 'None', 'language': 'None', 'text': '[^source-1]: a source'}} END,
        {{'kind': 'list', 'level': 'None', 'language': 'None', 'text': '- item a' || chr(10) || '- item b'}}, {{'kind': 'quote', 'level': 'None', 'language': 'None', 'text': 'quoted' || chr(10) || 'more'}},
        {{'kind': 'code', 'level': 'None', 'language': 'py', 'text': 'code # x' || chr(10) || chr(10) || 'x'}}, {{'kind': 'heading', 'level': '2', 'language': 'None', 'text': 'Note tail'}}], lambda x: x IS NOT NULL) AS ks FROM b)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.expr(f"{BODY} || {MORE}").alias("md"))
    return markdown.normalize(docs, "doc_id", "md")


@query("WITH" + _BLOCKS + """ SELECT doc_id, CASE WHEN NOT bare THEN 'Note ' || doc_id END AS title, len(ks) AS n_blocks,
        sha256(array_to_string(list_transform(ks, lambda x: x.kind || chr(1) || x.level || chr(1) || x.language || chr(1) || x.text), chr(0))) AS content_hash,
        CASE WHEN bare THEN 'note-tail' ELSE 'note-' || doc_id || ' note-tail' END AS anchors FROM k""")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _blocks(spark, sf)
    return rows.select("doc_id", "title", F.size("blocks").cast("long").alias("n_blocks"), X.content_hash("blocks").alias("content_hash"), F.array_join(F.transform("anchors", lambda a: a["id"]), " ").alias("anchors"))


@query("WITH" + _BLOCKS + """ SELECT doc_id, sha256(array_to_string(list_transform(ks, lambda x: CASE x.kind WHEN 'heading' THEN repeat('#', x.level::INT) || ' ' || x.text
        WHEN 'code' THEN '```' || x.language || chr(10) || x.text || chr(10) || '```' WHEN 'quote' THEN '> ' || replace(x.text, chr(10), chr(10) || '> ') ELSE x.text END), chr(10) || chr(10))) AS sha256 FROM k""")
def markdown_render(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", F.sha2(markdown.render(F.col("blocks")), 256).alias("sha256"))


_LINK = r"!?\[([^\[\]]*)\]\(([^()]*)\)"
_SPACE = r"[\s\x0b\x{85}\p{Z}]+"
_PLAIN = f"CASE WHEN position('](' IN body) > 0 THEN replace(regexp_replace(body, '{_LINK}', '\\1', 'g'), '](', '] (') ELSE body END"


@query(f"""
    WITH b AS (SELECT doc_id, {BODY} AS body FROM documents), p AS (SELECT *, {_PLAIN} AS plain FROM b),
    d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(plain, '\\[\\^[^\\]]+\\]:?', '', 'g'), '{_SPACE}', ' ', 'g'), '^ | $', '', 'g') AS digest FROM p),
    f AS (SELECT *, CASE WHEN regexp_matches(digest, '[.!?]\\s') THEN regexp_extract(digest, '^(.*?[.!?])\\s', 1) ELSE digest END AS sentence FROM d)
    SELECT doc_id, sha256(regexp_replace(regexp_replace(body, '\\[([^\\]]*)\\]\\(([^)]*)\\)', '\\1', 'g'), '\\[\\^[^\\]]+\\]', '', 'g')) AS visible, sha256(plain) AS plain, sha256(digest) AS digest, {clipped('sentence', 200)} AS first_sentence FROM f""")
def prose_forms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.expr(BODY).alias("body"))
    return docs.select("doc_id", F.sha2(X.visible_prose("body"), 256).alias("visible"), F.sha2(X.strip_links("body"), 256).alias("plain"), F.sha2(X.digest_text("body"), 256).alias("digest"), X.first_sentence("body").alias("first_sentence"))


_TAIL = "chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || 'never prose'"


@query(f"""
    WITH b AS (SELECT doc_id, string_split({BODY} || {_TAIL}, chr(10) || chr(10)) AS parts, doc_id % 61 = 0 AS bare FROM documents),
    r AS (SELECT doc_id, bare, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ' || chr(10) || chr(9)) AS para FROM b)
    SELECT doc_id, pos, 'note ' || doc_id AS section, sha256(para) AS para FROM r WHERE NOT bare AND para <> '' AND NOT starts_with(para, '# ') AND NOT starts_with(para, '## ') AND NOT starts_with(para, '[^') AND para <> 'never prose'""")
def candidate_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.expr(f"{BODY} || {_TAIL}").alias("body"))
    rows = ask.candidate_paragraphs(docs, "doc_id", "body")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "section", F.sha2("para", 256).alias("para"))


_WRITTEN = (
    "'---' || chr(10) || coalesce('type: ' || CASE WHEN trim({type}) = '' THEN '''  ''' ELSE {type} END || chr(10), '') || coalesce('title: ' || {title} || chr(10), '') || 'tags:' || chr(10) || '- ' || lang || chr(10) || '- t' || (doc_id % 4) || chr(10) || "
    "coalesce('status: ' || {status} || chr(10), '') || CASE doc_id % 4 WHEN 0 THEN 'generated:' || chr(10) || '  by: tool' || chr(10) || '  at: ''2025-01-02T03:04:05Z''' || chr(10) WHEN 2 THEN 'generated: yesterday' || chr(10) WHEN 3 THEN 'generated:' || chr(10) || '  at: ''2025-01-02''' || chr(10) ELSE '' END || "
    "CASE doc_id % 5 WHEN 1 THEN 'verified:' || chr(10) || '- by: human:ann' || chr(10) || '  at: ''2025-02-03''' || chr(10) WHEN 2 THEN 'verified:' || chr(10) || '- by: tool' || chr(10) || '  at: ''2025-02-03''' || chr(10) "
    "WHEN 3 THEN 'verified:' || chr(10) || '- by: tool' || chr(10) || '  at: never' || chr(10) WHEN 4 THEN 'verified:' || chr(10) || '- by: tool' || chr(10) || '  at: ''2025-02-03''' || chr(10) || '- by: human:bob' || chr(10) || '  at: ''2025-02-04''' || chr(10) ELSE '' END || "
    "CASE doc_id % 8 WHEN 1 THEN 'sources:' || chr(10) || '- id: source-1' || chr(10) || '  resource: references/r' || (doc_id - doc_id % 10 + 3) || '.md' || chr(10) WHEN 2 THEN 'sources:' || chr(10) || '- id: source-0' || chr(10) || '- id: source-0' || chr(10) WHEN 3 THEN 'sources: none' || chr(10) "
    "WHEN 4 THEN 'sources:' || chr(10) || '- resource: references/x.md' || chr(10) WHEN 5 THEN 'sources:' || chr(10) || '- id: source-2' || chr(10) || '  resource: ../../etc/x.md' || chr(10) WHEN 6 THEN 'sources:' || chr(10) || '- id: source-1' || chr(10) || '  resource: references/none.md' || chr(10) "
    "WHEN 7 THEN 'sources:' || chr(10) || '- id: source-2' || chr(10) || '  title: plain' || chr(10) ELSE '' END || coalesce('stale_after: ' || CASE WHEN {stale} = 'soon' THEN 'soon' ELSE '''' || {stale} || '''' END || chr(10), '') || '---' || chr(10) || chr(10) || rtrim({body}, chr(10)) || chr(10)"
).format(type=f"({TYPE})", title=f"({TITLE})", status=f"({STATUS})", stale=f"({STALE})", body=f"({BODY})")
_PROFILE = f"'---' || chr(10) || coalesce('title: ' || ({TITLE}) || chr(10), '') || 'tags:' || chr(10) || '- ' || lang || chr(10) || '- t' || (doc_id % 4) || chr(10) || '---' || chr(10) || chr(10) || rtrim(({BODY}), chr(10)) || chr(10)"


@query(f"SELECT {PATH} AS path, sha256({_WRITTEN}) AS written, sha256({_PROFILE}) AS plain FROM documents WHERE {FLAW} = 'good'")
def written_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = markdown.rewrite_files(files(spark, sf))
    return rows.where("written is not null").select(F.col("rel_path").alias("path"), F.sha2("written", 256).alias("written"), F.sha2("plain", 256).alias("plain"))


# -- pages ------------------------------------------------------------------------------------------

_TEXT = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '<br>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g'), '&quot;?', '\"', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_DECODED = _TEXT.replace("'&amp;', '&'", "'&amp;', '&'")


@query(f"""
    WITH x AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t, regexp_extract_all(regexp_extract(html, '<ul>(.*?)</ul>', 1, 's'), '<li>(.*?)</li>', 1, 's') AS items,
                      regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h, regexp_extract_all(html, '<p>((?:[^<]|</?b>|<br>)*)</p>', 1) AS ps FROM pages),
    y AS (SELECT page_id, {_DECODED.format("replace(t, '&amp', '&amp;')").replace("replace(t, '&amp', '&amp;')", "regexp_replace(t, '&amp;?', '&amp;', 'g')")} AS title,
                 array_to_string(list_filter(list_transform(items, lambda i: '- ' || {_DECODED.format('i')}), lambda i: i <> '- '), chr(10)) AS list, {_DECODED.format("regexp_replace(h, '&amp;?', '&amp;', 'g')")} AS heading,
                 list_filter(list_transform(ps, lambda i: {_DECODED.format('i')}), lambda i: i <> '') AS paras FROM x),
    z AS (SELECT page_id, title, list_filter([CASE WHEN list <> '' THEN {{'kind': 'list', 'level': NULL::INT, 'text': list}} END, CASE WHEN heading <> '' THEN {{'kind': 'heading', 'level': 1, 'text': heading}} END], lambda b: b IS NOT NULL)
                 || list_transform(paras, lambda p: {{'kind': 'paragraph', 'level': NULL::INT, 'text': p}}) AS bs FROM y)
    SELECT page_id, title, unnest(range(len(bs))) AS pos, unnest(list_transform(bs, lambda b: b.kind)) AS kind, unnest(list_transform(bs, lambda b: b.level)) AS level, unnest(list_transform(bs, lambda b: b.text)) AS text FROM z""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import html_blocks as parse

    rows = parse(table(spark, sf, "pages"), "page_id", "url", "html").select("page_id", "title", F.posexplode("blocks").alias("pos", "b"))
    return rows.select("page_id", "title", F.col("pos").cast("long").alias("pos"), "b.kind", "b.level", "b.text")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) = 'blog.' || substr(regexp_extract(url, '^https?://([^/]*)', 1), 6) AS in_scope FROM pages")
def url_scope(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import in_scope

    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    return table(spark, sf, "pages").select("page_id", in_scope(F.col("url"), F.concat(F.lit("blog."), F.substring(host, 6, 500))).alias("in_scope"))


_HOST = "CASE doc_id % 8 WHEN 0 THEN '127.0.0.' || (doc_id % 200) WHEN 1 THEN '10.' || (doc_id % 250) || '.0.1' WHEN 2 THEN '169.254.7.' || (doc_id % 200) WHEN 3 THEN '8.8.' || (doc_id % 200) || '.8' WHEN 4 THEN '0x7f.1' WHEN 5 THEN '2130706433' WHEN 6 THEN '224.0.0.' || (doc_id % 200) ELSE 'example.org' END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'scheme' WHEN doc_id % 50 = 9 THEN 'credentials' WHEN doc_id % 8 IN (0, 4, 5) THEN 'loopback' WHEN doc_id % 8 = 1 THEN 'private' WHEN doc_id % 8 = 2 THEN 'link-local' WHEN doc_id % 8 = 6 THEN 'multicast' END AS blocked FROM documents""")
def url_addresses(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import url_policy

    url = F.expr(f"CASE WHEN doc_id % 50 = 7 THEN 'ftp://' WHEN doc_id % 50 = 9 THEN 'http://u:p@' ELSE 'https://' END || ({_HOST}) || '/a'")
    return url_policy(table(spark, sf, "documents").select("doc_id", url.alias("url")), "url").select("doc_id", "blocked")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 'own' || doc_id END AS owner, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 'rep' END AS repo, CASE WHEN doc_id % 6 = 1 THEN 'v' || doc_id END AS ref FROM documents""")
def repository_addresses(spark: SparkSession, sf: str) -> DataFrame:
    host = "github.com"
    uri = F.expr(f"CASE doc_id % 6 WHEN 0 THEN 'https://{host}/own' || doc_id || '/rep.git' WHEN 1 THEN 'https://{host}/own' || doc_id || '/rep/tree/v' || doc_id WHEN 2 THEN 'git@{host}:own' || doc_id || '/rep.git' WHEN 3 THEN 'https://example.org/own/rep' WHEN 4 THEN 'https://{host}/own' ELSE 'rep' END")
    return table(spark, sf, "documents").select("doc_id", F_.repository(uri).alias("r")).select("doc_id", "r.owner", "r.repo", "r.ref")


_FILE = "CASE doc_id % 9 WHEN 0 THEN 'a/' || doc_id || '.md' WHEN 1 THEN 'a/build/' || doc_id || '.txt' WHEN 2 THEN 'b/README' WHEN 3 THEN 'b/x.PDF' WHEN 4 THEN 'build' WHEN 5 THEN 'a/t.tmp' WHEN 6 THEN 'c/d.tmp/e.docx' WHEN 7 THEN 'docs/z.markdown' ELSE 'src/m.py' END"


@query(f"""SELECT doc_id, doc_id % 9 IN (1, 5, 6) AS ignored, doc_id % 9 IN (0, 2, 7) AS included,
    CASE doc_id % 9 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/pdf' WHEN 6 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 7 THEN 'text/markdown' END AS media_type FROM documents""")
def path_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_FILE).alias("path"))
    return rows.select("doc_id", F_.ignored(p, ["build/", "*.tmp"]).alias("ignored"), F_.glob_match(p, ["*.md", "README", "docs/*"]).alias("included"), F_.media_type(p).alias("media_type"))


@query(f"SELECT path FROM (SELECT {PATH} AS path FROM documents) WHERE path > 'docs/5'")
def resumed_items(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.streaming.incremental import new_items

    return new_items(table(spark, sf, "documents").select(F.expr(PATH).alias("path")), "docs/5", "path")


# -- plans, caches, numbers -------------------------------------------------------------------------

_PARTS = """
    x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS ls FROM documents),
    y AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, trim(unnest(ls)) AS line FROM x),
    s AS (SELECT doc_id, n, line, CASE WHEN n < 3 THEN -1 ELSE n // 3 - 1 END AS section FROM y)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of each document: every third line opens a part, every sixth a subpart before its line."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    part = lambda x, i: F.concat(F.when((i + 1) % 3 == 0, F.concat(F.lit("## Part "), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), F.when((i + 1) % 6 == 5, F.concat(F.lit("### Sub "), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), x)
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# Title\n\n"), F.array_join(F.transform(lines, part), "\n\n")).alias("md"))
    return markdown.normalize(docs, "doc_id", "md")


@query("WITH" + _PARTS + """ SELECT doc_id, section, CASE WHEN section >= 0 THEN 'Part ' || (section + 1) * 3 END AS heading, count(*) + max(CASE WHEN section >= 0 THEN 1 ELSE 0 END) + count(*) FILTER (n % 6 = 5 AND n > 2) AS n_blocks,
        CASE WHEN section >= 0 THEN coalesce(string_agg('Sub ' || n, ' ' ORDER BY n) FILTER (n % 6 = 5), '') END AS subheadings FROM s GROUP BY doc_id, section""")
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = compile.sections(_sections(spark, sf), "doc_id")
    subs = F.when(F.col("section") >= 0, F.array_join(compile.subheadings(F.col("blocks")), " "))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "heading", F.size("blocks").cast("long").alias("n_blocks"), subs.alias("subheadings"))


@query("WITH RECURSIVE" + _PARTS + """,
    lead AS (SELECT doc_id, string_agg(substr(line, 1, 500), chr(10) || chr(10) ORDER BY n) AS text, sum(length(substr(line, 1, 500)) + 2) AS used FROM s WHERE section = -1 AND n <= 3 GROUP BY doc_id),
    e AS (SELECT doc_id, section, '**Part ' || n || '**' AS short, '**Part ' || n || '** — ' || substr(line, 1, 500 - length('**Part ' || n || '** — ')) AS entry FROM s WHERE n % 3 = 0),
    f AS (SELECT doc_id, -1 AS k, coalesce(used, 0) AS used, CAST(NULL AS VARCHAR) AS picked FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN lead USING (doc_id)
          UNION ALL
          SELECT f.doc_id, e.section, CASE WHEN f.used + length(entry) <= 10000 THEN f.used + length(entry) + 2 WHEN f.used + length(short) <= 10000 THEN f.used + length(short) + 2 ELSE f.used END,
                 CASE WHEN f.used + length(entry) <= 10000 THEN entry WHEN f.used + length(short) <= 10000 THEN short END
          FROM f JOIN e ON e.doc_id = f.doc_id AND e.section = f.k + 1),
    g AS (SELECT doc_id, string_agg(picked, chr(10) || chr(10) ORDER BY k) AS body FROM f WHERE picked IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), lead.text, CASE WHEN body IS NOT NULL THEN '# Sections' END, body)) AS digest FROM (SELECT DISTINCT doc_id FROM s) LEFT JOIN lead USING (doc_id) LEFT JOIN g USING (doc_id)""")
def document_digests(spark: SparkSession, sf: str) -> DataFrame:
    return compile.digests(_sections(spark, sf), "doc_id").select("doc_id", F.sha2("digest", 256).alias("digest"))


_PLANS = {0: "[]", 1: '[{"title":"a","sections":[0,1]},{"title":"b","sections":[2]}]', 2: '[{"title":"a","sections":[1,0]},{"title":"b","sections":[2]}]', 3: '[{"title":" ","sections":[0,1,2]}]', 4: '[{"title":"a","sections":[0,2]}]',
          5: '[{"title":"a","sections":[0,2]},{"title":"b","sections":[1]}]', 6: '[{"title":"a","sections":[0,1,2]},{"title":"b","sections":[]}]'}


@query("SELECT doc_id, doc_id % 7 IN (0, 1, 5) AS valid FROM documents")
def plan_checks(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.lit(None).cast("string")
    for k, v in _PLANS.items():
        plan = F.when(F.col("doc_id") % 7 == k, F.lit(v)).otherwise(plan)
    rows = table(spark, sf, "documents").select("doc_id", F.from_json(plan, "array<struct<title:string,sections:array<int>>>").alias("plan"))
    return rows.select("doc_id", compile.plan_valid(F.col("plan"), F.lit(3)).alias("valid"))


_KEY = "sha256(concat_ws(chr(0), sha256(text), 'concept-description', '1', 'stub', '4', '1'))"


@query(f"""
    WITH c AS (SELECT {_KEY} AS key, min('old ' || doc_id) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT doc_id, {_KEY} AS key, coalesce(c.v, 'new ' || doc_id) AS value FROM documents LEFT JOIN c ON c.key = {_KEY}""")
def generated_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", compile.generation_key(F.sha2("text", 256), "concept-description", "stub").alias("key"))
    cache = docs.where("doc_id % 3 = 0").groupBy("key").agg(F.min(F.concat(F.lit("old "), F.col("doc_id").cast("string"))).alias("value"))
    rows, _ = compile.with_cache(docs.withColumn("value", F.concat(F.lit("new "), F.col("doc_id").cast("string"))), cache, "key", "value")
    return rows.select("doc_id", "key", "value")


@query(f"SELECT path, 'source-' || lpad(CAST(row_number() OVER (ORDER BY path) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY path) AS VARCHAR))) AS INTEGER), '0') AS source_id FROM (SELECT {PATH} AS path FROM documents)")
def source_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.source_ids(table(spark, sf, "documents").select(F.expr(PATH).alias("path")), "path")


@query(f"""SELECT path, nth, (SELECT count(*) FROM documents) AS total FROM (SELECT path, row_number() OVER (ORDER BY pos NULLS LAST, path) AS nth FROM (
    SELECT {PATH} AS path, CASE WHEN doc_id % 40 = 7 THEN doc_id * 7 % 1000 END AS pos FROM documents)) WHERE nth <= 25""")
def bundle_contents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    order = docs.where("doc_id % 40 = 7").select(F.expr(PATH).alias("path"), (F.col("doc_id") * 7 % 1000).alias("pos"))
    return bundle.contents(docs.select(F.expr(PATH).alias("path")), order).select("path", F.col("nth").cast("long").alias("nth"), "total")


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, list_transform(v, lambda x: x * (vec_id % 5)) AS v, vec_id % 5 AS k FROM e)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS before, CAST(CASE WHEN k = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS after FROM s""")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5))
    rows = table(spark, sf, "embeddings").select("vec_id", scaled.alias("v"))
    norm = lambda v: F.round(F.sqrt(chunks.dot(v, v)), 4)
    return rows.select("vec_id", norm(F.col("v")).alias("before"), norm(chunks.normalize(F.col("v"))).alias("after"))


# -- excerpts and evaluation ------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _terms(column: str) -> str:
    toks = f"list_filter({_TOK.format(column)}, lambda t: NOT list_contains([{_STOP}], t))"
    return f"list_slice(list_filter({toks}, lambda t, i: list_position({toks}, t) = i), 1, 12)"


@query(f"""
    WITH q AS (SELECT doc_id AS qid, {_terms("split_part(text, chr(10), 1)")} AS terms FROM documents WHERE doc_id % 100 = 0),
    r AS (SELECT qid, terms, doc_id, split_part(text, chr(10), 1) AS title, string_split(text, chr(10)) AS ls FROM q JOIN documents ON doc_id IN (qid, qid + 1, qid + 2)),
    p AS (SELECT qid, terms, doc_id, title, unnest(range(len(ls))) AS pos, trim(unnest(ls)) AS prose FROM r),
    t AS (SELECT *, {_TOK.format('prose')} AS toks FROM p WHERE prose <> ''),
    h AS (SELECT *, len(list_intersect(list_distinct(toks), terms)) AS hits, len(list_filter(toks, lambda x: list_contains(terms, x))) AS occ, len(list_filter(toks, lambda x: NOT list_contains(terms, x))) = 0 AS echo FROM t),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY hits DESC, occ DESC, pos) AS place FROM h WHERE hits > 0 AND NOT echo),
    shaped AS (SELECT qid, doc_id FROM f WHERE place = 1 AND len(terms) > 0 AND len(list_filter(terms, lambda x: NOT list_contains({_TOK.format('title')}, x))) = 0),
    o AS (SELECT qid, doc_id, CASE WHEN place = 1 THEN 0 ELSE 1 END AS tier, place, prose, terms FROM f
          UNION ALL SELECT h.qid, h.doc_id, 2, h.pos + 1000000, prose, terms FROM h JOIN shaped USING (qid, doc_id) WHERE hits = 0 AND len(toks) > 0)
    SELECT qid, 'docs/' || doc_id AS path, tier, place, sha256(trim(substr(prose, 1, 500))) AS excerpt, CASE WHEN tier = 2 THEN 0 ELSE len(list_intersect(list_distinct({_TOK.format('substr(prose, 1, 500)')}), terms)) END AS score FROM o""")
def ranked_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    title = F.substring_index("text", "\n", 1)
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), X.question_terms(title).alias("own_terms"))
    read = q.select("qid", "own_terms", F.col("own_terms").alias("terms"), F.explode(F.array(*[F.concat(F.lit("docs/"), (F.col("qid") + k).cast("string")) for k in range(3)])).alias("path"))
    body = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), title.alias("title"), F.lit(None).cast("string").alias("description"), F.regexp_replace("text", "\n", "\n\n").alias("body"))
    rows = ask.excerpts(read, body, 500)
    return rows.select("qid", "path", "tier", F.col("place").cast("long").alias("place"), F.sha2(F.trim("excerpt"), 256).alias("excerpt"), F.col("score").cast("long").alias("score"))


_RESULTS = """
    r AS (SELECT item_id, c AS condition, item_id % 7 = c % 3 AS abstained, item_id % 5 = 0 AS unanswerable, (item_id + c) % 3 = 0 AS gold, (item_id + c) % 4 = 0 AS seen, item_id % 4 AS warnings, item_id % 3 + c AS calls,
                 item_id * 37 % 1000 AS tokens, item_id * 11 % 700 AS latency, CASE WHEN c = 2 AND item_id % 9 = 1 THEN NULL ELSE item_id % 10 END AS used FROM benchmark, (SELECT unnest([1, 2]) AS c))"""


@query("WITH" + _RESULTS + """ SELECT condition, count(*) AS questions, count(*) FILTER (NOT abstained) AS answered, count(*) FILTER (abstained) AS abstained, count(*) FILTER (gold) AS gold_hits, count(*) FILTER (seen) AS retrieval_hits,
        count(*) FILTER (unanswerable = abstained) AS appropriate, CAST(sum(warnings) AS BIGINT) AS warnings, round(avg(calls), 6) AS mean_tool_calls, CAST(floor(quantile_cont(tokens, 0.5)) AS BIGINT) AS median_tokens,
        CAST(floor(quantile_cont(latency, 0.5)) AS BIGINT) AS median_latency_ms, CASE WHEN bool_or(used IS NULL AND NOT abstained) THEN NULL ELSE round(sum(CASE WHEN abstained THEN 0.0 ELSE (used * 1000 * 3.0 + used * 100 * 15.0) / 1000000 END), 6) END AS cost_usd,
        count(*) FILTER (tokens > 900) AS exhausted FROM r GROUP BY condition""")
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("condition"))
    i, c = F.col("item_id"), F.col("condition")
    used = F.when((c == 2) & (i % 9 == 1), F.lit(None).cast("long")).otherwise(i % 10)
    gold = F.array(F.concat(F.lit("g"), ((i + c) % 3).cast("string")))
    rows = items.withColumn("abstained", i % 7 == c % 3).select(
        "condition", "abstained", evaluate.appropriate(F.when(i % 5 == 0, "unanswerable").otherwise("lookup"), F.col("abstained")).alias("appropriate"), evaluate.gold_hit(gold, F.array(F.lit("g0"), F.lit("x"))).alias("gold_hit"),
        evaluate.gold_hit(F.array(((i + c) % 4).cast("string")), F.array(F.lit("0"))).alias("retrieval_hit"), (i % 4).alias("warnings"), (i % 3 + c).alias("tool_calls"), (i * 37 % 1000).alias("spent_tokens"), (i * 11 % 700).alias("latency_ms"),
        F.when(F.col("abstained"), F.lit(0.0)).otherwise(evaluate.cost(used * 1000, used * 100, 3.0, 15.0)).alias("cost_usd"), (i * 37 % 1000 > 900).alias("exhausted"))
    out = evaluate.summary(rows)
    return out.withColumn("mean_tool_calls", F.round("mean_tool_calls", 6)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def conversation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as log lines and read back."""
    from marlstone.sources.records import parse_turns

    rows = table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.when(F.col("role").isin("user", "assistant"), F.lit("turn")).otherwise(F.lit("meta")).alias("type"), "role", "text"))
    return parse_turns(rows.select("conv_id", "turn", line.alias("line"))).select("conv_id", "turn", "role", "text")


_TITLE = "split_part(text, chr(10), 1)"


#: The bundle that is asked: a file for each document, with one link each; its postings and paragraphs.
_ASKED = f"""
    d AS (SELECT doc_id AS i, 'docs/' || doc_id || '.md' AS path, {_TITLE} AS title, lang, text, (SELECT count(*) FROM documents) AS n FROM documents),
    tk AS MATERIALIZED (SELECT path, {_TOK.format('title')} AS tt, {_TOK.format('lang')} AS tl, {_TOK.format('text')} AS tx FROM d),
    w AS (SELECT path, unnest(list_concat(list_transform(tt, lambda t: {{'t': t, 'w': 5.0::DOUBLE}}), list_transform(tl, lambda t: {{'t': t, 'w': 2.0::DOUBLE}}), list_transform(tx, lambda t: {{'t': t, 'w': 1.0::DOUBLE}}))) AS x,
                 len(tt) + len(tl) + len(tx) AS dl FROM tk),
    p AS (SELECT path, dl, x.t AS term, sum(x.w) AS f FROM w GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(tt) + len(tl) + len(tx)) AS avgdl FROM tk),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    e AS (SELECT path AS src, 'docs/' || ((i * 3 + 1) % n) || '.md' AS dst, title AS anchor FROM d),
    pa AS (SELECT path, title, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS prose FROM d),
    pt AS MATERIALIZED (SELECT *, {_TOK.format('prose')} AS toks FROM pa WHERE prose <> '')"""
#: Search hits of ``q(qid, own)``.
_HITS = """
    qt AS (SELECT qid, unnest(own) AS term FROM q),
    sc AS (SELECT qid, path, round(sum(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, path),
    hits AS MATERIALIZED (SELECT qid, path, score, row_number() OVER (PARTITION BY qid ORDER BY score, path) AS rank FROM sc QUALIFY rank <= 10)"""
#: What is followed from ``seeds(qid, path, pos)``; {0} tells rounds of a conversation apart.
_FOLLOWED = """
    ht{0} AS (SELECT qid, dst AS path, src AS via, anchor, pos, row_number() OVER (PARTITION BY qid, dst ORDER BY pos) AS nth FROM seeds{0} JOIN e ON seeds{0}.path = src WHERE (qid, dst) NOT IN (SELECT (qid, path) FROM seeds{0})),
    hop{0} AS (SELECT qid, path, via, anchor, pos, row_number() OVER (PARTITION BY qid ORDER BY pos, path) AS hop FROM ht{0} WHERE nth = 1 QUALIFY hop <= 4)"""
#: The best excerpts of what was read, and what is cited.
_EVIDENCE = f"""
    rd{{0}} AS (SELECT qid, path, pos AS nav, own, own AS terms FROM seeds{{0}} JOIN q USING (qid)
           UNION ALL SELECT qid, path, hop + 1000, own, list_concat(own, list_filter({_terms('anchor')}, lambda t: NOT list_contains(own, t))) FROM hop{{0}} JOIN q USING (qid)),
    h{{0}} AS (SELECT qid, path, nav, own, terms, title, pos, prose, toks, len(list_intersect(list_distinct(toks), terms)) AS hits, len(list_filter(toks, lambda x: list_contains(terms, x))) AS occ,
                 len(list_filter(toks, lambda x: NOT list_contains(terms, x))) = 0 AS echo FROM rd{{0}} JOIN pt USING (path)),
    f{{0}} AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY hits DESC, occ DESC, pos) AS place FROM h{{0}} WHERE hits > 0 AND NOT echo),
    shaped{{0}} AS (SELECT qid, path FROM f{{0}} WHERE place = 1 AND len(own) > 0 AND len(list_filter(own, lambda x: NOT list_contains({_TOK.format('title')}, x))) = 0),
    o{{0}} AS (SELECT qid, path, nav, own, title, CASE WHEN place = 1 THEN 0 ELSE 1 END AS tier, place, trim(substr(prose, 1, 500)) AS excerpt FROM f{{0}}
          UNION ALL SELECT h{{0}}.qid, h{{0}}.path, nav, own, title, 2, h{{0}}.pos + 1000000, trim(substr(prose, 1, 500)) FROM h{{0}} JOIN shaped{{0}} USING (qid, path) WHERE hits = 0 AND len(toks) > 0),
    r{{0}} AS (SELECT *, CASE WHEN tier = 2 THEN 0 ELSE len(list_intersect(list_distinct({_TOK.format('excerpt')}), own)) END AS score FROM o{{0}}),
    k{{0}} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier < 2 THEN -score ELSE 0 END, nav, place) AS nth FROM r{{0}} QUALIFY nth <= 4),
    a{{0}} AS MATERIALIZED (SELECT qid, count(*) AS n, string_agg('- ' || coalesce(nullif(trim(title), ''), path) || ': ' || excerpt || ' [' || path || ']', chr(10) ORDER BY nth) AS said, list(path ORDER BY nth) AS paths FROM k{{0}} GROUP BY qid)"""


def _round(sql: str, k: int | str = "") -> str:
    return sql.replace("{0}", str(k))


_WANTED = "coalesce(nullif(array_to_string(list_sort(own), ', '), ''), 'the question topic')"
_GAP = f"""CASE WHEN closest IS NOT NULL THEN 'Insufficient evidence in this bundle to answer. The closest match is ' || closest || ', but it does not address: ' || {_WANTED} || '. A concept covering ' || {_WANTED} || ' would resolve the gap.'
                       ELSE 'Insufficient evidence in this bundle to answer. No concept mentions: ' || {_WANTED} || '. Adding a source about ' || {_WANTED} || ' would resolve the gap.' END"""
_CITED = "CASE WHEN paths IS NOT NULL THEN array_to_string(list_filter(paths, lambda x, i: list_position(paths, x) = i), ' ') END"


def _asked_bundle(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents and links of the bundle that is asked."""
    rows = table(spark, sf, "documents")
    n = rows.count()
    path = lambda x: F.concat(F.lit("docs/"), x.cast("string"), F.lit(".md"))
    text, none, title = F.lit(None).cast("string"), F.array().cast("array<string>"), F.substring_index("text", "\n", 1)
    docs = rows.select(path(F.col("doc_id")).alias("path"), title.alias("title"), text.alias("description"), F.array("lang").alias("tags"), F.regexp_replace("text", "\n", "\n\n").alias("body"), F.lit("draft").alias("status"),
                       text.alias("stale_after"), F.array().cast("array<struct<by:string,at:string>>").alias("verified"), none.alias("resources"))
    return docs, rows.select(path(F.col("doc_id")).alias("src"), path((F.col("doc_id") * 3 + 1) % n).alias("dst"), title.alias("anchor"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(f"""
    WITH {_ASKED}, q AS (SELECT item_id AS qid, {_terms('text')} AS own FROM benchmark), {_HITS},
    seeds AS (SELECT qid, path, rank AS pos FROM hits WHERE rank <= 4), {_round(_FOLLOWED)}, {_round(_EVIDENCE)},
    c AS (SELECT qid, path AS closest FROM seeds WHERE pos = 1)
    SELECT qid, a.n IS NULL AS abstained, {_CITED} AS citations,
           sha256(CASE WHEN a.n IS NOT NULL THEN 'Based on ' || a.n || ' passage(s) retrieved from the bundle:' || chr(10) || said ELSE {_GAP} END) AS answer,
           CAST(2 + coalesce((SELECT count(*) FROM rd WHERE rd.qid = q.qid), 0) + 2 * coalesce((SELECT count(*) FROM seeds WHERE seeds.qid = q.qid), 0) AS BIGINT) AS tool_calls
    FROM q LEFT JOIN a USING (qid) LEFT JOIN c USING (qid)""")
def ask_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs, edges = _asked_bundle(spark, sf)
    out = ask.answer(_items(spark, sf), docs, edges)
    return out.select("qid", "abstained", F.array_join("citations", " ").alias("citations"), F.sha2("answer", 256).alias("answer"), F.col("tool_calls").cast("long").alias("tool_calls"))


#: Tokens that a question may spend, the overview's and search's included.
TRACED = 12_000
_J = "length(CAST(to_json({0}) AS VARCHAR))"
_HIST = "(SELECT coalesce(sum(length(CAST(to_json(v) AS VARCHAR)) + 2 + length(CAST(c AS VARCHAR))) + 2 * (count(*) - 1), 0) + 2 FROM (SELECT {0} AS v, count(*) AS c FROM d GROUP BY 1))"
_BODY = "replace(text, chr(10), chr(10) || chr(10))"
_MATTER_CHARS = f"(length('{{\"title\": , \"tags\": [], \"status\": \"draft\"}}') + {_J.format('title')} + {_J.format('lang')})"


@query(f"""
    WITH {_ASKED}, b AS (SELECT path, title, {_BODY} AS body, {_MATTER_CHARS} AS matter FROM d), q AS (SELECT item_id AS qid, text, {_terms('text')} AS own FROM benchmark), {_HITS},
    seeds AS (SELECT qid, path, rank AS pos FROM hits WHERE rank <= 4), {_round(_FOLLOWED)},
    ins AS (SELECT dst AS path, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src) AS nth, count(*) OVER (PARTITION BY dst) AS total FROM e),
    pr AS (SELECT path, length('{{"path": , "frontmatter": , "body_start": , "body_lines_total": , "truncated": }}') + {_J.format('path')} + matter
                  + {_J.format("substr(array_to_string(string_split(body, chr(10))[1:20], chr(10)), 1, 8000)")} + length(CAST(len(string_split(body, chr(10))) AS VARCHAR))
                  + CASE WHEN len(string_split(body, chr(10))) > 20 OR length(substr(array_to_string(string_split(body, chr(10))[1:20], chr(10)), 1, 8000)) < length(body) THEN 4 ELSE 5 END AS peek,
                  length('{{"path": , "frontmatter": , "body": , "chars": , "start_char": 0, "body_total_chars": , "next_start": , "truncated": , "links": [], "stale_after": null, "stale": false}}')
                  + {_J.format('path')} + matter + {_J.format('substr(body, 1, 40000)')} + length(CAST(least(length(body), 40000) AS VARCHAR)) + length(CAST(length(body) AS VARCHAR))
                  + CASE WHEN length(body) > 40000 THEN 5 + 4 ELSE 4 + 5 END AS read,
                  length('{{"path": , "outbound": [], "inbound": [], "outbound_total": 1, "inbound_total": }}') + {_J.format('path')} + (SELECT sum({_J.format('dst')}) FROM e WHERE src = b.path)
                  + coalesce((SELECT sum({_J.format('other')} + 2) - 2 FROM ins WHERE ins.path = b.path AND nth <= 16), 0) + length(CAST(coalesce((SELECT max(total) FROM ins WHERE ins.path = b.path), 0) AS VARCHAR)) AS edges FROM b),
    ov AS (SELECT length('{{"title": "Documents", "description": null, "revision_id": null, "revision_pinned": false, "counts": {{"concepts": , "references": 0}}, "contents": , "contents_total": , "types": {{}}, "tags": , "trust": {{"statuses": , "verified": 0, "unverified": }}, "freshness": {{"stale": 0}}}}')
                  + 3 * length(CAST((SELECT count(*) FROM d) AS VARCHAR)) + {_HIST.format('lang')} + {_HIST.format("'draft'")}
                  + (SELECT sum(length('{{"path": , "title": , "type": null, "description": null}}') + {_J.format('path')} + {_J.format('title')}) + 2 * (count(*) - 1) + 2 FROM (SELECT * FROM d ORDER BY path LIMIT 25)) AS chars),
    sp AS (SELECT q.qid, length('{{"query": , "results": []}}') + {_J.format('any_value(q.text)')}
                  + coalesce(sum(length('{{"path": , "kind": "concept", "title": , "description": "", "snippet": , "score": }}') + {_J.format('b.path')} + {_J.format('b.title')} + {_J.format('substr(b.body, 1, 200)')} + length(CAST(score AS VARCHAR)) + 2) - 2, 0) AS chars
           FROM q LEFT JOIN hits USING (qid) LEFT JOIN b USING (path) GROUP BY q.qid),
    lg AS (SELECT qid, [0, 0, 0] AS o, 'overview' AS tool, NULL AS path, chars FROM q, ov UNION ALL SELECT qid, [1, 0, 0], 'search', NULL, chars FROM sp
           UNION ALL SELECT qid, [2, pos, 0], 'peek', path, peek FROM seeds JOIN pr USING (path) UNION ALL SELECT qid, [3, pos, 0], 'read', path, read FROM seeds JOIN pr USING (path)
           UNION ALL SELECT qid, [4, pos, 0], 'links', path, edges FROM seeds JOIN pr USING (path)
           UNION ALL SELECT qid, [4, hop.pos, 1], 'read', path, read FROM hop JOIN pr USING (path)
           UNION ALL SELECT s.qid, [4, s.pos, 1], '', e.dst, 0 FROM seeds s JOIN e ON s.path = e.src WHERE (s.qid, s.path) NOT IN (SELECT (qid, via) FROM hop)),
    rn AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY qid ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lg),
    md AS (SELECT *, o[1] < 2 OR (CASE WHEN before = 0 THEN 0 ELSE greatest(1, before // 4) END) < {TRACED} AS made FROM rn),
    ex AS (SELECT *, max(made) FILTER (tool = 'links') OVER (PARTITION BY qid, o[1], o[2]) AS reached FROM md),
    fl AS (SELECT *, coalesce(max(NOT made AND tool <> 'links' AND (o[1] < 4 OR reached)) OVER (PARTITION BY qid), false) AS exhausted FROM ex)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) AS nth, tool, path, CAST(chars AS BIGINT) AS chars, CAST(before + chars AS BIGINT) AS spent, exhausted FROM fl WHERE made AND tool <> ''""")
def ask_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of every benchmark question under a budget that some exceed, each with its price."""
    docs, edges = _asked_bundle(spark, sf)
    items, docs = _items(spark, sf), navigate.matter_of(docs)
    found = materialize(ask.search_hits(items, docs).withColumn("kind", bundle.kind(F.col("path"))), "found")
    seeds = materialize(navigate.candidates(found, ask.Policy().reads), "candidates")
    searched = navigate.search_prices(items, found, docs, ask.lead)
    calls = navigate.call_log(items.select("qid"), seeds, searched, docs, edges, ask.Policy().fanout, TRACED, navigate.overview_price(docs, "Documents"))
    return calls.select("qid", F.col("nth").cast("long").alias("nth"), "tool", "path", "chars", "spent", "exhausted")


#: The most user turns of a conversation that the oracle follows; the query follows all there are.
ROUNDS = 4


def _rounds() -> str:
    """One round for each turn: carried citations and hits make its seeds, its evidence what is carried on."""
    out = []
    for k in range(1, ROUNDS + 1):
        before = f"SELECT conv_id || '#{k}' AS qid, unnest(list_filter(paths, lambda x, i: list_position(paths, x) = i)[1:2]) AS path, unnest(range(1, 3)) AS rk FROM a{k - 1} JOIN q USING (qid)" if k > 1 else "SELECT qid, path, 0 AS rk FROM hits WHERE false"
        out.append(f"""
    ca{k} AS (SELECT qid, path, rk FROM ({before}) WHERE path IS NOT NULL),
    cd{k} AS (SELECT qid, path, min(rk) AS rk FROM (SELECT * FROM ca{k} WHERE qid IN (SELECT qid FROM q) UNION ALL SELECT qid, path, 1000 + rank FROM hits JOIN q USING (qid) WHERE nth = {k}) GROUP BY ALL),
    seeds{k} AS MATERIALIZED (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY rk) AS pos, rk < 1000 AS carried FROM cd{k} QUALIFY pos <= 4),{_round(_FOLLOWED, k)},{_round(_EVIDENCE, k)}""")
    return ",".join(out)


_EVERY = " UNION ALL ".join(
    f"""SELECT q.*, a{k}.n, said, paths, (SELECT path FROM seeds{k} s WHERE s.qid = q.qid AND pos = 1) AS closest, (SELECT string_agg(path, ' ' ORDER BY pos) FROM seeds{k} s WHERE s.qid = q.qid AND carried) AS kept,
        2 + coalesce((SELECT count(*) FROM rd{k} x WHERE x.qid = q.qid), 0) + 2 * coalesce((SELECT count(*) FROM seeds{k} s WHERE s.qid = q.qid), 0) AS calls FROM q LEFT JOIN a{k} USING (qid) WHERE nth = {k}"""
    for k in range(1, ROUNDS + 1)
)


@query(f"""
    WITH {_ASKED}, q AS (SELECT conv_id || '#' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS qid, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, {_terms('text')} AS own
                         FROM conversations WHERE role = 'user' AND trim(text) <> ''), {_HITS},{_rounds()}
    SELECT conv_id, turn, n IS NULL AS abstained, {_CITED} AS citations, coalesce(kept, '') AS carried, CAST(calls AS BIGINT) AS tool_calls,
           sha256(CASE WHEN n IS NULL THEN {_GAP} WHEN nth = 1 THEN 'Based on ' || n || ' passage(s) retrieved from the bundle:' || chr(10) || said
                       ELSE 'Based on ' || n || ' passage(s) and ' || least(nth - 1, 4) || ' prior turn(s):' || chr(10) || said END) AS answer
    FROM ({_EVERY})""")
def conversation_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn of every conversation answered, each beginning with what the answer before it cites."""
    docs, edges = _asked_bundle(spark, sf)
    out = conversation.answers(conversation.questions_of(table(spark, sf, "conversations")), docs, edges)
    return out.select("conv_id", "turn", "abstained", F.array_join("citations", " ").alias("citations"), F.array_join("carried", " ").alias("carried"), F.col("tool_calls").cast("long").alias("tool_calls"), F.sha2("answer", 256).alias("answer"))


@query("""
    WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS ls FROM documents)
    SELECT doc_id FROM x WHERE 3 + list_sum(list_transform(ls, lambda l: length(rtrim(l)))) + list_sum(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i % 2 = 0 THEN length('Sub ' || i) ELSE 0 END)) > 6000 AND len(ls) // 2 >= 3 AND doc_id % 4 <> 0""")
def split_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one part with a subpart before every second line; a fourth of them have a preamble."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    part = lambda x, i: F.concat(F.when((i + 1) % 2 == 0, F.concat(F.lit("### Sub "), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), x)
    head = F.when(F.col("doc_id") % 4 == 0, "Before.\n\n## One\n\n").otherwise("## One\n\n")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(head, F.array_join(F.transform(lines, part), "\n\n")).alias("md"))
    return compile.should_split(compile.sections(markdown.normalize(docs, "doc_id", "md"), "doc_id"), "doc_id")
