"""The query catalog: each query beside DuckDB SQL for the same rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import bundle, chunks, conversation, evaluate, graph, search
from marlstone.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _tok(column: str) -> str:
    return _TOK.format(column)


def _terms(column: str) -> str:
    """First twelve distinct tokens that are no stopwords, as a DuckDB list."""
    toks = f"list_filter({_tok(column)}, lambda t: NOT list_contains([{_STOP}], t))"
    return f"list_slice(list_filter({toks}, lambda t, i: list_position({toks}, t) = i), 1, 12)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- terms and ranking ---------------------------------------------------------------------------

@query(f"SELECT lang, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT lang, unnest({_tok('text')}) AS t FROM documents) GROUP BY lang")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select("lang", F.explode(X.tokens("text")).alias("t")).groupBy("lang", "t").agg(F.count("*").alias("n"))
    return terms.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(f"SELECT t AS term, count(*) AS df FROM (SELECT unnest(list_distinct({_tok('text')})) AS t FROM documents) GROUP BY t ORDER BY df DESC, term LIMIT 50")
def term_df_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.explode(F.array_distinct(X.tokens("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)


@query(f"SELECT item_id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM (SELECT item_id, {_terms('text')} AS terms FROM benchmark)")
def question_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(X.question_terms("text")).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT item_id, array_to_string(list_transform({_terms('text')}, lambda t: '\"' || t || '\"'), ' OR ') AS fts FROM benchmark")
def fts_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", X.fts_query("text").alias("fts"))


def _bm25_sql(fields: str) -> str:
    """BM25 over ``fields``: a list of ``{t: tokens, w: weight}`` structs of a document."""
    return f"""
        WITH d AS (SELECT doc_id, {fields} AS fs FROM documents),
        e AS (SELECT doc_id, unnest(flatten(list_transform(fs, lambda f: list_transform(f.t, lambda x: {{'t': x, 'w': f.w}})))) AS x,
                     list_sum(list_transform(fs, lambda f: len(f.t))) AS dl FROM d),
        p AS (SELECT doc_id, dl, x.t AS term, sum(x.w) AS f FROM e GROUP BY ALL),
        s AS (SELECT count(*) AS n, avg(list_sum(list_transform(fs, lambda f: len(f.t)))) AS avgdl FROM d),
        q AS (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        sc AS (SELECT item_id, doc_id, round(sum(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
                 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
               FROM q JOIN p USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id)
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id) AS rank
        FROM sc QUALIFY rank <= 10"""


@query(_bm25_sql(f"[{{'t': {_tok('text')}, 'w': 1.0::DOUBLE}}]"))
def bm25_unstemmed(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id").withColumn("rank", F.col("rank").cast("long"))


@query(_bm25_sql(f"[{{'t': {_tok('text')}, 'w': 1.0::DOUBLE}}]"))
def bm25_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking from written blocks of postings, which a search passes over where they can't matter."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    blocks = materialize(search.postings_blocks(materialize(search.weigh(docs, "doc_id", {"text": 1.0}), "postings"), "doc_id"), "blocks")
    return search.block_rank(blocks, search.asked_terms(items, "item_id"), "doc_id", "item_id").withColumn("rank", F.col("rank").cast("long"))


@query(_bm25_sql("[{'t': " + _tok("split_part(text, chr(10), 1)") + ", 'w': 5.0::DOUBLE}, {'t': " + _tok("lang || ' ' || source") + ", 'w': 2.0}, {'t': " + _tok("text") + ", 'w': 1.0}]"))
def bm25_fielded(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.concat_ws(" ", "lang", "source").alias("tags"), F.col("text").alias("body"))
    weights = {k: search.FIELD_WEIGHTS[k] for k in ("title", "tags", "body")}
    return search.bm25(docs, table(spark, sf, "benchmark"), "doc_id", "item_id", weights).withColumn("rank", F.col("rank").cast("long"))


@query()
def bm25_porter(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.functions.stem import snippets, stems

    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    hits = search.bm25(docs, items, "doc_id", "item_id", split=stems)
    named = hits.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(items.select("item_id", X.question_terms("text").alias("terms")), "item_id")
    return named.select("item_id", "doc_id", "score", "rank", snippets(F.col("body"), F.col("terms")).alias("snippet"))


@query(f"""
    WITH q AS (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark),
    t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL),
    z AS (SELECT doc_id, count(*) AS k FROM t GROUP BY doc_id),
    h AS (SELECT item_id, doc_id, count(*) AS distinct_hits, CAST(sum(n) AS BIGINT) AS occurrences FROM q JOIN t USING (term) GROUP BY ALL)
    SELECT item_id, doc_id, distinct_hits, occurrences, row_number() OVER (PARTITION BY item_id ORDER BY distinct_hits DESC, occurrences DESC, doc_id) AS rank
    FROM h JOIN z USING (doc_id) WHERE k > distinct_hits QUALIFY rank <= 5""")
def term_overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    return search.overlap_rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH q AS (SELECT doc_id AS other, {_terms("split_part(text, chr(10), 1)")} AS terms FROM documents),
    w AS (SELECT other, len(terms) AS n_terms, unnest(terms) AS term FROM q),
    s AS (SELECT doc_id, unnest(list_distinct({_tok('text')})) AS term FROM documents),
    h AS (SELECT doc_id, other, n_terms, count(*) AS shared FROM s JOIN w USING (term) GROUP BY ALL)
    SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY other) AS nth FROM h
    WHERE doc_id <> other AND (shared = n_terms OR (n_terms >= 3 AND shared >= n_terms - 1)) QUALIFY nth <= 5""")
def title_match_related(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return graph.related(docs, "doc_id", "title", "text").withColumn("nth", F.col("nth").cast("long"))


# -- chunks and vectors --------------------------------------------------------------------------

@query("""
    WITH p AS (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents WHERE regexp_matches(text, '\\S')),
    e AS (SELECT doc_id, unnest(range((length(t) - 1) // 500 + 1)) AS seq, t FROM p)
    SELECT doc_id, seq, length(substr(t, seq * 500 + 1, 500)) AS len, sha256(substr(t, seq * 500 + 1, 500)) AS sha256 FROM e""")
def chunk_hard_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("seq").cast("long"), F.length("chunk").cast("long").alias("len"), F.sha2("chunk", 256).alias("sha256"))


@query("""
    WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
    p AS (SELECT doc_id, flatten(list_transform(ls, lambda x: list_transform(range((length(x) - 1) // 500 + 1), lambda i: substr(x, i * 500 + 1, 500)))) AS ps FROM l),
    q AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p, len(ps) AS n FROM p),
    s AS (SELECT doc_id, i, n, p AS buf, CAST(NULL AS VARCHAR) AS done FROM q WHERE i = 1
          UNION ALL
          SELECT s.doc_id, q.i, s.n, CASE WHEN length(s.buf) + 1 + length(q.p) > 500 THEN q.p ELSE s.buf || chr(10) || q.p END,
                 CASE WHEN length(s.buf) + 1 + length(q.p) > 500 THEN s.buf END
          FROM s JOIN q ON q.doc_id = s.doc_id AND q.i = s.i + 1),
    o AS (SELECT doc_id, i, done AS chunk FROM s WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, buf FROM s WHERE i = n)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, length(chunk) AS len, sha256(chunk) AS sha256 FROM o""")
def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.chunks(table(spark, sf, "documents"), "doc_id", "text", "\n")
    return rows.select("doc_id", F.col("seq").cast("long"), F.length("chunk").cast("long").alias("len"), F.sha2("chunk", 256).alias("sha256"))


_BOW = """
    {0}b AS (SELECT {1}, CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % 256 AS bucket FROM (SELECT {1}, unnest(list_distinct({3})) AS t FROM {2})),
    {0}c AS (SELECT {1}, bucket, count(*) AS n FROM {0}b GROUP BY ALL),
    {0} AS (SELECT {1}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {1})) AS weight FROM {0}c)"""


@query("WITH" + _BOW.format("d", "doc_id", "documents", _tok("text")) + " SELECT doc_id, bucket, round(weight, 6) AS weight FROM d")
def hashed_bow(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks.hashed_bow(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("bucket").cast("long"), F.round("weight", 6).alias("weight"))


@query("WITH" + _BOW.format("d", "doc_id", "documents", _tok("text")) + "," + _BOW.format("q", "item_id", "benchmark", _tok("text")) + """,
    s AS (SELECT item_id, doc_id, round(sum(q.weight * d.weight), 6) AS score FROM q JOIN d USING (bucket) GROUP BY ALL)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 4""")
def bow_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = chunks.hashed_bow(table(spark, sf, "benchmark"), "item_id", "text")
    d = chunks.hashed_bow(table(spark, sf, "documents"), "doc_id", "text")
    return chunks.sparse_topk(q, d, "item_id", "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query("""
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round(list_dot_product(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest five of every vector whose id is divisible by 100, against all vectors."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = chunks.vector_topk(q, e, "query_id", "vec_id", "embedding", 6).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5")


@query("""
    WITH x AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
    m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL)
    SELECT label, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS v FROM m""")
def vector_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "v")).select("label", F.col("i").cast("long"), F.round("v", 6).alias("v"))


@query("SELECT source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000")
def rag_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.budget_prefix(table(spark, sf, "documents"), "source", ["doc_id"], F.length("text"), 20_000).select("source", "doc_id", "running")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.estimate_tokens(F.length("text")).alias("tokens"))


# -- text and pages ------------------------------------------------------------------------------

@query("""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 299) AS head FROM documents),
    k AS (SELECT *, rtrim(regexp_replace(head, ' [^ ]*$', ''), ' ,;:—-') AS kept FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE (CASE WHEN kept = '' THEN head ELSE kept END) || '…' END AS clipped FROM k""")
def clip_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clip_words("text", 300).alias("clipped"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
_SLUG = f"coalesce(nullif(trim(regexp_replace(lower(trim({_TITLE})), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"


@query(f"SELECT page_id, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS unique_slug FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM (SELECT page_id, {_SLUG} AS slug FROM pages))")
def slugify_titles(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import page_title

    rows = table(spark, sf, "pages").select("page_id", X.slugify(page_title(F.col("html"))).alias("slug"))
    return bundle.unique_slugs(rows, "slug", "page_id")


_URL = "regexp_replace(url, '#.*$', '')"
_PART = "regexp_extract(" + _URL + ", '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(\\?.*)?$', {0})"
_CANON = (f"lower({_PART.format(1)}) || '://' || regexp_replace(lower({_PART.format(2)}), CASE WHEN lower({_PART.format(1)}) = 'http' THEN ':80$' ELSE ':443$' END, '') || "
          f"(CASE WHEN {_PART.format(3)} = '' THEN '/' ELSE {_PART.format(3)} END) || {_PART.format(4)}")


@query(f"SELECT page_id, {_CANON} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.canonical_url("url").alias("canonical"))


@query(f"SELECT page_id, trim({_TITLE}) AS title, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (SELECT page_id, html, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS h FROM pages)")
def html_title_links(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import hrefs, page_title

    rows = table(spark, sf, "pages").select("page_id", page_title(F.col("html")).alias("title"), F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    return rows.select("page_id", "title", "href", F.col("pos").cast("long"))


_HREFS = "regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"
_EDGES = f"SELECT DISTINCT {_PATH} AS src, ltrim(unnest({_HREFS}), '/') AS dst FROM pages"


def _page_edges(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.web import hrefs

    src = F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1)
    rows = table(spark, sf, "pages").select(src.alias("src"), F.explode(hrefs(F.col("html"))).alias("target"))
    return rows.select("src", F.ltrim("target", F.lit("/")).alias("dst")).distinct()


@query(f"WITH e AS ({_EDGES}) SELECT path, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY path")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_page_edges(spark, sf))


@query(f"WITH e AS ({_EDGES}), n AS (SELECT DISTINCT {_PATH} AS path FROM pages) SELECT src, dst FROM e WHERE dst NOT IN (SELECT path FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE starts_with(path, e.dst || '/'))")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("rel_path")).distinct()
    return graph.broken_links(_page_edges(spark, sf), files).select("src", "dst")


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT {_PATH} AS path FROM pages WHERE {_PATH} NOT IN (SELECT dst FROM e)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("path")).distinct()
    return graph.orphans(nodes, _page_edges(spark, sf))


@query(f"SELECT page_id, canonical FROM (SELECT page_id, {_CANON} AS canonical FROM pages) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1")
def uri_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", X.canonical_url("url").alias("canonical"))
    return bundle.first_per_key(rows, "canonical", "page_id")


# -- bundle views --------------------------------------------------------------------------------

@query("""
    WITH d AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM d UNION ALL SELECT 'source', source FROM d UNION ALL SELECT 'quality', quality FROM d) GROUP BY ALL""")
def overview_hist(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return bundle.histogram(rows, "lang", "source", "quality")


@query("SELECT doc_id, lang, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE source = 'src3' AND quality = 1) AS total FROM documents JOIN labels USING (doc_id) WHERE source = 'src3' AND quality = 1 ORDER BY doc_id LIMIT 50")
def list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    return bundle.listing(rows, "doc_id", "", F.col("source") == "src3", F.col("quality") == 1).select("doc_id", "lang", "total")


@query("""
    SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[1:20], chr(10)), 1, 8000) AS peek, substr(text, 1001, 1000) AS page,
           CAST(CASE WHEN length(text) > 2000 THEN 2000 END AS INTEGER) AS next_start, length(text) AS total_chars FROM documents""")
def peek_read_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = bundle.read_page(table(spark, sf, "documents"), "text", 1000, 1000).withColumn("peek", bundle.peek(F.col("text")))
    return rows.select("doc_id", "peek", "page", "next_start", F.col("total_chars").cast("long"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


_FILES = "SELECT 'docs/' || doc_id || '.md' AS rel_path, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.col("text").cast("binary").alias("content"))


@query(f"SELECT rel_path, sha256, CAST(bytes AS BIGINT) AS bytes FROM ({_FILES})")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.manifest(_files(spark, sf))


@query("""
    WITH a AS (SELECT 'docs/' || doc_id || '.md' AS p, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
    b AS (SELECT 'docs/' || doc_id || '.md' AS p, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
    SELECT coalesce(a.p, b.p) AS rel_path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.p = b.p WHERE a.h IS DISTINCT FROM b.h""")
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    a = bundle.manifest(files.where("doc_id % 11 <> 0"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("content").cast("string"), F.lit("!")).cast("binary")).otherwise(F.col("content"))
    return bundle.tree_diff(a, bundle.manifest(files.where("doc_id % 7 <> 0").withColumn("content", changed)))


@query("""
    WITH a AS (SELECT 'docs/' || doc_id || '.md' AS p, sha256(text) AS h FROM documents),
    b AS (SELECT 'docs/' || doc_id || '.md' AS p, sha256(CASE WHEN doc_id % 50 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 70 <> 0)
    SELECT p AS rel_path, CASE WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a LEFT JOIN b USING (p) WHERE a.h IS DISTINCT FROM b.h""")
def hash_tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Few changes between two trees of all documents, found by going down their hash trees."""
    files = _files(spark, sf)
    changed = F.when(F.col("doc_id") % 50 == 1, F.concat(F.col("content").cast("string"), F.lit("!")).cast("binary")).otherwise(F.col("content"))
    return bundle.diff_trees(bundle.manifest(files), bundle.manifest(files.where("doc_id % 70 <> 0").withColumn("content", changed)))


@query("SELECT doc_id, 'n' || (doc_id // 3) || CASE doc_id % 3 WHEN 1 THEN '-2' WHEN 2 THEN '-2-2' ELSE '' END AS unique_slug FROM documents")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Three documents a name: two ask for it, a third for the name that the second gets."""
    name = F.concat(F.lit("n"), F.floor(F.col("doc_id") / 3).cast("string"), F.when(F.col("doc_id") % 3 == 2, "-2").otherwise(""))
    return bundle.unique_slugs(table(spark, sf, "documents").select("doc_id", name.alias("slug")), "slug", "doc_id").select("doc_id", "unique_slug")


@query(f"""
    WITH e AS ({_EDGES}), a AS (SELECT * FROM e WHERE length(src) % 3 <> 0), b AS (SELECT * FROM e WHERE length(dst) % 3 <> 0)
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def edge_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = _page_edges(spark, sf)
    return bundle.edge_diff(e.where(F.length("src") % 3 != 0), e.where(F.length("dst") % 3 != 0))


@query("""
    WITH d AS (SELECT 'docs/' || doc_id || '.md' AS path, trim(split_part(text, chr(10), 1)) AS title, text, source FROM documents)
    SELECT 'hygiene/missing-title' AS code, 'warning' AS severity, path FROM d WHERE title = ''
    UNION ALL SELECT 'hygiene/empty-body', 'warning', path FROM d WHERE NOT regexp_matches(text, '\\S')
    UNION ALL SELECT 'quality/large-concept', 'info', path FROM d WHERE length(text) > 5000""")
def lint_findings(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.operators.lint import concept_rules

    some = F.array(F.struct(F.col("source").alias("id"), F.lit(None).cast("string").alias("resource"), F.lit(None).cast("string").alias("title")))
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.lit(True).alias("has_frontmatter"), F.lit("Concept").alias("type"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), some.alias("sources"), F.array().cast("array<string>").alias("bad_sources"), F.lit("draft").alias("status"),
        *[F.lit(False).alias(c) for c in ("status_given", "generated_given", "verified_given", "stale_given")], *[F.lit(True).alias(c) for c in ("generated_valid", "verified_valid", "stale_valid", "sources_given", "sources_list")],
        F.lit("").alias("status_text"), F.lit("").alias("stale_text"))
    rows = concept_rules(docs, 5000)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("code", "severity", "path")


@query("""
    WITH d AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS p, CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 0 THEN 'draft' ELSE 'stable' END AS status, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, p || ': status is draft — content is unreviewed' AS warning FROM d WHERE status = 'draft'
    UNION ALL SELECT doc_id, p || ': status is deprecated — may no longer apply' FROM d WHERE status = 'deprecated'
    UNION ALL SELECT doc_id, p || ': unverified — no verification record' FROM d WHERE quality IS NULL""")
def trust_warnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "draft").otherwise("stable")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("doc_id", F.explode(bundle.trust_warnings(path, status, F.lit(None).cast("string"), F.col("quality").isNotNull(), None)).alias("warning"))


# -- conversations and evaluation ----------------------------------------------------------------

_PAIRS = """
    SELECT conv_id, turn, question, text AS answer FROM (
        SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'assistant' AND before = 'user'"""


@query(_PAIRS)
def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.qa_pairs(table(spark, sf, "conversations"))


@query(f"SELECT conv_id, turn, question, substr(answer, 1, 600) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_PAIRS}) QUALIFY back <= 4")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.recent(conversation.qa_pairs(table(spark, sf, "conversations"))).withColumn("back", F.col("back").cast("long"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id")
def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return conversation.user_turns(table(spark, sf, "conversations"))


@query(_bm25_sql(f"[{{'t': {_tok('text')}, 'w': 1.0::DOUBLE}}]").replace("SELECT item_id, doc_id, score, row_number()", "SELECT k AS condition, count(DISTINCT item_id) AS questions, count(DISTINCT item_id) FILTER (rank <= k AND position(b IN d) > 0) AS gold_hits FROM (SELECT item_id, doc_id, row_number()")
       .replace("QUALIFY rank <= 10", "QUALIFY rank <= 10) JOIN (SELECT item_id, text AS b FROM benchmark) USING (item_id) JOIN (SELECT doc_id, text AS d FROM documents) USING (doc_id), (SELECT unnest([1, 4, 10]) AS k) GROUP BY k"))
def eval_grid(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    ranked = search.bm25(docs, items, "doc_id", "item_id")
    texts = ranked.join(items.select("item_id", F.col("text").alias("b")), "item_id").join(docs.select("doc_id", F.col("text").alias("d")), "doc_id")
    hits = texts.select("item_id", "rank", (F.instr("d", F.col("b")) > 0).alias("hit"))
    rows = hits.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), (F.col("hit") & (F.col("rank") <= k)).alias("ok")) for k in (1, 4, 10)])).alias("x"))
    per = rows.groupBy("item_id", "x.condition").agg(F.bool_or("x.ok").alias("ok"))
    return per.groupBy("condition").agg(F.count("*").alias("questions"), F.count_if("ok").alias("gold_hits"))


@query("SELECT lang, CAST(floor(quantile_cont(n_chars, 0.5)) AS BIGINT) AS median_chars FROM documents GROUP BY lang")
def eval_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(evaluate.median("n_chars").alias("median_chars"))


@query("""
    WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(list_transform(string_split(text, chr(10)), lambda x: rtrim(x))) AS line FROM documents),
    g AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l)
    SELECT doc_id, min(n) AS start_line, sha256(string_agg(line, chr(10) ORDER BY n)) AS sha256 FROM g WHERE line <> '' GROUP BY doc_id, island""")
def para_islands(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.sources.markdown import paragraphs

    rows = paragraphs(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("start_line").cast("long"), F.sha2("paragraph", 256).alias("sha256"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
    WITH d AS (SELECT event_type, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1)
    SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM d
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM d) - INTERVAL 10 MINUTE GROUP BY ALL""")
def events_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The hours of the event stream that are complete, by a stateful stream that runs twice over what is there."""
    from marlstone.session import scratch_path
    from marlstone.streaming.incremental import run_rollup

    base, out = scratch_path(spark, "events-feed"), None
    for _ in range(2):
        out = run_rollup(spark, f"{sf}/events.parquet", f"{base}/out", f"{base}/checkpoint", "event_id long, ts timestamp, event_type string, value double", time="ts", key="event_id", groups=["event_type"], value="value")
    return out


@query()
def compiled_bundle(spark: SparkSession, sf: str) -> DataFrame:
    from marlstone.operators.compile import compile_bundle
    from marlstone.sources.web import html_blocks as parse

    pages = table(spark, sf, "pages")
    # what else is known of a page goes with its id, so blocks aren't shuffled for it
    known = F.struct("page_id", X.canonical_url("url").alias("uri"), F.sha2("html", 256).alias("source_hash"))
    docs = parse(pages.where("page_id is not null").withColumn("page", known), "page", "url", "html")
    out = compile_bundle(docs.select("page.uri", "page.source_hash", F.lit("1970-01-01T00:00:00Z").alias("retrieved_at"), "title", "blocks"), "Pages")
    return out.select("rel_path", F.sha2("content", 256).alias("sha256"))


def _register_bundles() -> None:
    from marlstone.plans import bundles, texts

    for module in (bundles, texts):
        QUERIES.update(module.QUERIES)
        ORACLE_SQL.update(module.ORACLE_SQL)


_register_bundles()
