"""The jobs as queries: each runs its function twice over the whole tables into a new folder and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import document_feed, site_report
from marlstone.plans.catalog import _CANON, _HREFS, _TITLE, _tok
from marlstone.session import scratch_path


def job1_document_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the passages of its text, as the incremental feed has them after two runs."""
    base = scratch_path(spark, "job1")
    for _ in range(2):
        document_feed.feed(spark, f"{sf}/documents.parquet", f"{base}/feed", f"{base}/checkpoint", state_partitions=16)
    return document_feed.output_of(spark, f"{base}/feed")


def job2_site_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its findings, as the report has them after two runs."""
    base = scratch_path(spark, "job2")
    for _ in range(2):
        site_report.report(spark, f"{sf}/pages.parquet", f"{base}/report")
    return site_report.output_of(spark, f"{base}/report")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_document_feed, job2_site_report)}

ORACLE_SQL = {
    "job1_document_feed": f"""
        WITH RECURSIVE x AS (SELECT DISTINCT sha256(text) AS h, text FROM documents WHERE text IS NOT NULL),
        l AS (SELECT h, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM x),
        p AS (SELECT h, flatten(list_transform(ls, lambda x: list_transform(range((length(x) - 1) // 500 + 1), lambda i: substr(x, i * 500 + 1, 500)))) AS ps FROM l),
        q AS (SELECT h, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p, len(ps) AS n FROM p),
        s AS (SELECT h, i, n, p AS buf, CAST(NULL AS VARCHAR) AS done FROM q WHERE i = 1
              UNION ALL
              SELECT s.h, q.i, s.n, CASE WHEN length(s.buf) + 1 + length(q.p) > 500 THEN q.p ELSE s.buf || chr(10) || q.p END,
                     CASE WHEN length(s.buf) + 1 + length(q.p) > 500 THEN s.buf END
              FROM s JOIN q ON q.h = s.h AND q.i = s.i + 1),
        o AS (SELECT h, i, done AS passage FROM s WHERE done IS NOT NULL UNION ALL SELECT h, i + 1, buf FROM s WHERE i = n),
        c AS (SELECT h, row_number() OVER (PARTITION BY h ORDER BY i) - 1 AS seq, passage, len({_tok('passage')}) AS n_tokens FROM o)
        SELECT doc_id, source, coalesce(lang, 'und') AS lang, sha256(text) AS source_hash, CAST(length(text) AS BIGINT) AS n_chars, seq, passage, n_tokens
        FROM documents LEFT JOIN c ON h = sha256(text)""",
    "job2_site_report": f"""
        WITH d AS (SELECT DISTINCT page_id, url, {_CANON} AS address, coalesce(trim({_TITLE}), '') AS title, sha256(html) AS sha, {_HREFS} AS hs FROM pages),
        e AS (SELECT *, regexp_extract(address, '^([a-z]+://[^/]*)/', 1) AS site, regexp_replace(address, '/$', '') AS place FROM d),
        l AS (SELECT DISTINCT page_id, url, place AS src, site || h AS target, regexp_replace(site || h, '/$', '') AS dst FROM (SELECT *, unnest(hs) AS h FROM e WHERE site <> '')),
        a AS (SELECT sha, min({{'i': page_id, 'u': url}}) AS f FROM e GROUP BY sha),
        b AS (SELECT address, min({{'i': page_id, 'u': url}}) AS f FROM e GROUP BY address),
        f AS (SELECT 'broken-link' AS code, page_id, url, target AS detail FROM l
                  WHERE dst NOT IN (SELECT place FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE starts_with(place, l.dst || '/'))
              UNION ALL SELECT 'orphan', page_id, url, '' FROM e WHERE place NOT IN (SELECT dst FROM l WHERE src <> dst)
              UNION ALL SELECT 'copy', page_id, url, f.u FROM e JOIN a USING (sha) WHERE page_id <> f.i OR url <> f.u
              UNION ALL SELECT 'same-address', page_id, url, f.u FROM e JOIN b USING (address) WHERE page_id <> f.i OR url <> f.u
              UNION ALL SELECT 'missing-title', page_id, url, '' FROM e WHERE trim(title) = '')
        SELECT page_id, url, address, title, CAST(len(hs) AS BIGINT) AS n_links, (SELECT count(*) FROM f WHERE f.page_id = e.page_id AND f.url = e.url) AS n_findings, code, detail
        FROM e LEFT JOIN f USING (page_id, url)""",
}
