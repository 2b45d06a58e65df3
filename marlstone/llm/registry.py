"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.llm.bpe import op3_bpe_round_trip
from marlstone.llm.chosen_path import op12_chosen_path_dedup
from marlstone.llm.fingerprints import op9_document_fingerprints
from marlstone.llm.html_extract import op8_html_extraction
from marlstone.llm.language import op1_language_id
from marlstone.llm.packing import op7_best_fit_packing
from marlstone.llm.quality import op10_quality_rules
from marlstone.llm.simhash import op2_simhash_near_dedup
from marlstone.llm.threshold_search import op11_threshold_search
from marlstone.llm.token_counts import op6_token_counts
from marlstone.llm.toxicity import op5_toxicity
from marlstone.llm.warc import op4_warc_packages

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_simhash_near_dedup,
        op3_bpe_round_trip,
        op4_warc_packages,
        op5_toxicity,
        op6_token_counts,
        op7_best_fit_packing,
        op8_html_extraction,
        op9_document_fingerprints,
        op10_quality_rules,
        op11_threshold_search,
        op12_chosen_path_dedup,
    )
}

ORACLE_SQL = {
    "op4_warc_packages": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        m AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
            FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM m
    """,
    "op11_threshold_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        i AS (
            SELECT row_number() OVER () AS q, item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark),
        c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
        a AS (SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS qtf FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
        p AS (
            SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
            FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
            WHERE term IN (SELECT term FROM a) GROUP BY ALL),
        f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
        s AS (
            SELECT q, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
            FROM a JOIN p USING (term) JOIN w USING (term), c GROUP BY q, item_id, r, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
        WHERE rank <= 10
    """,
}
