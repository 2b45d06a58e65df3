"""Every registered query over a small folder with nulls, repeated ids, ties, clashing columns, and over an empty one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from marlstone.llm import registry
from tests.llm.test_page_and_quality_operators import brute_counts
from tests.llm.test_search_and_join import brute_join, brute_search
from tests.llm.test_text_operators import TEXTS, brute_components

P = pytest.importorskip("public_tokenizers")
Q = registry.QUERIES
rnd = random.Random(11)
WORDS = "the of and river stone market winter letter garden engine der und haus le la maison".split()
COPY = " ".join(rnd.choice(WORDS) for _ in range(80)) + "."
#: Over 200,000 characters, as long as three chunks of any operator's.
VERY = "\n".join(" ".join(rnd.choice(WORDS) + rnd.choice(("", "", ",", "ü")) for _ in range(40)) for _ in range(1100))
LONG = [*TEXTS, COPY, COPY, COPY + " end", VERY, "\n".join(["same line here"] * 40), " ".join(f"Wort{i} und das Haus." for i in range(70)), "!!! ***"]
DOCS = [(i, t, ["en", "de", None][i % 3], "s", 1, 2, "x") for i, t in enumerate(LONG)] + [(3, LONG[3], "en", "s", 1, 2, "x"), (100, COPY, "de", "s", 1, 2, "x"), (100, "Another text under one id.", "de", "s", 1, 2, "x"), (None, "no id", "en", None, None, None, None)]
LABELS = [(i, i % 2, int(i % 4 == 1), 7) for i in range(len(LONG))] + [(None, 1, 1, 7), (3, None, None, 7)]
PAGE = "<html><body><nav><a href=/x>menu</a></nav><article><h1>T{0}</h1><p>Words of page {0} &amp; more.</p></article></body></html>"
PAGES = [(i, f"https://h.example/{i}", PAGE.format(i), "t", "h") for i in range(5)] + [(7, "https://h.example/7", PAGE.format(1), "t", "h"), (7, "https://h.example/7", PAGE.format(1), "t", "h"), (8, None, None, None, None), (9, "nonsense", "", "t", "h"), (None, "https://k.example/", PAGE.format(9), "t", "h")]

ITEMS = [(0, COPY, "x"), (1, "der Haus haus", "x"), (1, LONG[3], "x"), (2, None, None), (3, "", "x"), (None, "stone", "x")]


def write(spark, folder, empty=False):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, fold int")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, tree string, host string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string")
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("benchmark", items)):
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("small")))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), True)


def rows(spark, name, folder):
    return Q[name](spark, folder).collect()


def ids(found, key="doc_id"):
    return sorted((r[key] for r in found), key=lambda x: (x is None, x))


ALL = sorted((d[0] for d in DOCS), key=lambda x: (x is None, x))


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_op1(spark, small):
    got = rows(spark, "op1_language_id", small)
    assert ids(got) == ALL
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] != 100}
    for i, t in enumerate(LONG):
        assert (by[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t


def brute_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op2(spark, small):
    got = rows(spark, "op2_simhash_near_dedup", small)
    fps = [brute_fingerprint(d[1]) for d in DOCS]
    assert sorted(map(str, [(r["doc_id"], r["fingerprint"]) for r in got])) == sorted(map(str, [(d[0], f"{f:016x}") for d, f in zip(DOCS, fps)]))
    root = brute_components(fps, 3)
    least = {}
    for d, r in zip(DOCS, root):
        if d[0] is not None:
            least[r] = min(least.get(r, d[0]), d[0])
    want = {(d[0], f"{f:016x}"): least.get(r) for d, f, r in zip(DOCS, fps, root)}
    assert all(r["component_id"] == want[r["doc_id"], r["fingerprint"]] for r in got)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.no_truncation(), t.no_padding()
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark, small):
    t, want = library("byte_bpe_50k.json"), []
    for d in DOCS:
        x = t.encode(d[1] or "", add_special_tokens=False).ids
        want.append((d[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha(t.decode(x, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in rows(spark, "op3_bpe_round_trip", small))


def test_op4(spark, small):
    want = []
    for page_id, _, html, *_ in PAGES:
        same = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        first = min(same, default=page_id) if len((html or "").encode()) >= 100 else page_id
        revisit = page_id is not None and page_id != first
        want.append((page_id, len((html or "").encode()), sha(html or ""), "revisit" if revisit else "response", first if revisit else None))
    got = rows(spark, "op4_warc_packages", small)
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)


def test_op5(spark, small):
    got = rows(spark, "op5_toxicity", small)
    assert ids(got) == ALL
    for r in got:
        assert 0 <= r["p_toxic"] <= 1 and 0 <= r["p_low_quality"] <= 1
        if r["doc_id"] in (0, 1, 2, len(LONG) - 1):  # null, empty, blank, signs only
            assert not r["toxic"]


def test_op6(spark, small):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = [(d[0], len((d[1] or "").encode()), len(m.encode(d[1] or "")), len(m.encode(d[1] or "")) > 4096) for d in DOCS]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in rows(spark, "op6_token_counts", small))


def test_op7(spark, small):
    t, want = library("word_bpe_49k.json"), []
    for d in DOCS:
        x = t.encode(d[1] or "", add_special_tokens=False).ids + [1]
        want += [(d[0], k, k * 4096, len(x[k * 4096 : k * 4096 + 4096]), zlib.crc32(np.array(x[k * 4096 : k * 4096 + 4096], "<u4").tobytes())) for k in range(-(-len(x) // 4096))]
    got = rows(spark, "op7_best_fit_packing", small)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(w[3] for w in want) // 4096)


def test_op8(spark, small):
    got = rows(spark, "op8_html_extraction", small)
    assert ids(got, "page_id") == ids([{"page_id": p[0]} for p in PAGES], "page_id")
    for r in got:
        n = {7: 1, None: 9}.get(r["page_id"], r["page_id"])
        assert r["text"] == ("" if n in (8,) or r["url"] == "nonsense" else f"T{n}\nWords of page {n} & more.") and r["n_chars"] == len(r["text"])


def test_op9(spark, small):
    got = rows(spark, "op9_document_fingerprints", small)
    assert ids(got) == ALL
    unique = sorted([d for d in DOCS if d[0] is not None and sum(x[0] == d[0] for x in DOCS) == 1], key=lambda d: -d[0])
    by = {r["doc_id"]: r for r in got}
    for a, b in zip(unique, unique[1:]):
        if b[0] == a[0] - 1:
            text, after = a[1] or "", b[1] or ""
            cut = len(text) // 2
            assert by[a[0]]["edited_sha256"] == sha(text[: len(text) - cut] + after[:cut]) and by[a[0]]["n_chars"] == len(text)
    same = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = {d[0]: d[1] or "" for d in unique}
    for i, t in texts.items():
        assert same.setdefault(t, by[i]["fingerprint"]) == by[i]["fingerprint"]
    near = {}  # hundredth ids, by brute force over distinct fingerprints
    all_fp = {int(r["fingerprint"], 16) for r in got}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] % 100 == 0:
            near = sum((int(r["fingerprint"], 16) ^ f).bit_count() <= 3 for f in all_fp)
            assert r["n_within"] == near
        else:
            assert r["n_within"] is None


def test_op10(spark, small):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows(spark, "op10_quality_rules", small)
    assert sorted(str((d[0], *brute_counts(d[1]))) for d in DOCS) == sorted(str((r["doc_id"], *[r[n] for n in names])) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"]) and all(r["kept"] is not None for r in got)


def test_op11(spark, small):
    got = rows(spark, "op11_threshold_search", small)
    want = brute_search([d[:2] for d in DOCS], [i[:2] for i in ITEMS])
    assert want == sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got)


def test_op12(spark, small):
    got = rows(spark, "op12_chosen_path_dedup", small)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got) == brute_join([d[:2] for d in DOCS])


def test_very_long_page(spark, tmp_path):
    html = f"<html><body><nav>menu</nav><article><h1>T</h1>{''.join(f'<p>{line}</p>' for line in VERY.splitlines())}</article></body></html>"
    spark.createDataFrame([(1, "https://h.example/1", html), (2, "https://h.example/2", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(1, len(html.encode()), sha(html), "response", None), (2, len(html.encode()), sha(html), "revisit", 1)]
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, "op4_warc_packages", str(tmp_path))) == want
    assert [r["text"] for r in rows(spark, "op8_html_extraction", str(tmp_path))] == ["T\n" + VERY] * 2


def test_pipeline(spark, small, empty):
    """Nulls, repeated ids, ties, clashing names and a very long text go through all stages; an empty table gives nothing."""
    import corpus_pipeline

    assert len(VERY) > 200_000
    got = corpus_pipeline.run(spark, small).collect()
    t = library("word_bpe_49k.json")
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    texts = {}
    for d in DOCS:
        texts.setdefault(d[0], set()).add(len(t.encode(d[1] or "", add_special_tokens=False).ids) + 1)
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    # what is kept is packed whole, repeated rows each
    single = [d[0] for d in DOCS if d[0] is not None and sum(x[0] == d[0] for x in DOCS) == 1]
    assert all(lengths[i] in texts[i] for i in lengths if i in single)
    copies = [i for i, x in enumerate(LONG) if x in (COPY, COPY + " end")]
    assert len([i for i in copies if i in lengths]) <= 1
    assert corpus_pipeline.run(spark, empty).collect() == []
