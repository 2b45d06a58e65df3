"""The threshold search and the chosen-path join against brute force."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from marlstone.llm import chosen_path as cp
from marlstone.llm import threshold_search as ts

rnd = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in "stone river market winter lamp".split() for b in range(60)] + "the of and in to".split() * 30


def words(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def fresh(n):
    return " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))


# -- threshold search ----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=10):
    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    split = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, total, df = sum(map(bool, split)), sum(map(len, split)), Counter(t for s in split for t in set(s))
    counts, out = [Counter(s) for s in split], []
    for item, text in items:
        found = []
        for (doc_id, _), c, s in zip(docs, counts, split):
            score = 0
            for t in TERM.findall(lower(text)):
                if c[t]:
                    m = 25 + (75 * len(s) * n_docs) // total
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(map(str, out))


ODD = [(None, "stone1 river2"), (7, None), (8, ""), (9, " .,! "), (10, "ÄRGER straße Été 漢字"), (11, "ÄRGER STRASSE"), (12, "stone1"), (12, "stone1"), (12, "stone1 stone1 lamp4"), (5, "stone1"), (13, words(30_000))]


def made_docs(n):
    return [(100 + i, words(rnd.choice((3, 20, 90)))) for i in range(n)] + ODD


def searched(spark, docs, items):
    d = spark.createDataFrame([(*x, "c", "c") for x in docs], "doc_id long, text string, term string, score string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted(str(tuple(r)) for r in ts.search(d, i).collect())


ITEMS = [(1, words(12)), (2, "STONE1 stone1 the"), (3, None), (4, "?!"), (5, "unheard"), (2, "straße ÄRGER"), (None, "river2 river2 of"), (9, words(400))]


def test_search_equals_brute_force(spark):
    docs = made_docs(400)
    assert searched(spark, docs, ITEMS) == brute_search(docs, ITEMS)


def test_question_blocks_do_not_matter(spark, monkeypatch):
    docs = made_docs(60)
    whole = searched(spark, docs, ITEMS)
    blocks = ts.question_blocks
    monkeypatch.setattr(ts, "question_blocks", lambda *a: blocks(*a, most=2, most_terms=20))
    assert searched(spark, docs, ITEMS) == whole == brute_search(docs, ITEMS)


def test_search_of_nothing(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, made_docs(3), []) == []


def test_the_threshold_stops_before_the_lists_end():
    """Rare terms decide, so a common term's list isn't read to its end; the bar of earlier batches stops it sooner."""
    n = 20_000
    term = [[0] if i % 2 else [0, 1] if i % 500 == 0 else [1] for i in range(n)]
    start = np.concatenate(([0], np.cumsum([len(t) for t in term])))
    flat = np.concatenate(term)
    lists = ts.Lists(start, flat, np.where(flat == 1, 1000 + np.arange(len(flat)) % 700, 10), 3)
    docs, scores, looked = lists.search(np.array([0, 1, 2]), np.array([1, 1, 1]), 0, False, 10)
    whole = [sum((1000 + k % 700) if f == 1 else 10 for k, f in zip(range(start[i], start[i + 1]), t)) for i, t in enumerate(term)]
    assert sorted(scores)[-10:] == sorted(whole)[-10:] and looked < n / 4
    assert lists.search(np.array([0, 1, 2]), np.array([1, 1, 1]), 5000, True, 10)[2] <= 2 * ts.FIRST


# -- chosen paths --------------------------------------------------------------------------------


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute_join(docs, least=85):
    sets = [brute_sets(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(str((d, len(sets[i]), c := first.get(find(i)), d == c)) for i, (d, _) in enumerate(docs))


def joined(spark, docs, **how):
    df = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, key string, size int").repartition(3)
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in cp.near_duplicates(df, **how).collect())


def edited(text, share):
    w = text.split()
    for i in rnd.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = fresh(1)
    return " ".join(w)


def families(n, each):
    """Texts with copies whose likeness lies on both sides of the least one."""
    texts = []
    for _ in range(n):
        base = fresh(rnd.choice((40, 120, 300)))
        texts += [base, base.upper()] + [edited(base, rnd.choice((0.01, 0.02, 0.025, 0.03, 0.05))) for _ in range(each)]
        texts += [base + " " + fresh(len(base.split()) // k) for k in (6, 7, 8)]
    return texts


def test_join_equals_brute_force(spark):
    texts = families(30, 8) + [words(60) for _ in range(60)] + ["one", "ONE", "one two", "one two three", None, "", "  \n", None, words(40_000)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(3, texts[3]), (3, texts[40]), (None, texts[0]), (None, None), (-5, texts[17])]
    rnd.shuffle(docs)
    assert joined(spark, docs) == brute_join(docs)


def test_branching_loses_nothing(spark):
    """Nodes of six documents at most: large families are branched and, where that parts nothing, dealt in blocks."""
    shared = fresh(30)
    texts = families(2, 90) + [f"{shared} {fresh(60)}" for _ in range(150)]
    docs = list(enumerate(texts))
    assert joined(spark, docs, small=6) == brute_join(docs) == joined(spark, docs)


def test_join_of_nothing(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(None, "a b c d")]) == [str((None, 2, None, True))]


def test_equal_texts_without_an_id_stay_apart(spark):
    assert joined(spark, [(1, "a b c d e"), (None, "a b c d e"), (None, "a b c d e")]) == sorted([str((1, 3, 1, True)), *[str((None, 3, None, True))] * 2])


def test_trees_and_sketches_keep_what_they_promise():
    """Pairs of the least likeness: how often a tree parts them, and how often their sketches fall below what is needed."""
    parted, below, trials, need = 0, 0, 400, cp.sketch_need()
    for _ in range(trials):
        common, rest = np.random.default_rng(rnd.randrange(1 << 30)).integers(-(1 << 62), 1 << 62, 1850), 150
        a, b = common[: 1850 - rest], np.concatenate((common[rest : 1850 - rest], common[1850 - rest :]))
        m = cp.minwise([np.unique(a), np.unique(b)])
        parted += (m[0] != m[1]).mean()
        below += ((m[0, : cp.SKETCH] & 255) == (m[1, : cp.SKETCH] & 255)).sum() < need
    s = 1 - parted / trials
    assert abs(s - 1550 / 1850) < 0.01 and below == 0
    assert cp.trees_for(0.85, 0.999999) == 8 and cp.trees_for(0.85, 0.9) == 2 and cp.trees_for(0.5, 0.99) > 8


def test_counts_never_reject_a_link():
    find, rejected = cp._apart(0.85), 0
    for n in (4, 30, 400, 9000):
        a = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        for cut in range(0, int(0.15 * n) + 1, max(1, n // 40)):
            sets = [a, a[cut:]]
            m = (cp.minwise(sets)[:, : cp.SKETCH] & 255).astype(np.uint8)
            m[1] = m[0]  # the sketch decides nothing here
            cells = np.array([np.frombuffer(cp.cell_counts(x), np.uint8) for x in sets])
            i, _ = find({"size": np.array([len(x) for x in sets]), "label": np.array([1, 2]), "side": np.array([0, 0])}, m, cells)
            rejected += len(i) != 1
    assert rejected == 0


def test_a_block_cut_by_batches_stays_whole(spark):
    rows = [(b, c, bytes(cp.SKETCH), bytes(cp.CELLS)) for b in range(40) for c in range(b * 100, b * 100 + 1 + b % 7)]
    df = spark.createDataFrame(rows, "block long, cid long, sketch binary, cells binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = cp._in_blocks(df, cp._central(0.85))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert got.count() == sum(b % 7 for b in range(40))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
