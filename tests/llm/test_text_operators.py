"""Language, fingerprints, BPE, token counts, packing: edge cases and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlstone.llm import bpe, language, packing, simhash, token_counts

TEXTS = [None, "", "   \n\t", "one", "The cat. The cat.", "Größe und Maß", "a" * 5000, "naïve 中文 🙂 ²", "x\x00y", "<|endoftext|> a", "  lead", "1234567890" * 300]


def frame(spark, texts, extra=True):
    rows = [(i, t, "e", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")


# -- language -----------------------------------------------------------------------------------

def brute_keys(text):
    """All n-grams of blank-padded words, keyed one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = [0] + [x for w in words for x in [*map(ord, w), 0]]
    mul, mask, out = 0x9E3779B97F4A7C15, (1 << 64) - 1, []
    for n in range(1, 6):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if (n == 1 and g[0]) or (n > 1 and all(g[1:-1])):
                key = g[0]
                for k, c in enumerate(g[1:], 2):
                    key = (key * mul & mask) ^ (c + k)
                out.append(key)
    return out


@pytest.mark.parametrize("text", ["a", "ab", "The cat's hat.", "Größe  ist—alles", "x1y"])
def test_ngrams_match_brute_force(text):
    assert sorted(language.ngram_keys(language.letter_stream(text)).tolist()) == sorted(brute_keys(text))


def test_top_keys_break_ties_by_key():
    keys = np.array([5, 3, 3, 9, 5, 1], np.uint64)
    assert language.top_keys(keys, 3).tolist() == [3, 5, 1]
    c = Counter(keys.tolist())
    assert language.top_keys(keys, 10).tolist() == sorted(c, key=lambda k: (-c[k], k))


def test_out_of_place_distance():
    ranked = {"a": np.array([10, 20, 30], np.uint64).view(np.int64).tolist(), "b": np.array([30, 40], np.uint64).view(np.int64).tolist()}
    p = language.Profiles(ranked, 3)
    top = language.top_keys(language.ngram_keys(language.letter_stream("q")), 3)
    assert p.distances("q").tolist() == [1.0, 1.0] and len(top) == 3
    assert p.distances("123") is None and p.predict(None) == ("und", 0.0)


def test_identify(spark):
    rows = [(i, "the cat and the dog were in the house", "en") for i in range(8)] + [(i + 8, "der hund und die katze sind in dem haus", "de") for i in range(8)] + [(99, "the", None)]
    profiles = language.learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.langs == ["de", "en"]
    got = {r["doc_id"]: r for r in language.identify(frame(spark, [*TEXTS, "the house and the dog"]), profiles).collect()}
    assert len(got) == len(TEXTS) + 1 and got[len(TEXTS)]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(frame(spark, TEXTS).limit(0), profiles).count() == 0
    assert language.learn_profiles(frame(spark, TEXTS).where("lang is null")).langs == []


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", language.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


# -- near-duplicates ----------------------------------------------------------------------------

def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_contract():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint("A b C d") == simhash.fingerprint("a  B\nc d")


def brute_components(fps, radius=3):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[find(b)] = find(a)
    return [find(f) for f in fps]


@pytest.mark.parametrize("radius", [3, 5])
def test_components_match_brute_force(spark, radius):
    rnd = random.Random(radius)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = [c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for c in centres for _ in range(12)] + [0, 0, (1 << 64) - 1]
    fps = [f & (1 << 64) - 1 for f in fps]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long"), radius).collect()}
    root = brute_components(fps, radius)
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    assert got == {i: first[r] for i, r in enumerate(root)}


def test_allocation_is_optimal():
    rnd = np.random.default_rng(1)
    cost = rnd.random((20, 3, 4))
    t = simhash.allocate(cost, 1)
    for q in range(20):
        best = min(sum(cost[q, i, e + 1] for i, e in enumerate((a, b, 1 - a - b))) for a in range(-1, 3) for b in range(-1, 3) if -1 <= 1 - a - b <= 2)
        assert t[q].sum() == 1 and np.isclose(sum(cost[q, i, t[q, i] + 1] for i in range(3)), best)


def test_crowded_values_lose_no_link():
    rnd = random.Random(3)
    fps = np.array([rnd.getrandbits(64) for _ in range(50)], np.uint64)
    fps = np.concatenate((fps, fps ^ np.uint64(0b101)))
    groups = simhash.group_bits(0, np.zeros((64, 64)), 4)
    crowded = [dict.fromkeys(simhash.project(fps, g).tolist(), 1000) for g in groups]
    for plan in (simhash.Plan(groups, 100, [{}] * 4), simhash.Plan(groups, 100, crowded)):
        keys, owners = plan.entries(fps)
        buckets = {}
        for k, o in zip(keys.tolist(), owners.tolist()):
            buckets.setdefault(k, set()).add(o)
        for a in fps[:50].tolist():
            assert any({a, a ^ 0b101} <= b for b in buckets.values())


def test_estimates_count_what_probes_reach():
    """The plan's expected candidates equal the average over all probes of buckets filled evenly inside a cell."""
    rnd = np.random.default_rng(2)
    groups = [list(range(14)), list(range(14, 64))]
    count = rnd.integers(0, 50, 1 << 12).astype(float)
    plan = simhash.Plan(groups, int(count.sum()), [{}, {}], 3, [count, np.full(1 << 12, 1.0)])
    for cell in (0, 77, 4095):
        value = cell << 2
        for e in range(4):
            reach = sum(count[(value ^ int(m)) >> 2] / 4 for m in simhash.masks_within(14, 3)[e])
            assert np.isclose(plan.near[0][e, cell], reach)


def test_large_buckets_keep_every_pair_together(spark):
    rows = [(1, i) for i in range(50)] + [(2, 7), (2, 8)]
    dealt = simhash._dealt(spark.createDataFrame(rows, "bucket long, fp long"), 8).collect()
    groups = {}
    for r in dealt:
        groups.setdefault(r["bucket"], set()).add(r["fp"])
    assert groups[2] == {7, 8}
    large = [g for b, g in groups.items() if b != 2]
    assert all(any({i, j} <= g for g in large) for i in range(50) for j in range(i)) and max(map(len, large)) < 40


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(frame(spark, [*TEXTS, *TEXTS])).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    n = len(TEXTS)
    assert len(got) == 2 * n and by[0] == by[1] == by[2] == 0 and all(by[i + n] == by[i] for i in range(n))
    assert simhash.near_duplicates(frame(spark, TEXTS).limit(0)).count() == 0


def test_word_fingerprint():
    base = [f"word{i}" for i in range(300)]
    edited = list(base)
    edited[7] = "other"
    near = (simhash.word_fingerprint(" ".join(base)) ^ simhash.word_fingerprint(" ".join(edited))).bit_count()
    assert near <= 7 and simhash.word_fingerprint(None) == 0


# -- BPE ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    P = pytest.importorskip("public_tokenizers")
    return bpe.load(P.path("byte_bpe_50k.json"))


def library(name):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    return Tokenizer.from_file(P.path(name))


def test_bpe_equals_the_library(byte_bpe):
    t, rnd = library("byte_bpe_50k.json"), random.Random(1)
    alphabet = ["a", "b", "e", " ", "  ", "\n", "é", "ß", "'s", "'re", "<|endoftext|>", "9", "²", "Ⅷ", "́", "中", "🙂", "\xa0", "\x85", "_", "-", "the", "\x1c", "'S"]
    cases = [t_ or "" for t_ in TEXTS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    for x in cases:
        want = t.encode(x, add_special_tokens=False).ids
        got = np.frombuffer(b"".join(byte_bpe.encode(x)), "<u4").tolist()
        assert got == want
        n, ids, text = bpe.digest(byte_bpe, x)
        assert n == len(want) and text == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_windows_emit_what_a_whole_pass_does(byte_bpe):
    rnd = random.Random(2)
    for alphabet in ("ab", "aeinthsr", "-=", "0123456789"):
        data = "".join(rnd.choice(alphabet) for _ in range(4000)).encode()
        for step in (1, 7, 997, 4000):
            chunks = (data[i : i + step] for i in range(0, len(data), step))
            assert [i for ids in byte_bpe.stream(chunks) for i in ids] == byte_bpe.merge(data)


def test_decoder_is_incremental(byte_bpe):
    data = "aé🙂".encode()
    d = byte_bpe.decoder()
    ids = [byte_bpe.byte_ids[b] for b in data]
    out = [d.feed(np.array([i], "<u4").tobytes()) for i in ids]
    assert out == ["a", "", "é", "", "", "", "🙂"]
    assert byte_bpe.decoder().feed(np.array([byte_bpe.byte_ids[0xF0]], "<u4").tobytes(), True) == "�"


def test_bpe_frames(spark, byte_bpe):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    ids = bpe.encode(frame(spark, TEXTS), path)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    got = bpe.round_trip(frame(spark, TEXTS), path).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() for r in got)


# -- token counts -------------------------------------------------------------------------------

def test_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    alphabet = ["a", "e", " ", "  ", "\n", "é", "'s", "<s>", "9", "²", "▁", "́", "中", "🙂", "\t", "\x00", "ing", "the", "<0x0A>", "aa"]
    cases = [*TEXTS, *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(1500))]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, cases), path).collect()}
    for i, t in enumerate(cases):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


# -- packing ------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(30))
def test_solution_holds_everything(seed):
    rnd = random.Random(seed)
    cap = rnd.choice((10, 100, 4096))
    counts = {rnd.randint(1, cap): rnd.randint(1, 30) for _ in range(rnd.randrange(40))}
    got = Counter()
    for lengths, n in packing.solve(counts, cap):
        assert n > 0 and sum(lengths) <= cap
        for w in lengths:
            got[w] += n
    assert got == Counter(counts)


def test_small_instances_are_near_optimal():
    def optimum(items, cap):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    place(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    rnd = random.Random(5)
    for _ in range(60):
        items = sorted((rnd.randint(1, 10) for _ in range(8)), reverse=True)
        used = sum(n for _, n in packing.solve(Counter(items), 10))
        assert used <= optimum(items, 10) + 1


def test_reduction_keeps_the_optimum():
    h = packing.Histogram({9: 2, 6: 3, 4: 3, 1: 1})
    fixed = packing.reduce_instance(h, 10)
    assert ((9, 1), 1) in fixed and ((6, 4), 3) in fixed and ((9,), 1) in fixed and not h.counts


def test_pack_frames(spark):
    P = pytest.importorskip("public_tokenizers")
    import zlib

    path = P.path("word_bpe_49k.json")
    texts = [*TEXTS, " ".join(f"word{i}" for i in range(3000)), *["same text"] * 50]
    t = library("word_bpe_49k.json")
    out = packing.pack(packing.cut_pieces(frame(spark, texts), path)).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[r["start"] : r["start"] + 4096], "<u4").tobytes()
        assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * r["piece"], len(part) // 4, zlib.crc32(part))
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in out) // 4096)
    assert packing.pack(packing.cut_pieces(frame(spark, TEXTS).limit(0), path)).count() == 0


def test_word_ids_equal_the_library():
    P = pytest.importorskip("public_tokenizers")
    t, rnd = library("word_bpe_49k.json"), random.Random(1)
    alphabet = ["a", "b", "c. ", "Dd, ", "É", "é", "ΑΣ", " ", "  ", "\n", "ß", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "9", "²", "中", "\t", "\xa0", "İ", " ", "́", ".", ",", "A.", "ª.", "x.y", "\x1c"]
    cases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(2000)]
    got = packing.load(P.path("word_bpe_49k.json")).ids(cases)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids + [1] for e in t.encode_batch(cases, add_special_tokens=False)]


# -- similar groups -----------------------------------------------------------------------------

def test_joined_sets_match_brute_force():
    from marlstone.llm.similar import joined_sets

    rnd = random.Random(6)
    for _ in range(40):
        base = [rnd.sample(range(10_000), 40) for _ in range(4)]
        sets = [set(rnd.choice(base)) for _ in range(25)]
        for s in sets:
            for _ in range(rnd.randrange(8)):
                s.pop()
                s.add(rnd.randrange(10_000))
        root = list(range(25))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(25):
            for j in range(i + 1, 25):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        assert joined_sets([np.array(sorted(s)) for s in sets]) == [find(i) for i in range(25)]


def test_shingle_set():
    from marlstone.llm.similar import shingle_set

    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == 1 and shingle_set("A  b").tolist() == shingle_set("a b").tolist()
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("x " * 50)) == 1


def test_similar_groups(spark):
    from marlstone.llm.similar import similar_groups

    rnd = random.Random(12)
    words = [f"{rnd.choice('bcdfgh')}{rnd.randrange(10**6)}word" for _ in range(5000)]
    rows, want = [], {}
    for g in range(30):
        original = [rnd.choice(words) for _ in range(300)]
        for c in range(rnd.choice((1, 2, 40))):
            text = list(original)
            if c:
                text[rnd.randrange(300)] = rnd.choice(words)
            want[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    far = list(rows[0][1].split())
    for k in range(0, 300, 20):
        far[k] = rnd.choice(words)
    rows += [(len(rows), " ".join(far)), (len(rows) + 1, None), (len(rows) + 2, ""), (None, "no id")]
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(want)
    first = {}
    for i, g in want.items():
        first.setdefault(g, i)
    assert {i: got[i] for i in want} == {i: first[g] for i, g in want.items()}
    assert got[n] == n and got[n + 1] == got[n + 2] == n + 1 and None not in got
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_groups(texts):
    """Smallest number of each text's component, by all pairs."""
    from marlstone.llm.similar import shingle_set

    sets = [set(shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            lo, hi = sorted((len(sets[i]), len(sets[j])))
            if lo >= 0.8 * hi and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_cut_and_extended_copies_are_found(spark):
    from marlstone.llm.similar import similar_groups

    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 14)))
    texts = []
    for n in range(150):
        original = [word() for _ in range(rnd.randrange(20, 200))]
        cut = original[: -int(len(original) * rnd.uniform(0.12, 0.21))]
        longer = original + [word() for _ in range(int(len(original) * rnd.uniform(0.12, 0.26)))]
        swapped = [word() if rnd.random() < 0.02 else w for w in original]
        texts += [" ".join(t) for t in (original, cut, longer, swapped)]
    want = brute_groups(texts)
    assert sum(want[i] != i for i in want) > 300
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar_groups(rows).collect()} == want


def test_large_groups_lose_no_pair(spark):
    from marlstone.llm.similar import similar_groups

    rnd = random.Random(16)
    short = lambda: "".join(rnd.choice("abcdefghij") for _ in range(2))
    long = ["".join(rnd.choice("abcdefghij") for _ in range(24)) for _ in range(60)]
    texts = []
    for _ in range(600):  # all fingerprints are near the centre's, only each text's twin is like it
        own = [w for x in long for w in (x, short())]
        texts += [" ".join(own), " ".join(own[:-2] + [short(), short()])]
    rnd.shuffle(texts)
    want = brute_groups(texts)
    assert sum(want[i] != i for i in want) == 600
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar_groups(rows).collect()} == want


def test_a_crowded_shingle_is_dealt(spark):
    """Pairs that meet don't depend on how many documents a shingle may hold, and no block holds more than two parts."""
    from pyspark.sql import functions as F

    from marlstone.llm import similar

    rng = random.Random(3)
    rows = [(t, d, rng.randrange(40), (30 << 32) + rng.randrange(3)) for t, n in ((1, 300), (2, 5), (3, 64), (4, 1)) for d in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "token long, doc_id long, label long, place long").repartition(3)
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    for crowd in (2048, 64, 10):
        got = [(r["u"], r["v"]) for r in similar._meetings(df, 0.8, crowd).collect()]
        assert set(got) == want
        # a pair may meet on each of its shared shingles, but once on each
        assert len(got) == sum(1 for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[2] != b[2])
    biggest = similar._dealt(df, 10).groupBy("token").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert biggest < 60  # two parts of about ten


def test_shingles_of_the_same_documents_are_met_once(spark):
    """Two documents that share forty shingles meet once, where their positions are least; other documents' meetings stay."""
    from marlstone.llm import similar

    place = lambda n: (100 << 32) + n
    rows = [(t, d, d, place(t + d)) for t in range(40) for d in (1, 2)] + [(t, d, d, place(t - 40)) for t in (40, 41) for d in (1, 2, 3)]
    rows += [(50 + t, 7, 7, place(t)) for t in range(5)]  # shared with no other
    df = spark.createDataFrame(rows, "token long, doc_id long, label long, place long").repartition(3)
    got = sorted((r["u"], r["v"]) for r in similar._meetings(df, 0.8).collect())
    assert got == [(1, 2), (1, 2), (1, 3), (2, 3)]
    late = spark.createDataFrame([(t, d, d, place(t)) for t in (60, 5) for d in (1, 2)], df.schema)
    assert similar._meetings(late, 0.8).count() == 1  # at 60 alone they could not be alike
    assert similar._meetings(late.where("token = 60"), 0.8).count() == 0


def test_words_of_texts_over_four_mebibytes():
    """Cut at blanks and encoded in parts, and words in portions: as the library does with the whole."""
    import numpy as np
    import pytest

    from marlstone.llm import packing

    p = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p)
    t.no_truncation(), t.no_padding()
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", ",", "!", "7"]) for _ in range(60_000)]
    long = " ".join(rng.choice(words) for _ in range(900_000))
    assert len(long) > packing.LONG_TEXT
    got = list(packing.WordIds(p).ids([long, None, "a  b\n\nc", long[:5000]]))
    for text, ids in zip([long, "", "a  b\n\nc", long[:5000]], got):
        want = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END], np.uint32)
        assert np.array_equal(want, ids)


def test_models_are_learned_from_every_document(spark):
    """More documents of a language than any bound there was; the profile's counts are those of all."""
    import collections

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(7000)]
    train = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(-1, None, "en"), (-2, "zz zz zz", None)], "doc_id long, text string, lang string")
    counts = collections.Counter(k for t in texts for k in language.ngram_keys(language.letter_stream(t)).tolist())
    want = sorted(counts, key=lambda k: (-counts[k], k))[: language.PROFILE]
    profiles = language.learn_profiles(train)
    assert profiles.langs == ["en"]
    got = np.full(len(want), -1)
    at = np.flatnonzero(profiles.ranks[0] >= 0)
    got[profiles.ranks[0][at]] = at
    assert profiles.vocab[got].tolist() == want
    steps = sorted(round(profiles.predict(t)[1] * language.STEPS) for t in texts)
    floors = language.learn_floors(train, profiles)
    by_class = collections.defaultdict(list)
    for t in texts:
        by_class[language.length_class(t)].append(round(profiles.predict(t)[1] * language.STEPS))
    for c, found in by_class.items():
        if len(found) >= language.LIKE_DOCUMENTS:
            assert abs(floors[c] - language.LIKE_SHARE * np.percentile(found, 100 * language.LIKE_QUANTILE) / language.STEPS) < 1e-9
    assert steps[0] > 0 and language.learn_floors(train.limit(0), language.learn_profiles(train.limit(0))) == [0.0] * language.CLASSES
