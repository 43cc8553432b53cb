import random

import numpy as np
import pytest
from edge_rows import edge_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tallychain.llm import jaccard_join as j
from tallychain.llm.common import WordCodes
from tallychain.llm.links import components


def shingles(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")]
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", " ".join(words))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if None in (a, b) or not s or not t:
                continue
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((-1 if d is None else d, len(s), -1 if d is None else find(d)) for d, s in sets)


def family(seed, copies, words):
    """A chain of ever more different texts: ends that do not link meet through the middle."""
    r, text, out = random.Random(seed), prose(seed, words).split(), []
    for _ in range(copies):
        text = [*text]
        text[r.randrange(len(text))] = "w" + str(r.random())
        out.append(" ".join(text))
    return out


def documents():
    texts = [t for k in range(4) for t in family(k, 12, 60 + 20 * k)]
    passage = prose(99, 300)
    texts += [f"{passage} {prose(100 + k, 10 * k)}" for k in range(25)]  # one passage, many ends
    texts += [prose(200, n) for n in range(1, 14)] + [prose(k, 40) for k in range(300, 330)]
    return [(1000 + k, t) for k, t in enumerate(texts)] + list(edge_documents())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small, small_limits):
    if small:
        small_limits(j, BLOCK_DOCS=7, BUCKET_BYTES=1000, MEMBERS=4)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = j.similar_classes(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found)
    assert got == brute(rows)


sizes = st.integers(1, 300)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), sizes, st.integers(0, 12), st.integers(0, 12))
def test_linked_sets_share_a_signature(seed, common, left, right):
    r = np.random.default_rng(seed)
    codes = np.unique(r.integers(0, 2**63, common + left + right, dtype=np.uint64))
    r.shuffle(codes)
    a = np.sort(np.concatenate([codes[:common], codes[common : common + left]]))
    b = np.sort(np.concatenate([codes[:common], codes[common + left :]]))
    same = len(np.intersect1d(a, b))
    assert j.linked(a, b) == (100 * same >= 75 * (len(a) + len(b) - same))
    if j.linked(a, b):
        assert len(np.intersect1d(j.signatures(a), j.signatures(b)))
        n, rows = np.array([len(a), len(b)]), [j.sketch(x).tobytes() for x in (a, b)]
        assert sorted((i, k) for i, ks in j.possible_pairs(n, rows, np.arange(2)) for k in ks) in ([(0, 1)], [(1, 0)])
    apart = len(a) + len(b) - 2 * same
    assert j.distance(j.sketch(a).tobytes(), j.sketch(b).tobytes()) <= apart


def test_sketches_fold():
    r = np.random.default_rng(4)
    long, short = (np.unique(r.integers(0, 2**63, k, dtype=np.uint64)) for k in (900, 120))
    assert len(j.sketch(long)) == 512 and len(j.sketch(short)) == 64
    assert j.folded(j.sketch(long), 64).sum() == 900
    assert 700 <= j.distance(j.sketch(long).tobytes(), j.sketch(short).tobytes()) <= 1020


def test_bands_hold_partners_side_by_side():
    for n in range(1, 3000):
        assert n <= j.band_top(j.band(n))
        assert j.band(4 * n // 3) - j.band(n) <= 1


def test_word_codes_depend_on_the_word_alone():
    codes, seen = WordCodes(), {}
    for text in (prose(1, 50), "É é ab ba a\x00b A\tB\x0b" + prose(2, 9000), "ab ba é", "\x1c x\xa0y"):
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", text)
        got = codes.of(text).tolist()
        assert len(got) == len(words)
        for w, code in zip(words, got, strict=True):
            plain = "".join(c.lower() if c.isascii() else c for c in w)
            assert seen.setdefault(plain, code) == code
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    codes = WordCodes()
    assert len(j.shingles(None, codes)) == len(j.shingles(" \n", codes)) == 0
    assert len(j.shingles("a b", codes)) == len(j.shingles("a b c d e", codes)) == 1
    assert j.shingles("A b", codes) == j.shingles("a  B", codes) != j.shingles("b a", codes)


def test_one_of_each(spark, edges, nothing):
    kept = j.one_of_each(edges)
    assert kept.columns == edges.columns
    classes = {d: c for d, _, c in brute(edge_documents())}
    want = sorted([d for d, c in classes.items() if d == c and d != -1] + [-1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    assert j.one_of_each(nothing).count() == 0


def test_rows_of_one_key_with_different_texts(spark):
    """What one text of a key holds alone does not hide the other's links, and no text is lost."""
    text, other = prose(11, 90), prose(12, 400)
    rows = [(5, text), (5, other), (7, text + " tail"), (9, prose(13, 60)), (5, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in j.similar_classes(docs).collect()}
    assert found == {5: 5, 7: 5, 9: 9}
    kept = sorted((r.doc_id, r.text) for r in j.one_of_each(docs).collect())
    assert kept == sorted([(5, text), (5, other), (9, rows[3][1])])


@pytest.mark.parametrize("majority", [1, 5])
def test_only_pairs_of_different_classes_are_looked_at(majority):
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - 9 * k], r.integers(0, 2**63, 6 * k, dtype=np.uint64)]))
            for k in range(14)]
    n, rows = np.array([len(x) for x in sets]), [j.sketch(x).tobytes() for x in sets]
    of = np.array([k if k >= majority else 0 for k in range(14)])
    got = {(min(i, k), max(i, k)) for i, ks in j.possible_pairs(n, rows, of) for k in ks}
    want = {(a, b) for a in range(14) for b in range(a + 1, 14)
            if of[a] != of[b] and j.linked(sets[a], sets[b])}
    assert want <= got and all(of[a] != of[b] for a, b in got)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)]
    edges += [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7), (300, 299), (300, 299)]
    random.Random(1).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    want = {k: 0 for k in range(41)} | {100 + k: 100 for k in range(50)}
    assert got == want | {200 + k: 200 for k in range(9)} | {300: 299, 299: 299}


def test_shingles_are_counted_once(spark, monkeypatch):
    rows = [(k, prose(k, 60)) for k in range(30)] + [(100 + k, prose(k % 3, 60)) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted, real = spark.sparkContext.accumulator(0), j.unique_counts
    alone = real(docs, "doc_id", j.SHINGLE, 4).count()

    def watched(*args):
        def count(batches):
            for batch in batches:
                counted.add(batch.num_rows)
                yield batch

        return real(*args).mapInArrow(count, "doc long, alone long")

    monkeypatch.setattr(j, "unique_counts", watched)
    assert sorted(tuple(r) for r in j.similar_classes(docs).collect()) == brute(rows)
    assert counted.value == alone > 0
