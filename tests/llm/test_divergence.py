"""Source divergence: counts and shares again in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallychain.llm import divergence
from tallychain.llm.divergence import TERM_BYTES, Runs, audit, count_terms, pieces, radix_order

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return LETTERS.findall(lowered)


def plain(docs, min_docs=30, top=50):
    """The report from (lang, source, text) rows."""
    count, docs_of, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms_of(text)
        for t in found:
            count[lang, source, t] += 1
        for t in set(found):
            docs_of[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs_of.items() if g == lang and n >= min_docs]
        v = len(kept)

        def shares(name, kept=kept, v=v, lang=lang, sources=sources):
            own = sources if name is None else [name]
            n = {t: sum(count[lang, s, t] for s in own) for t in kept}
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * v) for t in kept}

        whole, each = shares(None), {s: shares(s) for s in sources}
        for s in sources:
            rows = [(sum(abs(each[s][t] - each[o][t]) for t in kept), o) for o in sources - {s}]
            typical = [(each[s][t] - whole[t], t) for t in kept
                       if count[lang, s, t] and each[s][t] > whole[t]]
            for part, found, most in (("pair", rows, len(rows)), ("term", typical, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, x, k) for k, (x, item) in enumerate(found, 1)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


def corpus(n, sources, seed=1):
    r = random.Random(seed)
    words = ["alpha", "Beta", "straße", "文字", "intergalactically", "a" * 40, "x", "longishword", "é",
             "counterrevolutionaries", "Ωmega"] + [f"w{'abcdefghij'[k % 10]}{'klmno'[k // 10]}" for k in range(50)]
    rows = []
    for k in range(n):
        own = words[k % sources :: 3] + words[:12]
        text = r.choice([" ", ", ", "1", "-"]).join(r.choices(own, k=r.randint(0, 60)))
        rows.append((r.choice(["en", "de", None]), f"s{k % sources}" if k % 9 else None, text))
    return rows + [("en", "s0", None), ("fr", "only", "one two"), ("", "", "" ), ("xx", "a", "q"), ("xx", "b", "r")]


SCHEMA = "lang string, source string, text string, n int, term string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(5)


def test_against_a_plain_version(spark):
    rows = corpus(500, 7)
    assert told(audit(frame(spark, rows))) == plain(rows)


def test_many_sources(spark):
    """More sources than one block holds."""
    rows = [("en", f"s{k % 150:03d}", f"alpha beta{'x' * (k % 3)} gamma{'y' * (k % 40)}") for k in range(900)]
    assert told(audit(frame(spark, rows))) == plain(rows)


def test_edge_rows(spark, edges, nothing):
    docs = edges.selectExpr("*", "CASE WHEN n % 2 = 0 THEN 'en' END AS lang", "'s' AS source")
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert told(audit(docs, min_docs=2)) == plain(rows, min_docs=2)
    assert audit(nothing.selectExpr("*", "'en' AS lang", "'s' AS source")).collect() == []


def test_texts_longer_than_a_piece(small_limits):
    """One document counts once per term, however many pieces it is cut into."""
    small_limits(divergence, PIECE=50)
    text = " ".join(["alpha", "beta", "intergalactically", "x" * 130, "counterrevolutionaries"] * 20)
    data = text.encode().translate(TERM_BYTES)
    cut = list(pieces(data))
    assert len(cut) > 10 and b"".join(cut) == data
    parts = defaultdict(list)
    for piece in cut:
        for bucket, runs in count_terms(piece, np.zeros(1, np.int64), np.zeros(1, np.int64)).items():
            parts[bucket].append(runs)
    merged = [Runs.merged(p, one_document=True) for p in parts.values()]
    got = {t.decode(): (n, d) for r in merged
           for t, n, d in zip(r.terms().to_pylist(), r.n, r.docs, strict=True)}
    assert got == {t: (n, 1) for t, n in Counter(terms_of(text)).items()}


def test_batches_with_small_limits_equal_plain_counts(small_limits):
    small_limits(divergence, PIECE=300, HELD=40)
    rows = corpus(300, 5, seed=4)
    rows.append(("en", "s1", "tail " * 500))
    columns = [[(r[k] or "") for r in rows] for k in range(3)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c[a : a + 100]) for c in columns], ["lang", "source", "text"])
        for a in range(0, len(rows), 100)
    ]
    n, docs = Counter(), Counter()
    flushed = 0
    for b in divergence._count_batches(iter(batches)):
        flushed += 1
        for r in b.to_pylist():
            key = r["lang"], r["source"], r["term"].decode()
            n[key] += r["n"]
            docs[key] += r["docs"]
    want_n, want_docs = Counter(), Counter()
    for lang, source, text in zip(*columns, strict=True):
        found = terms_of(text)
        want_n.update((lang, source, t) for t in found)
        want_docs.update((lang, source, t) for t in set(found))
    assert flushed > 5 and n == want_n and docs == want_docs


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=60))
@hypothesis_settings(deadline=None, max_examples=60)
def test_radix_order_is_the_stable_order(rows):
    words = [np.array([r[k] for r in rows], np.uint64) for k in (1, 0)]
    want = sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][0]))
    assert radix_order(words).tolist() == want


@pytest.mark.parametrize("count", [0, 10**13])
def test_shares_are_exact(spark, count):
    total, v = 3 * 10**13 + 7, 12345
    got = spark.range(1).select(divergence.share(F.lit(count), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * v)
