import re
from collections import defaultdict

import pytest
from edge_rows import PLAIN, edge_documents, prose

from tallychain.llm import decontaminate as d

ITEMS = [
    (1, " ".join(PLAIN.split())), (2, "one two"), (3, None), (4, ""), (5, prose(3, 60)),
    (6, "Seven  WIZARDS brew"), (7, "seven wizards brew"), (8, "straße 文字"), (9, prose(99, 30)),
]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items):
    own, hit, owners = words(text), set(), set()
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(item)
    for n in {len(w) for w in windows}:
        for k in range(len(own) - n + 1):
            found = windows.get(tuple(own[k : k + n]))
            if found:
                hit |= set(range(k, k + n))
                owners |= found
    return len(own), len(hit), sorted(map(str, owners))


@pytest.mark.parametrize("block_bytes", [1, 10**6])
def test_hits_against_brute_force(spark, edges, block_bytes, small_limits):
    """With one block of the benchmark, and with one for every item."""
    small_limits(d, SHARD_WORDS=500)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    d.blocks.__defaults__, before = (block_bytes,), d.blocks.__defaults__
    try:
        found = d.find_matches(edges, bench).collect()
    finally:
        d.blocks.__defaults__ = before
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words,
                  sum(s.stop - s.start for s in r.spans), r.items) for r in found)
    want = sorted((-1 if i is None else i, *brute(t, ITEMS)) for i, t in edge_documents())
    assert got == want


def test_longest_match_runs_beyond_the_window(spark):
    item = prose(8, 150)
    docs = [(1, prose(9, 40) + " " + item + " " + prose(10, 40)), (2, item[:200]), (3, prose(11, 50))]
    found = d.find_matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(5, item)], "item_id long, text string"),
    )
    by_id = {r.doc_id: r for r in found.collect()}
    assert (by_id[1].longest, by_id[1].longest_item, by_id[1].longest_at) == (150, "5", 40)
    assert by_id[2].longest == len(words(item[:200])) - (not item[:200].endswith(" ") and item[200] != " ")
    assert by_id[3].spans == []


def longest(text, items):
    own, best = words(text), (0, None, None)
    for item, t in sorted(items, key=lambda x: str(x[0])):
        theirs, before = words(t), []
        for p, w in enumerate(own):  # lengths of the matches that end here
            row = [(before[q - 1] if q and before else 0) + 1 if w == x else 0 for q, x in enumerate(theirs)]
            n = max(row, default=0)
            if n and (-n, p - n + 1) < (-best[0], best[2] or 0):
                best = (n, str(item), p - n + 1)
            before = row
    return best


@pytest.mark.parametrize("block_bytes", [1, 10**6])
def test_every_document_has_its_longest_match(spark, block_bytes, small_limits):
    """Several documents of one shard with the same part, other parts, and parts below a window."""
    item = prose(8, 150).split()
    items = [(5, " ".join(item)), (12, " ".join(item[100:])), (6, prose(9, 40)), (7, "one two"), (8, "q q " * 90)]
    parts = [(30, 50), (30, 50), (30, 50), (35, 60), (0, 150), (145, 150), (143, 150), (60, 64), (3, 4), (98, 150)]
    docs = [(k, f"zz{k} yy " + " ".join(item[a:b]) + f" xx{k}") for k, (a, b) in enumerate(parts)]
    docs += [(20, " ".join(item[2:16] + item[40:52] + item[101:120])), (21, "q " * 170), (22, "zz one two"),
             (23, None), (24, "zz yy"), (25, " ".join(item[:11] + item[70:79] + item[71:80]))]
    small_limits(d, KEY_WORDS=16)
    d.blocks.__defaults__, before = (block_bytes,), d.blocks.__defaults__
    try:
        found = d.find_matches(
            spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
            spark.createDataFrame(items, "item_id long, text string"),
        ).collect()
    finally:
        d.blocks.__defaults__ = before
    got = {r.doc_id: (r.longest, r.longest_item, r.longest_at) for r in found}
    assert got == {k: longest(t, items) for k, t in docs}
    assert [got[k][0] for k in range(10)] == [b - a for a, b in parts]


def test_affected_documents_go(spark, edges, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.decontaminated(edges, bench)
    assert kept.columns == edges.columns
    want = sorted(-1 if i is None else i for i, t in edge_documents() if not brute(t, ITEMS)[1])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminated(edges, empty).count() == edges.count()
    assert d.find_matches(edges, empty).count() == edges.count()
    assert d.find_matches(nothing, bench).count() == 0
