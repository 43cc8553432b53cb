import hashlib

import numpy as np
import pytest
from edge_rows import LONG, edge_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tallychain.llm import suffix_dedup as d


@settings(max_examples=200, deadline=None)
@given(
    part=st.lists(st.integers(1, 3), max_size=60),
    times=st.integers(1, 8),
    tail=st.lists(st.integers(1, 3), max_size=20),
)
def test_suffix_order(part, times, tail):
    s = np.array(part * times + tail, np.int64)
    order = d.suffix_order(s)
    assert sorted(order.tolist()) == list(range(len(s)))
    prefixes = [s[i : i + d.LENGTH].tolist() for i in order]
    assert prefixes == sorted(prefixes)


def test_anchors_belong_to_their_windows():
    texts = [prose(k, 50).encode() for k in range(5)] + [b"", b"x" * 49, b"y" * 300, b"z" * 50]
    text, start, count, code = d.anchors(texts)
    windows = {(t, a + k): c for t, a, n, c in zip(text.tolist(), start.tolist(), count.tolist(), code.tolist(), strict=True) for k in range(n)}
    assert len(windows) == sum(max(0, len(t) - 49) for t in texts)
    by_content = {}
    for (t, a), c in windows.items():
        assert by_content.setdefault(texts[t][a : a + 50], c) == c


def brute(rows):
    first, out, own = {}, [], {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        own.setdefault(i, t)
        for k in range(len(t) - 49) if own[i] == t else ():
            first.setdefault(t[k : k + 50], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49) if i is not None and own[i] == t else ():
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def documents():
    passage = prose(50, 20)
    rows = [(i, (t or "").encode()) for i, t in edge_documents()]
    rows += [(100 + k, f"{prose(k, 15)} {passage[k % 9 :]} {prose(k + 1, 9)}".encode()) for k in range(40)]
    rows += [(200 + k, prose(7, 90).replace("ta", "to", k).encode()) for k in range(12)]
    rows += [(-5, passage[:50].encode()), (300, passage[:49].encode()), (301, (passage[:50] * 3).encode())]
    rows += [(302, LONG[100:9000].encode()), (303, b"q" * 80), (304, b"q" * 50 + b"r" + b"q" * 49)]
    # Keys with several texts: the copy of a smaller key's text is or is not the key's smallest one.
    a, b, c = (x + prose(60 + k, 20).encode() for k, x in enumerate([b"a", b"b", b"c"]))
    rows += [(400, b), (401, a), (401, b), (402, b), (402, b), (402, c), (410, a), (410, c), (411, c), (411, c + b"d")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"limit_bytes": 3000, "limit_chars": 400}])
def test_against_brute_force(spark, limits, small_limits):
    """In one block and one sort, and with blocks, buckets and sorts that overflow."""
    if limits:
        small_limits(d, BLOCK_BYTES=4000, BUCKET_BYTES=2000, PORTION_WINDOWS=500)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in documents()], "doc_id long, text string")
    found = d.remove_repeats(docs.repartition(3), **limits).collect()
    got = sorted(
        (-1 if r.doc is None else r.doc, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans),
         hashlib.sha256(r.kept).hexdigest())
        for r in found
    )
    assert got == brute(documents())


def test_empty_table_and_other_columns(edges, nothing):
    assert d.remove_repeats(nothing).count() == 0
    assert d.remove_repeats(edges).count() == edges.count()
