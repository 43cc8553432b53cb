"""Ids, packing and token files."""

import zlib

import numpy as np
import pytest
from edge_rows import LONG, edge_documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallychain.llm import packing as p
from tallychain.llm import token_files as f
from tallychain.llm import tokens as t

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
WORDS = ["the", "Foo's", "it's", "ÉCOLE", "straße", "½", "文字", "á", "İ", "ŉ", "ª", "...", ",", "x,", "12", "don't", "\x1f", "<|endoftext|>", "Foo$$$", "foo_", "Été).", "a's.", "\\x", "µ,", "end."]
SPACES = [" ", "  ", "\n", "\n\n", "\t", " ", " \n", "\x1c", ""]


@pytest.mark.parametrize(("name", "keeps"), FILES)
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SPACES)), max_size=12))
def test_ids_equal_plain_calls(name, keeps, parts):
    text = "".join(w + s for w, s in parts)
    plain = Tokenizer.from_file(t.public_path(name)).encode(text, add_special_tokens=False).ids
    assert t.encoder(t.public_path(name), keeps).encode(text).tolist() == plain


@pytest.mark.parametrize(("name", "keeps"), FILES)
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SPACES)), max_size=9), max_size=6))
def test_ids_of_many_texts_equal_plain_calls(name, keeps, texts):
    texts = ["".join(w + s for w, s in parts) for parts in texts]
    coder = t.encoder(t.public_path(name), keeps)
    coder.forget()
    texts = texts + texts[::-1]
    plain = [coder.library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids.tolist() for ids in coder.encode_all(texts)] == plain


@pytest.mark.parametrize(("name", "keeps"), FILES)
def test_every_white_space_is_treated_alike_alone_and_among_others(name, keeps):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = [x for c in spaces for x in (f"a{c}b.", f"{c}Foo", f"foo{c}", f"a {c}b", c)] + [""]
    coder, library = t.Encoder(t.public_path(name), keeps), Tokenizer.from_file(t.public_path(name))
    plain = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids.tolist() for ids in coder.encode_all(texts)] == plain
    assert [coder.encode(x).tolist() for x in texts] == plain


@pytest.mark.parametrize(("name", "keeps"), FILES)
def test_library_calls_depend_on_no_number_of_words(name, keeps):
    """The cost of op3 is its calls: words of letters go through the merge model many at a time."""
    coder = t.Encoder(t.public_path(name), keeps)
    calls = []

    class Counted:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, what):
            calls.append(what)
            return getattr(self.real, what)

    coder.library, coder.merges = Counted(coder.library), Counted(coder.merges)
    texts = [prose(k, 300) + "." for k in range(10)]
    assert sum(len(ids) for ids in coder.encode_all(texts))
    assert len(coder.words) > 1_000
    assert len(calls) <= 2 + len(coder.words) // t.UNITS
    calls.clear()
    list(coder.encode_all(texts))
    assert not calls


@pytest.mark.parametrize(("name", "keeps"), FILES)
def test_words_that_came_again_stay(name, keeps, small_limits):
    small_limits(t, MOST_WORDS=300)
    coder, library = t.Encoder(t.public_path(name), keeps), Tokenizer.from_file(t.public_path(name))
    often = "x foo bar, Foo."
    texts = [[often, prose(k, 100)] for k in range(8)]
    sizes = []
    for some in texts:
        found = [ids.tolist() for ids in coder.encode_all(some)]
        assert found == [library.encode(x, add_special_tokens=False).ids for x in some]
        assert "bar," in coder.words
        sizes.append(len(coder.words))
    assert any(b < a for a, b in zip(sizes, sizes[1:], strict=False))
    assert coder.seen[coder.words["bar,"]] < len(texts)


@pytest.mark.parametrize(("name", "keeps"), FILES)
def test_few_words_in_a_row_at_once(name, keeps, small_limits):
    small_limits(t, GATHERED=7, UNITS=3, FEW_UNITS=2)
    coder, library = t.Encoder(t.public_path(name), keeps), Tokenizer.from_file(t.public_path(name))
    texts = [prose(k, n) for k, n in enumerate([1, 3, 3, 1, 9, 7, 0, 6, 2, 30, 1])] + ["a  b", "Foo."]
    plain = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids.tolist() for ids in coder.encode_all(texts)] == plain


@pytest.mark.parametrize(("name", "keeps"), FILES)
def test_memory_starts_anew(name, keeps, small_limits):
    small_limits(t, MOST_WORDS=50, TOGETHER=300)
    library = Tokenizer.from_file(t.public_path(name))
    rows = [(k, prose(k, 60)) for k in range(20)] + [(98, LONG), (99, None)]
    for key, ids in t.documents_ids(rows, t.public_path(name), keeps):
        text = dict(rows)[key] or ""
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def fewest(lengths, capacity):
    """Exact optimum for few pieces."""
    best = len(lengths)
    pieces = sorted(lengths, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + pieces[k] <= capacity:
                bins[j] += pieces[k]
                go(k + 1, bins)
                bins[j] -= pieces[k]
        bins.append(pieces[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def packed(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    segments = p.plan(counts, capacity)
    seen = dict.fromkeys(range(capacity + 1), 0)
    at = {}
    for n in lengths:
        s, o = p.placed(segments, np.array([n]), np.array([seen[n]]))
        seen[n] += 1
        at.setdefault(int(s[0]), []).append((int(o[0]), n))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
    return len(at)


@settings(max_examples=80, deadline=None)
@given(lengths=st.lists(st.integers(1, 20), min_size=1, max_size=11))
def test_plan_is_gapless_and_the_reduction_keeps_the_optimum(lengths):
    """Fixed sets and an optimal packing of the rest are an optimal packing of all."""
    used = packed(lengths, 20)
    best = fewest(lengths, 20)
    assert best <= used <= best + 1
    fixed, left = p.reduce(np.bincount(lengths, minlength=21), 20)
    rest = [n for n, c in enumerate(left) for _ in range(c)]
    assert sum(times for _, times in fixed) + (fewest(rest, 20) if rest else 0) == best


def test_large_counts_are_planned_in_runs():
    counts = np.zeros(2049, np.int64)
    counts[[700, 1024, 1348, 2048, 3]] = [10**9, 10**9 + 1, 10**9, 5, 17]
    segments = p.plan(counts)
    assert len(segments["length"]) < 100
    assert segments["number"].sum() == counts.sum()


def test_packing_of_edge_rows(edges, nothing, spark):
    found = p.pack_documents(edges, keep_ids=True).collect()
    library = Tokenizer.from_file(t.public_path(p.VOCABULARY))
    want = []
    for d, text in edge_documents():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            data = np.array(ids[a : a + 2048], "<u4").tobytes()
            want.append((-1 if d is None else d, k, a, len(data) // 4, zlib.crc32(data)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got) == sorted(want)
    by = {}
    for r in found:
        assert len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
    assert p.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_round_trip(bits):
    r = np.random.default_rng(1)
    for n in (1, 7, 8, 1000, f.BLOCK_IDS):
        ids = r.integers(0, 2**32, n, dtype=np.uint32)
        assert np.array_equal(np.concatenate(list(f.decode_blocks(f.encode_block(ids, bits)))), ids)


@pytest.mark.parametrize("bits", [False, True])
def test_files_read_back(spark, edges, nothing, tmp_path, bits, small_limits):
    small_limits(f, CHUNK_IDS=300)
    f.write_token_files(edges, str(tmp_path / "a"), bits=bits)
    found = sorted(f.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(t.public_path(f.VOCABULARY))
    rows = sorted(((-1 if d is None else d, x or "") for d, x in edge_documents()))
    start = 0
    for r, (d, text) in zip(found, rows, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) == (d, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    index = spark.read.parquet(str(tmp_path / "a/index")).orderBy("first_id").collect()
    assert sum(x.n_ids for x in index) == start and sum(x.n_documents for x in index) == len(rows)
    f.write_token_files(nothing, str(tmp_path / "b"))
    assert f.read_token_files(spark, str(tmp_path / "b")).count() == 0
