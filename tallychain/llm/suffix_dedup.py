"""Removal of repeated passages by difference-cover suffix arrays over exchanged suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller
key.  The operator sorts the suffixes of the corpus by their first `LENGTH` bytes and compares
neighbours.  Which suffixes meet in a task is decided so that equal ones always do:

1. *Anchors.*  Every window of `LENGTH` bytes has one anchor, its `GRAM`-byte string with the
   smallest hash.  Equal windows have equal anchors at equal distances.
2. *Shrinking.*  Hashes of anchors are counted over the corpus; a window whose anchor occurs in one
   document only cannot repeat elsewhere and takes no further part.
3. *Exchange.*  Neighbouring windows with one anchor travel as one piece of text to the task of
   that anchor.  Equal pieces of a block are merged first: the copies are gone for good because
   the smallest document of the block has them, and that one travels.
4. *Difference cover.*  A task sorts all suffixes of its pieces with the cover {1, 2} modulo 3:
   triples at covered places are sorted and named, the string of names is sorted recursively (until a
   name stands for `LENGTH` bytes or all differ), the remaining suffixes are sorted by their first
   byte and the next rank, and both lists are merged.
5. *Neighbours* with `LENGTH` equal bytes form a group; every window of it that is not in the group's
   smallest document is removed.

Comparisons of text are exact and hashes only route, but for whole copies, which are told by length
and SHA-256.  An anchor with very much different text around it is dealt out again by whole windows,
so it is no single task's work.

Defined results: NULL and empty texts have no bytes and lose none; a whole copy of a document
with a smaller key loses everything if it has `LENGTH` bytes; rows without a key lose nothing and
remove nothing; rows that share a key are one document, given by the smallest of their texts (a row
with another text keeps everything and removes nothing); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import (
    arrow_schema,
    batch_of,
    mixed,
    partitions_of,
    release,
    table,
    values,
    written,
)

LENGTH = 50
GRAM = 24
#: Bytes of text that are searched for anchors together, and of pieces that are merged together.
BLOCK_BYTES = 8_000_000
CACHE_BYTES = 100_000
#: Characters that are sorted together: three names of the cover must fit into 63 bits.
SORT_CHARS = 1_900_000
#: Characters of several anchors that are sorted together, for the sake of the cache.
TOGETHER_CHARS = 300_000
#: Packed bytes of a bucket, and those of text beyond which a bucket is dealt out by windows.
BUCKET_BYTES, LIMIT_BYTES = 16_000_000, 96_000_000
#: Places of windows that are held at once when a bucket is dealt out by windows.
PORTION_WINDOWS = 500_000


# --- the difference cover ------------------------------------------------------------------


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys and their dense ranks from 1."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return order, names


def suffix_order(s: np.ndarray, depth: int = LENGTH, covered: int = 1) -> np.ndarray:
    """Suffixes of ``s`` (numbers from 0) in order of their first ``depth`` characters at least.

    ``covered`` is the count of characters that one number of ``s`` stands for.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    base = int(s.max()) + 1
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    one, two, zero = (np.arange(k, n, 3) for k in (1, 2, 0))
    sample = np.concatenate([one, two])
    triples = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    order, names = _names(triples)
    if 3 * covered < depth and names.max() < len(sample):
        # The string of names: both residues, apart, so that no triple runs from one to the other.
        string = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        deeper = suffix_order(string, depth, 3 * covered)
        deeper = deeper[deeper != len(one)]
        order = deeper - (deeper > len(one))
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    top = int(names.max()) + 1
    # The rest: first character, then the rank of the covered suffix behind it.
    rest_key = padded[zero] * top + rank[zero + 1]
    rest = zero[np.argsort(rest_key, kind="stable")]
    # Merge: beside residue 1 one character decides, beside residue 2 two characters do.
    ordered = sample[order]
    from_one = ordered % 3 == 1
    a, b = ordered[from_one], ordered[~from_one]
    key_a, rest_a = (padded[x] * top + rank[x + 1] for x in (a, rest))
    key_b, rest_b = ((padded[x] * base + padded[x + 1]) * top + rank[x + 2] for x in (b, rest))
    place = np.arange(len(ordered))
    place[from_one] += np.searchsorted(rest_a, key_a, side="left")
    place[~from_one] += np.searchsorted(rest_b, key_b, side="left")
    rest_place = (
        np.arange(len(rest))
        + np.searchsorted(key_a, rest_a, side="right")
        + np.searchsorted(key_b, rest_b, side="right")
    )
    # Suffixes that agree in `depth` characters may claim one place; either order will do.
    both = np.concatenate([ordered, rest])
    return both[np.argsort(np.concatenate([place, rest_place]), kind="stable")]


def repeated_windows(pieces: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at each place of the joined pieces (one byte apart) where a window starts that a
    piece of a smaller document also has."""
    joined = b"\0".join(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(joined, np.uint8)
    s = text.astype(np.int64) + 1
    s[starts[1:] - 1] = 0
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[: len(s)]
    valid = np.arange(len(s)) + length <= (starts + sizes)[owner]
    order = suffix_order(s)
    order = order[valid[order]]
    # Equal neighbours: compare the windows themselves, in slices of bounded size.
    same = np.zeros(len(order), bool)
    views = np.lib.stride_tricks.sliding_window_view(text, length)
    for at in range(1, len(order), 100_000):
        k = slice(at, at + 100_000)
        before = slice(at - 1, at - 1 + len(order[k]))
        same[k] = (views[order[k]] == views[order[before]]).all(axis=1)
    out = np.zeros(len(s), bool)
    if len(order):
        first = np.flatnonzero(~same)
        doc = docs[owner[order]]
        smallest = np.minimum.reduceat(doc, first)
        out[order] = doc > np.repeat(smallest, np.diff(np.append(first, len(order))))
    return out


#: Odd numbers (fixed values).
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

# --- anchors -------------------------------------------------------------------------------


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Pieces of the texts: text number, start, count of windows, hash of the anchor."""
    parts, first, size = [], 0, 0
    for k, text in enumerate(texts):  # in portions that stay in a processor's cache
        size += len(text)
        if size > CACHE_BYTES or k == len(texts) - 1:
            number, *rest = _anchors(texts[first : k + 1])
            parts.append((number + first, *rest))
            first, size = k + 1, 0
    return tuple(np.concatenate(p) for p in zip(*(parts or [_anchors([])]), strict=True))


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    empty = np.empty(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes at each place as one number
        data = data[:-step] | data[step:] << np.uint64(8 * step)
    # GRAM = 3 * 8 bytes; odd factors keep the three apart before the scrambling.
    h = mixed(data[:-16] * FACTORS[0] + data[8:-8] * FACTORS[1] + data[16:] * FACTORS[2])
    # The leftmost smallest hash of each window, by doubling.
    low, place = h, np.arange(len(h))
    span, grams = 1, LENGTH - GRAM + 1
    while span < grams:
        step = min(span, grams - span)
        left = low[:-step] <= low[step:]
        place = np.where(left, place[:-step], place[step:])
        low = np.where(left, low[:-step], low[step:])
        span += step
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    valid = np.arange(len(low)) + LENGTH <= ends[owner]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True))
    stop = stop[np.searchsorted(stop, start)] if len(start) else start
    text = owner[start]
    return text, start - (ends - sizes)[text], stop - start + 1, low[start]


# --- packed rows ---------------------------------------------------------------------------

PACKED = "bucket int, kind int, data binary"
#: Kinds of rows of the counting exchange: anchors; documents' repeated anchors.
ANCHORS, KNOWN = 0, 1
#: Kinds of rows that meet a document: it is a copy; repeated anchors or spans; its text.
COPY, FOUND, TEXT = 0, 1, 2
MEET = "doc long, kind int, data binary"


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit, 32-bit or 8-bit numbers, each with its length in front."""
    parts = []
    for a in arrays:
        parts += [len(a).to_bytes(4, "little"), a.tobytes()]
    return b"".join(parts)


def _arrays(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(np.frombuffer(data, kind, n, at + 4))
        at += 4 + n * np.dtype(kind).itemsize
    return out


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(0xFFFFFFFF)).astype("<u4")


def _spread(codes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its codes)."""
    bucket = _bucket(codes, buckets)
    order = np.argsort(bucket, kind="stable")
    borders = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _per_document(ids: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its 32-bit codes packed); ids ascending."""
    borders = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1, append=ids[-1:] + 1))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield int(ids[a]), codes[a:b].tobytes()


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(*map(values, batch.columns), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


# --- 2: anchors that occur in several documents ---------------------------------------------


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """doc, kind (`FOUND`), data: 32 bits of each anchor that several documents have."""
    target, tasks = arrow_schema(PACKED), partitions_of(texts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _text_blocks(batches):
            text, _, _, codes = anchors(block)
            doc = np.array(ids, np.int64)[text]
            order = np.lexsort((doc, codes))
            doc, codes = doc[order], codes[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
            doc, codes = doc[fresh], codes[fresh]
            rows = []
            if len(doc):
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                several = np.diff(np.append(first, len(codes))) > 1
                known = np.repeat(several, np.diff(np.append(first, len(codes))))
                # Repeated within the block: settled for its documents; one tells the others.
                order = np.argsort(doc[known], kind="stable")
                for d, data in _per_document(doc[known][order], _short(codes[known][order])):
                    rows.append((d % buckets, KNOWN, d.to_bytes(8, "little", signed=True) + data))
                doc, codes = doc[first], codes[first]
                for bucket, at in _spread(codes, buckets):
                    base = int(doc[at].min())
                    near = int(doc[at].max()) - base < 1 << 32
                    docs = (doc[at] - base).astype("<u4") if near else doc[at]
                    head = np.array([base if near else 0, near], "<i8")
                    flags = several[at].astype(np.uint8)
                    raw = docs.view(np.uint8) if near else docs.astype("<i8").view(np.uint8)
                    rows.append((bucket, ANCHORS, _bytes(head, _short(codes[at]), flags, raw)))
            yield batch_of(rows, target)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_by_bucket(batches):
            out, parts = [], []
            for kind, data in rows:
                if kind == KNOWN:
                    out.append((int.from_bytes(data[:8], "little", signed=True), FOUND, data[8:]))
                    continue
                head, codes, flags, raw = _arrays(data, "<i8", "<u4", np.uint8, np.uint8)
                docs = raw.view("<u4" if head[1] else "<i8").astype(np.int64) + head[0]
                parts.append((codes, docs, flags))
            if parts:
                codes, docs, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(codes, kind="stable")
                c = codes[order]
                same = c[1:] == c[:-1]
                shared = np.zeros(len(c), bool)
                shared[1:] |= same
                shared[:-1] |= same
                # Where a block has several documents for it, the block knows already.
                order = order[shared]
                local = np.zeros(len(order), bool) | (flags[order] > 0)
                ids, c = docs[order][~local], codes[order][~local]
                by_doc = np.argsort(ids, kind="stable")
                out += [(d, FOUND, x) for d, x in _per_document(ids[by_doc], c[by_doc])] if len(ids) else []
            # Packed for the tasks that gather them: no row for each document and bucket.
            to: dict[int, list[bytes]] = {}
            for doc, _, data in out:
                to.setdefault(doc % tasks, []).append(_entry(doc, data))
            rows = [(k, KNOWN, b"".join(parts)) for k, parts in to.items()]
            yield batch_of(rows, target)

    return _gathered(_by_bucket(texts.mapInArrow(pack, PACKED)).mapInArrow(count, PACKED))


def _entry(doc: int, data: bytes) -> bytes:
    """What was found for a document, as one of many in a packed row."""
    return doc.to_bytes(8, "little", signed=True) + len(data).to_bytes(4, "little") + data


def _gathered(packed: DataFrame) -> DataFrame:
    """doc, kind (`FOUND`), data: the entries of rows of `PACKED`, joined by document in blocks."""
    target = arrow_schema(MEET)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        size = 0
        for batch in batches:
            for data in values(batch.column(2)):
                at = 0
                while at < len(data):
                    doc = int.from_bytes(data[at : at + 8], "little", signed=True)
                    n = int.from_bytes(data[at + 8 : at + 12], "little")
                    found.setdefault(doc, []).append(data[at + 12 : at + 12 + n])
                    at += 12 + n
                size += len(data)
                if size > BLOCK_BYTES:
                    yield batch_of([(d, FOUND, b"".join(p)) for d, p in found.items()], target)
                    found, size = {}, 0
        yield batch_of([(d, FOUND, b"".join(p)) for d, p in found.items()], target)

    return packed.repartition("bucket").mapInArrow(gather, MEET)


def _rows_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    last, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*map(values, batch.columns), strict=True):
            if bucket != last and rows:
                yield rows
                rows = []
            last = bucket
            rows.append(row)
    if rows:
        yield rows


# --- 3: pieces ------------------------------------------------------------------------------


class _Spans:
    """Spans that go, as rows of `PACKED` for the tasks that gather them (buckets below zero).

    A row holds the spans of many documents, so there is none for each document and bucket.
    """

    def __init__(self, tasks: int) -> None:
        self.tasks, self.parts, self.size = tasks, {}, 0

    def add(self, gone: list[tuple[int, int, int]]) -> Iterator[tuple]:
        for doc, data in _packed_spans(gone):
            entry = _entry(doc, data)
            self.parts.setdefault(doc % self.tasks, []).append(entry)
            self.size += len(entry)
        if self.size > BLOCK_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        rows = [(-1 - k, FOUND, b"".join(parts)) for k, parts in self.parts.items()]
        self.parts, self.size = {}, 0
        yield from rows


def _packed_pieces(
    pieces: dict[bytes, list[tuple[int, int]]], codes: dict[bytes, int], buckets: int, spans: _Spans
) -> Iterator[tuple]:
    """Rows of `PACKED`: every piece with the places of its smallest document; all others go."""
    gone, kept = [], []
    for piece, places in pieces.items():
        smallest = min(d for d, _ in places)
        for d, start in places:
            if d == smallest:
                kept.append((piece, d, start))
            else:
                gone.append((d, start, start + len(piece)))
    if kept:
        code = np.array([codes[p] for p, _, _ in kept], np.uint64)
        for bucket, at in _spread(code, buckets):
            at = at[np.argsort(code[at], kind="stable")].tolist()
            docs = np.array([kept[k][1] for k in at], "<i8")
            starts = np.array([kept[k][2] for k in at], "<i8")
            sizes = np.array([len(kept[k][0]) for k in at], "<u4")
            text = np.frombuffer(b"".join(kept[k][0] for k in at), np.uint8)
            data = _packed(_bytes(docs, starts, sizes, _short(code[at]), text))
            yield bucket, TEXT, data
    yield from spans.add(gone)


def _packed_spans(spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """Per document: its key; pairs of start and stop, merged where they touch."""
    spans.sort()
    doc, starts, stops = None, [], []
    for d, a, b in [*spans, (None, 0, 0)]:
        if d != doc:
            if starts:
                yield doc, np.array([starts, stops], "<i8").T.tobytes()
            doc, starts, stops = d, [], []
        if starts and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], bytes, bool]]:
    """(document, what was found, text, whether it is a copy) per text row, in order of documents."""
    last, found, copy = object(), [], False
    for batch in batches:
        for doc, kind, data in zip(*map(values, batch.columns), strict=True):
            if doc != last:
                last, found, copy, own = doc, [], False, None
            if kind == COPY:
                copy = True
            elif kind == FOUND:
                found.append(data)
            else:
                own = data if own is None else own
                same = data == own  # rows that share a key but not a text
                yield doc, found if same else [], data, copy and same


def pieces_of(met: DataFrame, buckets: int) -> DataFrame:
    """Rows of `PACKED`: the windows with repeated anchors as pieces of text."""
    target, tasks = arrow_schema(PACKED), partitions_of(met)

    def search(ids: list[int], texts: list[bytes], known: list[np.ndarray], spans: _Spans) -> list[tuple]:
        text, start, count, codes = anchors(texts)
        owner = np.repeat(np.arange(len(known)), [len(k) for k in known])
        wanted = np.unique(owner.astype(np.uint64) << np.uint64(32) | np.concatenate(known).astype(np.uint64))
        hit = np.isin(text.astype(np.uint64) << np.uint64(32) | _short(codes).astype(np.uint64), wanted)
        pieces, values_ = {}, {}
        for t, a, n, code in zip(*(x[hit].tolist() for x in (text, start, count, codes)), strict=True):
            piece = texts[t][a : a + n - 1 + LENGTH]
            pieces.setdefault(piece, []).append((ids[t], a))
            values_[piece] = code
        return list(_packed_pieces(pieces, values_, buckets, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, known, size, last, spans = [], [], [], 0, None, _Spans(tasks)
        for doc, found, text, copy in _met(batches):
            if copy or not found or doc == last:
                continue
            last = doc
            ids.append(doc)
            texts.append(text)
            known.append(np.unique(np.frombuffer(b"".join(found), "<u4")))
            size += len(text)
            if size > BLOCK_BYTES // 2:
                yield batch_of(search(ids, texts, known, spans), target)
                ids, texts, known, size = [], [], [], 0
        if ids:
            yield batch_of(search(ids, texts, known, spans), target)
        yield batch_of(list(spans.rest()), target)

    return met.mapInArrow(run, PACKED)


# --- 4 and 5: sorted suffixes ---------------------------------------------------------------


def _sorted_spans(pieces: dict[bytes, list[tuple[int, int]]], codes: dict[bytes, int], limit: int):
    """(spans that go, pieces left over): left over are those of an anchor with too much text."""
    gone, distinct, left = [], [], {}
    for piece, places in pieces.items():
        smallest = min(d for d, _ in places)
        gone += [(d, a, a + len(piece)) for d, a in places if d != smallest]
        distinct.append((codes[piece], piece, smallest))
    distinct.sort()
    batch, size, k = [], 0, 0

    def settle() -> None:
        if len(batch) < 2:
            return
        flags = repeated_windows([p for p, _ in batch], np.array([d for _, d in batch], np.int64))
        starts = np.cumsum([0] + [len(p) + 1 for p, _ in batch])
        edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        owner = np.searchsorted(starts, first, side="right") - 1
        for k, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(),
                           (last - starts[owner]).tolist(), strict=True):
            piece, d = batch[k]
            gone.extend((d, o + a, o + b - 1 + LENGTH) for own, o in pieces[piece] if own == d)

    while k < len(distinct):
        end, group = k, 0
        while end < len(distinct) and distinct[end][0] == distinct[k][0]:
            group += len(distinct[end][1]) + 1
            end += 1
        if len({d for _, _, d in distinct[k:end]}) < 2:
            pass  # one text around the anchor, or one document: nothing to compare with
        elif group > limit:  # too much for one sort
            left.update((p, pieces[p]) for _, p, _ in distinct[k:end])
        else:
            if size + group > min(limit, TOGETHER_CHARS):
                settle()
                batch, size = [], 0
            batch += [(p, d) for _, p, d in distinct[k:end]]
            size += group
        k = end
    settle()
    return gone, left


def _windows(piece: bytes, places: list[tuple[int, int]]) -> Iterator[tuple[bytes, list]]:
    for k in range(len(piece) - LENGTH + 1):
        yield piece[k : k + LENGTH], [(d, a + k) for d, a in places]


def _window_code(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little")


def resolve(pieces: DataFrame, buckets: int, limit_bytes: int, limit_chars: int) -> DataFrame:
    """Rows of `PACKED`: spans that go (below zero), and windows of what was too much for a task."""
    target, tasks = arrow_schema(PACKED), partitions_of(pieces)

    def again(pieces: dict, spans: _Spans) -> Iterator[list[tuple]]:
        """By whole windows, in portions: equal windows of two portions meet where they are sent."""
        windows, codes, size = {}, {}, 0
        for piece, places in pieces.items():
            for window, at in _windows(piece, places):
                windows.setdefault(window, []).extend(at)
                codes[window] = _window_code(window)
                size += len(at)
            if size > PORTION_WINDOWS:
                yield list(_packed_pieces(windows, codes, buckets, spans))
                windows, codes, size = {}, {}, 0
        yield list(_packed_pieces(windows, codes, buckets, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, codes, size, over, spans = None, {}, {}, 0, False, _Spans(tasks)

        def finish() -> Iterator[pa.RecordBatch]:
            left = pieces
            if not over and pieces:
                gone, left = _sorted_spans(pieces, codes, limit_chars)
                yield batch_of(list(spans.add(gone)), target)
            for rows in again(left, spans):
                yield batch_of(rows, target)

        for batch in batches:
            for bucket, kind, data in zip(*map(values, batch.columns), strict=True):
                if kind == FOUND:  # spans pass
                    yield batch_of([(bucket, FOUND, data)], target)
                    continue
                if bucket != last:
                    yield from finish()
                    last, pieces, codes, size, over = bucket, {}, {}, 0, False
                docs, starts, sizes, short, text = _arrays(_unpacked(data), "<i8", "<i8", "<u4", "<u4", np.uint8)
                whole, ends = text.tobytes(), np.cumsum(sizes)
                for d, a, n, end, c in zip(*(x.tolist() for x in (docs, starts, sizes, ends, short)), strict=True):
                    piece = whole[end - n : end]
                    if piece not in pieces:
                        size += n
                    pieces.setdefault(piece, []).append((d, a))
                    codes[piece] = c
                if size > limit_bytes:
                    over = True
                    for rows in again(pieces, spans):
                        yield batch_of(rows, target)
                    pieces, codes, size = {}, {}, 0
        yield from finish()
        yield batch_of(list(spans.rest()), target)

    return pieces.mapInArrow(run, PACKED)


# --- the operator ---------------------------------------------------------------------------

RESULT = "doc long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"


def _spans(found: list[bytes], n: int) -> list[tuple[int, int]]:
    spans = []
    for data in found:
        spans += np.frombuffer(data, "<i8").reshape(-1, 2).tolist()
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out if a < n]


def _removed(met: DataFrame) -> DataFrame:
    target = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for doc, found, text, copy in _met(batches):
            n = len(text)
            spans = ([(0, n)] if n >= LENGTH else []) if copy else _spans(found, n)
            parts, at = [], 0
            for a, b in spans:
                parts.append(text[at:a])
                at = b
            kept = b"".join([*parts, text[at:]])
            rows.append((doc, n, [{"start": a, "stop": b} for a, b in spans], kept))
            size += n
            if size > BLOCK_BYTES:
                yield batch_of(rows, target)
                rows, size = [], 0
        yield batch_of(rows, target)

    return met.mapInArrow(run, RESULT)


def _meeting(*parts: DataFrame) -> DataFrame:
    """What belongs to one document, its text last, in one stream."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.repartition("doc").sortWithinPartitions("doc", "kind", "data")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    limit_bytes: int = LIMIT_BYTES,
    limit_chars: int = SORT_CHARS,
) -> DataFrame:
    """doc, n_bytes, spans (removed byte runs), kept (remaining bytes), one row per row of ``docs``."""
    spark = docs.sparkSession
    raw = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    digest = F.sha2("data", 256).alias("sha")
    digests = raw.where("doc is not null").select("doc", F.octet_length("data").alias("n"), digest)
    digests = written(digests, "digests")
    whole = digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = partitions_of(docs)

    def buckets(packed_bytes: int) -> int:
        return max(tasks, packed_bytes // BUCKET_BYTES + 1)

    # A key with several texts stands for the smallest of them.
    per_key = digests.groupBy("doc").agg(F.min("sha").alias("sha"), F.max("sha").alias("other"), F.min("n").alias("n"))
    per_key = written(per_key, "keys")
    several = written(per_key.where("sha <> other").select("doc"), "several-texts")
    smallest = raw.join(several, "doc", "left_semi").groupBy("doc").agg(F.min("data").alias("data"))
    alone = per_key.where("sha = other").select("doc", "n", "sha")
    own = alone.unionByName(smallest.select("doc", F.octet_length("data").alias("n"), digest))
    own = written(own, "texts-of-keys")
    first_of = own.groupBy("n", "sha").agg(F.min("doc").alias("rep"), F.count("*").alias("times"))
    copies = own.join(first_of.where("times > 1"), ["n", "sha"]).where("doc > rep").select("doc")
    copies = written(copies.select("doc", F.lit(COPY).alias("kind"), F.lit(b"").alias("data")), "copies")
    texts = raw.where("doc is not null").select("doc", F.lit(TEXT).alias("kind"), "data")
    known = written(repeated_anchors(texts.select("doc", "data"), buckets(whole * 2 // 3)), "anchors")
    release(spark)
    found = pieces_of(_meeting(copies, known, texts), buckets(whole // 8))
    first = written(resolve(_by_bucket(found), buckets(whole // 8), limit_bytes, limit_chars), "spans")
    release(spark)
    spans = first.where("bucket < 0")
    # Windows of overfull anchors: equal ones meet, and there is nothing left to sort among them.
    rest = first.where("bucket >= 0")
    second = resolve(_by_bucket(rest), 1, 1 << 62, 1 << 62).where("bucket < 0")
    found = _gathered(spans.unionByName(second))
    without = raw.where("doc is null").select(
        "doc", F.octet_length("data").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"), F.col("data").alias("kept"),
    )
    return _removed(_meeting(copies, found, texts)).unionByName(without)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
