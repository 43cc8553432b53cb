"""Jaccard join of documents on word shingles with PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets reaches 3/4.

1. *Equal sets* are one node, the smallest key standing for all.
2. *Proof of absence.*  A set of n shingles can only have a partner if at least 3n/4 of its
   shingles occur elsewhere.  Among a fixed 5/16 of all hash values, shingles found in one document
   only are counted; a document with more than n/4 of them has no partner, which is certain.
   A hash that collides only hides such a shingle and never excludes a document wrongly.
3. *Signatures.*  Sets fall into size bands of ratio 4/3, so partners are in the same or the next
   band; instance i holds those of bands i-1 and i.  Sets of a and b shingles that link differ
   in at most (a + b) / 7.  The shingle domain is cut into parts of `SUBPARTS` subparts; if one set
   has more than k / (`DIFFERENT` + 1) parts that count, some part of it differs in at most
   `DIFFERENT` subparts, and leaving out each choice of that many subparts yields a signature that
   both sets share.  Empty signatures are not used: a part counts if more than `DIFFERENT` of its
   subparts hold shingles, and a set left with too few such parts also emits each single shingle
   (if neither set has enough, they share one of these).
4. *Candidates.*  Signatures travel as 32-bit values in packed blocks; equal ones form a
   group, and each member is paired with the smallest one (in small groups also with the next one).
   Pairs travel packed as well and are told once.  Size and a count sketch, whose distance is never
   more than that of the sets, discard pairs that cannot link.
5. *Exact check* on the whole sets: each set's closest pair first, in a few rounds, which connects
   nearly all.  Then only what still crosses components: the other pairs, and within each group
   that has several components all members outside its largest one against all others, block by
   block, as far as the sketches allow.

Blocks merge equal values before they travel, so a group meets in one task as packed lists of
document numbers only; whatever compares members does so in blocks of bounded size, which are dealt
over all tasks.

Defined results: a document without words (NULL, empty) has an empty set and links with nothing,
not even with another empty one; fewer words than a shingle make one shingle; repeated rows share
their class; rows without a key are counted but link with nothing; rows that share a key are one
node with several sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import (
    WordCodes,
    arrow_schema,
    batch_of,
    map_rows,
    mixed,
    partitions_of,
    release,
    table,
    tidied,
    values,
    window_codes,
    written,
)
from tallychain.llm.links import components

SHINGLE = 5
#: Similarity NUMERATOR / DENOMINATOR; the band arithmetic below belongs to 3/4.
NUMERATOR, DENOMINATOR = 3, 4
SUBPARTS, DIFFERENT = 2, 1
SKETCH = 64
#: Documents of a packed block; packed bytes of a bucket; members of a comparison block.
BLOCK_DOCS, BUCKET_BYTES, MEMBERS = 4000, 8_000_000, 1024
#: Members of a group up to which each one is also paired with the next one.
CHAINED = 64
#: Rows of groups around one document that one task compares.
AROUND = 20_000
#: Rounds of closest pairs before all the others are checked.
ROUNDS = 1
#: Of 16 equal shares of the hash values, those whose unique shingles are counted.
COUNTED_SHARES = 5


# --- sets ----------------------------------------------------------------------------------


def shingles(text: str | None, codes: WordCodes, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingle codes of a whole text, ascending."""
    words = codes.of(text or "")
    if not len(words):
        return words
    return np.unique(window_codes(words, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if DENOMINATOR * len(small) < NUMERATOR * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def sketch(codes: np.ndarray) -> np.ndarray:
    """Counts by hash class; the L1 distance of two sketches is at most that of the sets.

    There is a counter to every two shingles or fewer; the count of counters is a power of two,
    so a longer sketch folds to the length of a shorter one.
    """
    size = SKETCH
    while 2 * size < len(codes):
        size *= 2
    place = (codes >> np.uint64(32)) & np.uint64(size - 1)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=size), 255).astype(np.uint8)


def folded(s: np.ndarray, size: int) -> np.ndarray:
    """A sketch (or rows of sketches) with ``size`` counters."""
    s = s.astype(np.int16)
    while s.shape[-1] > size:
        half = s.shape[-1] // 2
        s = np.minimum(s[..., :half] + s[..., half:], 255)
    return s


def distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.abs(folded(x, size) - folded(y, size)).sum(dtype=np.int64))


# --- signatures ----------------------------------------------------------------------------


def band(n: int) -> int:
    """Index of the size band of a non-empty set."""
    low, index = 1, 0
    while n > 4 * low // 3:
        low, index = 4 * low // 3 + 1, index + 1
    return index


def band_top(index: int) -> int:
    low = 1
    for _ in range(index):
        low = 4 * low // 3 + 1
    return 4 * low // 3


def _salt(*numbers: int) -> np.uint64:
    digest = hashlib.blake2b(repr(numbers).encode(), digest_size=8).digest()
    return np.uint64(int.from_bytes(digest, "little"))


def signatures(codes: np.ndarray) -> np.ndarray:
    """64-bit signatures of a non-empty set, those of its own instance and of the next one."""
    own = band(len(codes))
    return np.unique(np.concatenate([_instance(codes, i) for i in (own, own + 1)]))


def _instance(codes: np.ndarray, index: int) -> np.ndarray:
    top, n = band_top(index), len(codes)
    # Shingles in which this set and a partner in the instance may differ.
    k = (n + min(top, DENOMINATOR * n // NUMERATOR)) // 7
    needed = k // (DIFFERENT + 1) + 1  # parts that must count
    parts = 7 * top // 40 + 2
    salt = _salt(index)
    h = mixed(codes ^ salt)
    cell = ((h >> np.uint64(20)) % np.uint64(parts * SUBPARTS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    sums = np.zeros(parts * SUBPARTS, np.uint64)
    sums[cell[first]] = np.add.reduceat(mixed(h[order]), first)
    full = np.zeros(parts * SUBPARTS, bool)
    full[cell[first]] = True
    sums, full = sums.reshape(parts, SUBPARTS), full.reshape(parts, SUBPARTS)
    part = np.arange(parts, dtype=np.uint64)
    out = []
    for left_out in range(SUBPARTS):
        kept = [s for s in range(SUBPARTS) if s != left_out]
        code = mixed(salt ^ (part * np.uint64(SUBPARTS) + np.uint64(left_out)))
        for s in kept:
            code = mixed(code ^ sums[:, s])
        out.append(code[full[:, kept].any(axis=1)])
    if int((full.sum(axis=1) > DIFFERENT).sum()) < needed:
        out.append(mixed(h ^ _salt(index, 1)))
    return np.concatenate(out)


# --- packed blocks -------------------------------------------------------------------------

PACKED = "bucket int, kind int, many boolean, packed binary, docs binary"
#: Kinds of packed rows: value-and-document pairs; documents of one value.
PAIRS, GROUP = 0, 1


def pack_block(found: list[tuple[int, np.ndarray]], buckets: int, groups: bool) -> Iterator[tuple]:
    """Rows of `PACKED` for (document, 64-bit values) of one block.

    Each value travels once, with its smallest document; its ``many`` row tells values that several
    documents of the block share.  With ``groups`` the documents of such values follow.
    """
    ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(v) for _, v in found])
    if not len(ids):
        return
    codes = np.concatenate([v for _, v in found])
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    last = np.concatenate([first[1:], [len(codes)]]) - 1
    many = ids[first] != ids[last]
    if groups:
        for a, b in zip(first[many].tolist(), last[many].tolist(), strict=True):
            members = np.unique(ids[a : b + 1])
            value = codes[a : a + 1]
            for at in range(0, len(members), MEMBERS):
                part = members[at : at + MEMBERS]
                yield (_bucket(value, buckets)[0], GROUP, True, value.tobytes(), part.tobytes())
    codes, ids = codes[first], ids[first]
    place = _bucket(codes, buckets).astype(np.int64) * 2 + many
    order = np.argsort(place, kind="stable")
    codes, ids, place = codes[order], ids[order], place[order]
    borders = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        # 32 bits of a value are enough beside its bucket; one more match costs one more check.
        low = (codes[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
        yield int(place[a]) // 2, PAIRS, bool(place[a] % 2), low.tobytes(), _packed_ids(ids[a:b])


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ids as a base and 32-bit distances where they fit, else as they are."""
    base = int(ids.min())
    if int(ids.max()) - base < 1 << 32:
        return b"\x04" + base.to_bytes(8, "little", signed=True) + (ids - base).astype("<u4").tobytes()
    return b"\x08" + ids.astype("<i8").tobytes()


def _unpacked_ids(data: bytes) -> np.ndarray:
    if data[0] == 4:
        base = int.from_bytes(data[1:9], "little", signed=True)
        return np.frombuffer(data, "<u4", offset=9).astype(np.int64) + base
    return np.frombuffer(data, "<i8", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    block = []
    for batch in batches:
        for row in zip(*map(values, batch.columns), strict=True):
            block.append(row)
            if len(block) == BLOCK_DOCS:
                yield block
                block = []
    if block:
        yield block


def by_bucket(packed: DataFrame) -> DataFrame:
    """Rows of one bucket follow each other in one task."""
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (without bucket) of each bucket."""
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


def _joined_pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, documents, many of all `PAIRS` rows, by value, then document."""
    rows = [r for r in rows if r[0] == PAIRS]
    if not rows:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
    codes = [np.frombuffer(packed, "<u4") for _, _, packed, _ in rows]
    many = np.repeat([m for _, m, _, _ in rows], [len(c) for c in codes])
    codes, ids = np.concatenate(codes), np.concatenate([_unpacked_ids(r[3]) for r in rows])
    order = np.lexsort((ids, codes))
    return codes[order], ids[order], many[order]


# --- the join ------------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, n, digest of every row's set."""
    codes = WordCodes()

    def per_row(doc_id, text) -> tuple:
        s = shingles(text, codes, width)
        return doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()

    return map_rows(docs.select(key, "text"), "doc long, n long, digest binary", per_row)


def unique_counts(docs: DataFrame, key: str, width: int, buckets: int) -> DataFrame:
    """doc, alone: counted shingles that certainly occur in no other document."""
    codes, target = WordCodes(), arrow_schema(PACKED)

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = []
            for doc, text in block:
                s = shingles(text, codes, width)
                found.append((doc, s[(s & np.uint64(15)) < COUNTED_SHARES]))
            # The low bits choose the share: scrambled again, all bits are usable.
            found = [(d, mixed(s)) for d, s in found]
            yield batch_of(list(pack_block(found, buckets, groups=False)), target)

    tasks = partitions_of(docs)
    part, counted = arrow_schema("part int, counts binary"), arrow_schema("doc long, alone long")

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            values_, ids, many = _joined_pairs(rows)
            same = values_[1:] == values_[:-1]
            edge = np.array([False])
            alone = ~(np.concatenate([edge, same]) | np.concatenate([same, edge]) | many)
            doc, n = np.unique(ids[alone], return_counts=True)
            # Counts travel packed: a row for each task that sums them, not for each document.
            to = (mixed(doc.astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
            for k in np.unique(to).tolist():
                pair = np.stack([doc[to == k], n[to == k]])
                yield batch_of([(k, pair.astype("<i8").tobytes())], part)

    @tidied
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = n = np.empty(0, np.int64)
        for batch in batches:
            pairs = [np.frombuffer(x, "<i8").reshape(2, -1) for x in values(batch.column(1))]
            doc, at = np.unique(np.concatenate([doc, *(p[0] for p in pairs)]), return_inverse=True)
            weights = np.concatenate([n, *(p[1] for p in pairs)])
            n = np.bincount(at, weights, len(doc)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64())], schema=counted)

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), "text")
    packed = rows.mapInArrow(pack, PACKED)
    each = by_bucket(packed).mapInArrow(count, "part int, counts binary")
    sums = each.repartition("part").mapInArrow(total, "doc long, alone long")
    return sums


def features(docs: DataFrame, nodes: DataFrame, key: str, width: int) -> DataFrame:
    """doc, n, codes (ascending, packed), sketch of every node."""
    codes = WordCodes()

    def per_row(doc, text) -> tuple:
        s = shingles(text, codes, width)
        return doc, len(s), s.astype("<u8").tobytes(), sketch(s).tobytes()

    rows = docs.select(F.col(key).cast("long").alias("doc"), "text")
    rows = rows.join(nodes.select("doc"), "doc", "left_semi")
    return map_rows(rows, "doc long, n long, codes binary, sketch binary", per_row).where("n > 0")


def packed_pairs(pairs: set[tuple[int, int]], tasks: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed pairs): equal pairs are always in one part."""
    if not pairs:
        return
    rows = np.array(sorted(pairs), np.int64)
    to = mixed(rows[:, 0].astype(np.uint64) ^ mixed(rows[:, 1].astype(np.uint64)))
    to = (to % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for k in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        yield int(to[k[0]]), rows[k].astype("<i8").tobytes()


def told_pairs(packed: DataFrame) -> DataFrame:
    """a, b: every pair of rows (part, pairs) once."""
    target = arrow_schema("a long, b long")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.empty((0, 2), np.int64)
        for batch in batches:
            found = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in values(batch.column(0))]
            told = np.unique(np.concatenate([told, *found]), axis=0)
        for at in range(0, len(told), 100_000):
            columns = [pa.array(told[at : at + 100_000, k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return packed.repartition("part").select("pairs").mapInArrow(run, "a long, b long")


CANDIDATE = "part int, pairs binary, value binary, docs array<long>"


def candidates(sets: DataFrame, buckets: int) -> DataFrame:
    """Groups of equal signatures: rows (part, pairs), each member with the smallest one (and in
    small groups with the next one), packed by the part that will tell them, and rows (value, docs),
    members in parts, of groups with three members or more."""
    target, out = arrow_schema(PACKED), arrow_schema(CANDIDATE)
    tasks = partitions_of(sets)

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = [(d, signatures(np.frombuffer(c, "<u8").astype(np.uint64))) for d, c in block]
            yield batch_of(list(pack_block(found, buckets, groups=True)), target)

    @tidied
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            stars, parts, seen = set(), [], set()
            codes, ids, many = _joined_pairs(rows)
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            if not len(codes):
                continue
            ends = np.concatenate([first[1:], [len(codes)]])
            shared = (ends - first > 1) | np.logical_or.reduceat(many, first)
            first, ends = first[shared], ends[shared]
            wide = {}
            for _, _, value, docs in (r for r in rows if r[0] == GROUP):
                v = int.from_bytes(value, "little") & 0xFFFFFFFF
                wide.setdefault(v, []).append(docs)
            # Two entries of one document each: a pair, without more ado.
            two = (ends - first == 2) & ~np.logical_or.reduceat(np.append(many, False), first)
            low, high = ids[first[two]], ids[first[two] + 1]
            apart = low != high
            stars.update(zip(low[apart].tolist(), high[apart].tolist(), strict=True))
            first, ends = first[~two], ends[~two]
            for v, a, b in zip(codes[first].tolist(), first.tolist(), ends.tolist(), strict=True):
                inner = wide.get(v, ())
                members = np.unique(np.concatenate([ids[a:b], *(np.frombuffer(d, "<i8") for d in inner)]))
                digest = members.tobytes()
                if len(members) < 2 or digest in seen:
                    continue
                seen.add(digest)
                listed = members.tolist()
                stars.update((listed[0], d) for d in listed[1:])
                if len(members) <= CHAINED:
                    stars.update(zip(listed[:-1], listed[1:], strict=True))
                if len(members) > 2:
                    name = hashlib.blake2b(digest, digest_size=16).digest()
                    for at in range(0, len(members), MEMBERS):
                        parts.append((None, None, name, members[at : at + MEMBERS].tolist()))
                if len(parts) > 2000:
                    yield batch_of(parts, out)
                    parts = []
            told = [(part, pairs, None, None) for part, pairs in packed_pairs(stars, tasks)]
            yield batch_of(told + parts, out)

    packed = sets.select("doc", "codes").mapInArrow(pack, PACKED)
    return by_bucket(packed).mapInArrow(group, CANDIDATE)


def possible_pairs(
    n: np.ndarray, rows: list[bytes], of: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places of the sets that could link with set i by sizes and sketches), each pair of
    different classes (``of``) once or twice; the sets of the largest class are nobody's i."""
    size = np.array([len(r) for r in rows])
    class_, members = np.unique(of, return_counts=True)
    small = of != class_[members.argmax()]
    for s in np.unique(size):
        # Sets of this sketch size with each other, and with those of the next size.
        near = np.flatnonzero((size == s) | (size == 2 * s))
        sketches = np.stack([folded(np.frombuffer(rows[k], np.uint8), s) for k in near])
        m = n[near]
        for k in np.flatnonzero(small[near]).tolist():
            i = near[k]
            # Two larger sketches meet at their own size.
            fits = (size[near] == s) | (size[i] == s)
            fits &= DENOMINATOR * np.minimum(m, n[i]) >= NUMERATOR * np.maximum(m, n[i])
            at = np.flatnonzero(fits & (of[near] != of[i]))
            apart = np.abs(sketches[at] - sketches[k]).sum(axis=1, dtype=np.int64)
            yield i, near[at[7 * apart <= m[at] + n[i]]]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link.

    The sets of b travel to a; an ``a`` with very many partners is spread over several tasks.
    """
    spread = pairs.groupBy("a").agg(F.expr("count(*) div 512 + 1").alias("tasks"))
    spread = written(spread, "spread")
    right = pairs.join(spread, "a").select(
        "a", F.pmod(F.xxhash64("b"), "tasks").alias("task"), "b"
    )
    whole = sets.select(F.col("doc").alias("b"), "codes")
    right = right.join(whole, "b").select("a", "task", "b", "codes")
    left = (
        spread.join(sets.select(F.col("doc").alias("a"), "codes"), "a")
        .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"),
                F.lit(None).cast("long").alias("b"), "codes")
    )
    rows = left.unionByName(right).repartition("a", "task").sortWithinPartitions(
        "a", "task", F.asc_nulls_first("b")
    )
    target = arrow_schema("a long, b long")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            out = []
            for a, task, b, codes in zip(*map(values, batch.columns), strict=True):
                s = np.frombuffer(codes, "<u8")
                if (a, task) != at:
                    at, own = (a, task), []
                if b is None:
                    own.append(s)
                elif any(linked(o, s) for o in own):
                    out.append((a, b))
            yield batch_of(out, target)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, apart: the pairs that sizes and sketches do not exclude, with their distance there."""
    sizes = sets.select("doc", "n").distinct()
    each = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a")
    each = each.join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    each = each.where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    for c in "ab":
        own = sets.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        each = each.join(own, [c, f"n{c}"])
    target = arrow_schema("a long, b long, apart long")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, na, nb, sa, sb in zip(*map(values, batch.columns), strict=True):
                d = distance(sa, sb)
                if 7 * d <= na + nb:
                    out.append((a, b, d))
            yield batch_of(out, target)

    found = each.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, apart long")
    return found.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _closest(pairs: DataFrame) -> DataFrame:
    """For every set, its pair with the smallest distance."""
    best = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")
    both = [pairs.groupBy(c).agg(best).select("p.a", "p.b") for c in "ab"]
    return both[0].unionByName(both[1]).distinct()


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    each = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return each.where(
        F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    ).select(*pairs.columns)


def _across(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of one group whose members are in different components so far.

    Only groups with several components are looked at, in blocks of bounded size.
    """
    members = groups.select("value", F.explode("docs").alias("doc")).distinct()
    members = members.join(labels, members["doc"] == labels["node"], "left").select(
        "value", "doc", F.coalesce("component", "doc").alias("component")
    )
    members = written(members, "members")
    several = members.groupBy("value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("doc").alias("first"), F.count("*").alias("size"),
    ).where("low <> high")
    several = several.withColumn("blocks", F.expr(f"size div {MEMBERS} + 1"))
    # Many groups around one document are dealt out to several tasks.
    around = several.groupBy("first").agg(F.sum(F.col("size") * F.col("blocks")).alias("rows"))
    around = around.select("first", F.expr(f"rows div {AROUND} + 1").alias("deals"))
    several = several.join(around, "first").withColumn("deal", F.pmod(F.xxhash64("value"), "deals"))
    several = several.select("value", "first", "blocks", "deal")
    each = members.join(several, "value").join(sets.select("doc", "n", "sketch"), "doc")
    block = F.pmod(F.xxhash64("doc"), "blocks")
    # Each block meets itself and every other one once.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    each = each.withColumn("block", block).withColumn("other", other).select(
        "first", "deal", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "value", (F.col("block") > F.col("other")).alias("late"), "doc", "component", "n", "sketch",
    )
    # Groups around one document come to one task (a large one in its blocks): they mostly hold the
    # same pairs, which are then told once.
    each = each.repartition("first", "deal", "x", "y").drop("deal")
    each = each.sortWithinPartitions("first", "x", "y", "value")
    target, tasks = arrow_schema("part int, pairs binary"), partitions_of(sets)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()

        def compared(rows: list[tuple], alike: bool) -> pa.RecordBatch:
            late, doc, comp, n, sketch_ = zip(*rows, strict=True)
            late, doc, comp, n = (np.array(v) for v in (late, doc, comp, n))
            found = set()
            for i, may in possible_pairs(n, sketch_, comp):
                may = may[doc[may] != doc[i]]
                if not alike:  # pairs inside one of the two blocks are compared elsewhere
                    may = may[late[may] != late[i]]
                own = int(doc[i])
                found.update((min(own, d), max(own, d)) for d in doc[may].tolist())
            fresh = found - told
            if len(told) > 1_000_000:
                told.clear()
            told.update(fresh)
            return batch_of(list(packed_pairs(fresh, tasks)), target)

        at, rows = None, []
        for batch in batches:
            for first, x, y, value, *row in zip(*map(values, batch.columns), strict=True):
                if (first, x, y, value) != at and rows:
                    yield compared(rows, at[1] == at[2])
                    rows = []
                at = (first, x, y, value)
                rows.append(row)
        if rows:
            yield compared(rows, at[1] == at[2])

    return told_pairs(each.mapInArrow(run, "part int, pairs binary"))


def similar_classes(docs: DataFrame, key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id."""
    sets = written(shingle_sets(docs, key, width), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = partitions_of(docs)

    def buckets(packed_bytes: int) -> int:
        """Enough that a bucket fits a task."""
        return max(tasks, packed_bytes // BUCKET_BYTES + 1)

    alone = unique_counts(docs, key, width, buckets(total * COUNTED_SHARES // 2))
    filled = sets.where("n > 0 and doc is not null")
    # Rows that share a key are one node: what one of them counts, the other may not be blamed for.
    shared = filled.groupBy("doc").agg((F.min("digest") != F.max("digest")).alias("shared"))
    open_ = (
        filled.join(shared, "doc").join(alone, "doc", "left")
        .where("shared or 4 * coalesce(alone, 0) <= n").select("doc", "digest")
    )
    # Needed again at the end, where the shingles must not be counted a second time.
    open_ = written(open_, "open")
    chosen = open_.groupBy("digest").agg(F.min("doc").alias("rep"))
    chosen = written(chosen, "nodes")
    release(docs.sparkSession)
    nodes = chosen.select(F.col("rep").alias("doc")).distinct()
    found = written(features(docs, nodes, key, width), "features")
    release(docs.sparkSession)
    size = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = written(candidates(found, buckets(size * 8)), "groups")
    release(docs.sparkSession)
    stars = written(_plausible(told_pairs(groups.where("part is not null")), found), "pairs")
    # Closest pairs first: they connect nearly all, and what is connected needs no more checks.
    tested = written(_closest(stars), "tested")
    links = written(verified(tested, found), "verified")
    for _ in range(ROUNDS):
        release(docs.sparkSession)
        labels = written(components(links), "labels")
        stars = written(_crossing(stars.join(tested, ["a", "b"], "left_anti"), labels), "pairs")
        if stars.isEmpty():
            break
        tested = written(_closest(stars), "tested")
        links = written(links.unionByName(verified(tested, found)), "verified")
    # Whatever still crosses components: the other pairs, and all members of mixed groups.
    release(docs.sparkSession)
    labels = written(components(links), "labels")
    stars = _crossing(stars.join(tested, ["a", "b"], "left_anti"), labels).select("a", "b")
    mixed_groups = groups.where("value is not null").select("value", "docs")
    rest = written(stars.unionByName(_across(mixed_groups, labels, found)).distinct(), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(written(verified(rest, found), "verified"))
        release(docs.sparkSession)
    # Equal sets, and rows that share a key, link as well.
    same = open_.join(chosen, "digest").where("doc <> rep").select(
        F.col("rep").alias("a"), F.col("doc").alias("b")
    )
    final = components(links.unionByName(same))
    return sets.join(final, sets["doc"] == final["node"], "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of every class, that of its smallest key, with its columns unchanged.

    Of rows that share this key and their text, one stays.  Rows without a key all stay.
    """
    classes = similar_classes(docs, key)
    gone = classes.where(f"{key} <> component_id").select(key).distinct()
    keyed = docs.where(F.col(key).isNotNull()).join(gone, key, "left_anti")
    # The join has dealt the rows by key already.
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    place = F.row_number().over(Window.partitionBy(key, text).orderBy(key))
    name = "place" + "_" * max(map(len, docs.columns))
    kept = keyed.withColumn(name, place).where(F.col(name) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(key).isNull()))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_classes(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
         ELSE array_to_string(words[p:p + 4], ' ') END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p
        FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c.n >= 75 * (s.n + t.n - c.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.b FROM reach r
  JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c
  ON c.doc_id = d.doc_id
"""
