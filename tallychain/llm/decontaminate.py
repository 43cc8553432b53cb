"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is one Arrow batch of documents.  Its words become ids of the benchmark's vocabulary
(0: a word that no item has), and a suffix array over the shard lists, in sorted order, every
suffix that could hold a window.  Each window of the benchmark is searched in it by bisection:
the range of suffixes that start with it gives every occurrence.  Documents are whole inside a
shard, so the result of a document never needs a second pass, a shuffle or another task.

The longest verbatim match of a document starts at an occurrence if it holds a window; the two
neighbours of that place among the sorted suffixes of the items give its length.  Shorter ones
are found word by word in the sorted sequences of the items.  Of equally long matches the first
in the document counts, and of the items that have it the smallest as text.

The benchmark is the stated query set.  It is sent to the tasks in blocks of at most
`BLOCK_BYTES` of text; each block searches all shards.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Defined results: NULL and
empty texts have no words and no hits; items without words have no window; repeated rows are
matched one by one; equal items each count; empty tables on either side give no hits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import arrow_schema, batch_of, table, tidied, values

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Words of a shard at most; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Words of a suffix that are kept as its sort key.
KEY_WORDS = 64

WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
SPACED = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b in WORD_BYTES or 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SPACED).split()


NO_MATCH = (0, None, None)


class Block:
    """Items of the benchmark, made ready for the search."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.window = window
        texts = [(item_id, words_of(text)) for item_id, text in items]
        coded = [
            (item_id, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int64))
            for item_id, words in texts
            if words
        ]
        self.kind = ">u2" if len(self.ids) < 65_000 else ">u4"
        self.step = int(self.kind[-1])
        self.items = [(item_id, ids.astype(self.kind).tobytes()) for item_id, ids in coded]
        # Windows, each searched once, with the items that have them.
        self.windows: dict[bytes, set] = {}
        step, depth = self.step, min((len(ids) for _, ids in coded), default=1)
        # Only suffixes that start like a window can hold one; three words tell enough.
        self.depth = min(3, depth, window)
        for item_id, data in self.items:
            n = len(data) // step
            width = min(window, n)
            for i in range(n - width + 1):
                at = i * step
                self.windows.setdefault(data[at : at + width * step], set()).add(item_id)
        self._sort(coded)
        heads = [np.frombuffer(w, self.kind)[: self.depth].astype(np.int64) for w in self.windows]
        self.starts = np.unique([int(self._key(h)[0]) for h in heads]).astype(np.int64)

    def _sort(self, coded: list[tuple]) -> None:
        """Suffixes of the items in order, and the different sequences below a window."""
        end = len(self.ids) + 1  # closes an item; no document has it
        ids = np.concatenate([np.append(x, end) for _, x in coded] or [np.empty(0, np.int64)])
        self.text = ids.astype(self.kind).tobytes()
        self.names = sorted({str(item_id) for item_id, _ in coded})
        at = {name: k for k, name in enumerate(self.names)}
        sizes = np.array([len(x) + 1 for _, x in coded], np.int64)
        name = np.repeat(np.array([at[str(i)] for i, _ in coded], np.int32), sizes)
        # Prefix doubling; beyond the end of its item the order of a suffix is of no matter.
        rank, width, most = ids, 1, max((len(x) for _, x in coded), default=0)
        while True:
            later = np.zeros_like(rank)
            later[: max(len(rank) - width, 0)] = rank[width:] + 1 if width < len(rank) else 0
            both = rank * (rank.max(initial=0) + 2) + later
            rank = np.unique(both, return_inverse=True)[1]
            width *= 2
            if width > most:
                break
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        self.name = name[self.order]
        # Per length: sequences as (code of all words but the last, last word), and smallest name.
        self.lengths: list[tuple[np.ndarray, np.ndarray]] = []
        places, code = np.flatnonzero(ids != end), ids[ids != end]
        for k in range(self.window - 1 if len(ids) else 0):
            if k:
                inside = ids[places + k] != end
                places = places[inside]
                code = code[inside] * (end + 1) + ids[places + k]
            known, code = np.unique(code, return_inverse=True)
            least = np.full(len(known), len(self.names), np.int32)
            np.minimum.at(least, code, name[places])
            self.lengths.append((known, least))
            if not len(places):
                break

    def longest_at(self, text: bytes) -> int:
        """Words of the longest beginning of ``text`` that an item has."""
        step, size = self.step, KEY_WORDS
        while True:
            x = text[: size * step]
            k = bisect_left(self.order, x, key=lambda q: self.text[q * step : q * step + len(x)])
            near = [int(q) * step for q in self.order[max(0, k - 1) : k + 1]]
            n = max(common_words(self.text[q : q + len(x)], x, step) for q in near)
            if n < size or len(x) == len(text):
                return n
            size *= 2

    def smallest_item(self, text: bytes) -> str:
        """Of the items that have ``text``, the smallest."""
        start = {"key": lambda q: self.text[q * self.step : q * self.step + len(text)]}
        low, high = bisect_left(self.order, text, **start), bisect_right(self.order, text, **start)
        return self.names[int(self.name[low:high].min())]

    def short_matches(self, ids: np.ndarray, owner: np.ndarray, docs: int) -> list[tuple]:
        """Per document (``owner`` of each place): its longest match below a window."""
        best = [NO_MATCH] * docs
        places, code = np.arange(len(ids)), ids
        for k, (known, least) in enumerate(self.lengths):
            if k:
                places, code = places[places + k < len(ids)], code[places + k < len(ids)]
                code = code * (len(self.ids) + 2) + ids[places + k]
                inside = ids[places + k] > 0
                places, code = places[inside], code[inside]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            same = known[at] == code if len(known) else np.zeros(len(code), bool)
            places, code = places[same], at[same]
            of = owner[places]
            for j in np.flatnonzero(np.diff(of, prepend=-1)).tolist():  # the first place of each
                best[of[j]] = (k + 1, self.names[least[code[j]]], int(places[j]))
            if not len(places):
                break
        return best

    def _key(self, ids: np.ndarray) -> np.ndarray:
        """The first ``depth`` words at each place as one number."""
        n, base = len(ids) - self.depth + 1, len(self.ids) + 1
        key = np.zeros(max(n, 0), np.int64)
        for k in range(self.depth):
            key = key * base + ids[k : k + len(key)]
        return key

    def coded(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary ids of a document, closed by 0."""
        look = self.ids.get
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter((look(w, 0) for w in words), np.int64, len(words))
        return out

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        key = self._key(ids)
        if not len(self.starts) or not len(key):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.starts, key), len(self.starts) - 1)
        return np.flatnonzero(self.starts[at] == key)


class Shard:
    """Word ids of several documents and the sorted suffixes among them that may match.

    Suffixes are ordered by their first `KEY_WORDS` words; comparisons that run further read
    the ids themselves.
    """

    def __init__(self, docs: list[np.ndarray], block: Block) -> None:
        self.first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])[:-1]
        ids = np.concatenate(docs)
        step = block.step
        self.data = ids.astype(block.kind).tobytes()
        at = block.candidates(ids).tolist()
        pairs = sorted((self.data[p * step : (p + KEY_WORDS) * step], p) for p in at)
        self.keys, self.places = [k for k, _ in pairs], [p for _, p in pairs]

    def document(self, place: int) -> int:
        return int(np.searchsorted(self.first, place, side="right")) - 1


def common_words(a: bytes, b: bytes, step: int) -> int:
    """Length of the common prefix, in words."""
    if a == b:
        return len(a) // step
    n = min(len(a), len(b)) // step
    low, high = 0, n  # the first `low` words are equal
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * step : mid * step] == b[low * step : mid * step]:
            low = mid
        else:
            high = mid - 1
    return low


def search(docs: list[np.ndarray], block: Block, longest: bool = True) -> list[tuple]:
    """Per document: covered spans, items, and its longest match (words, item, place)."""
    shard = Shard(docs, block)
    keys, places, step = shard.keys, shard.places, block.step
    runs: list[list] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]

    def prefixed(prefix: bytes, low: int) -> int:
        # 0xFF bytes are no id, so this bound lies behind all keys that start with `prefix`.
        return bisect_right(keys, prefix + b"\xff" * (step + 1), lo=low)

    for window, owners in block.windows.items() if keys else ():
        low, width = bisect_left(keys, window[: KEY_WORDS * step]), len(window) // step
        for k in range(low, prefixed(window[: KEY_WORDS * step], low)):
            at = places[k] * step
            if shard.data[at : at + len(window)] == window:
                d = shard.document(places[k])
                runs[d].append((places[k] - int(shard.first[d]), width))
                items[d] |= owners
    spans = [merged(r) for r in runs]
    best = longest_matches(docs, shard, block, runs, spans) if longest else [NO_MATCH] * len(docs)
    return [(s, sorted(map(str, i)), x) for s, i, x in zip(spans, items, best, strict=True)]


def longest_matches(docs, shard: Shard, block: Block, runs: list, spans: list) -> list[tuple]:
    """Per document its longest match, at the first place that has it."""
    step, owner = block.step, np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    ids = np.concatenate(docs)
    short = block.short_matches(ids, owner, len(docs))
    out = []
    for d, (first, found, words) in enumerate(zip(shard.first.tolist(), short, docs, strict=True)):
        n, item, at = found
        at = None if at is None else at - first
        data = shard.data[first * step : (first + len(words)) * step] if spans[d] else b""
        starts = sorted({p for p, _ in runs[d]})
        for low, high in spans[d]:
            # All words of a match that holds a window are covered: none reaches beyond the span.
            for p in starts[bisect_left(starts, low) : bisect_left(starts, high)]:
                if high - p < n:
                    break
                m = block.longest_at(data[p * step : high * step])
                if m > n or (m == n and p < at):
                    n, at, item = m, p, None
        if n and item is None:
            item = block.smallest_item(data[at * step : (at + n) * step])
        out.append((n, item, at))
    return out


def better(a: tuple, b: tuple) -> tuple:
    """The longer match; of equal ones the first, then the smallest item."""
    return min(a, b, key=lambda x: (-x[0], x[2] or 0, x[1] or ""))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) runs as disjoint maximal (start, end) spans."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``most`` bytes (a single item may be longer)."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").where("text is not null").toLocalIterator()
    for item_id, text in rows:
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += 4 * len(text)
    if block:
        yield block


FOUND = (
    "n_words long, spans array<struct<start: long, stop: long>>, items array<string>, "
    "longest long, longest_item string, longest_at long"
)


def _shards(batches: Iterator[pa.RecordBatch], at: int, block: Block) -> Iterator[tuple]:
    """(rows, texts as ids) for groups of rows of bounded size."""
    for batch in batches:
        start, docs, size = 0, [], 0
        for i, text in enumerate(values(batch.column(at))):
            ids = block.coded(words_of(text))
            if docs and size + len(ids) > SHARD_WORDS:
                yield batch.slice(start, len(docs)), docs
                start, docs, size = i, [], 0
            docs.append(ids)
            size += len(ids)
        if docs:
            yield batch.slice(start, len(docs)), docs


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id"
) -> DataFrame:
    """Per row of ``docs``: words, covered spans, items (as text) and the longest match.

    Blocks follow each other in one chain of maps, which hands the rows on with what was found
    so far; there is no shuffle, and with a single block no text leaves a task.
    """
    kind = docs.schema[key].dataType.simpleString()
    search_blocks = [Block(items, window) for items in blocks(benchmark)] or [Block([], window)]
    df = docs.select(key, "text")
    for k, block in enumerate(search_blocks):
        last = k == len(search_blocks) - 1
        schema = f"{key} {kind}, " + ("" if last else "text string, ") + FOUND
        df = df.mapInArrow(_finder(block, arrow_schema(schema), last), schema)
    return df


def _finder(block: Block, target: pa.Schema, last: bool):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in _shards(batches, 1, block):
            rows = []
            for i, (ids, found) in enumerate(zip(docs, search(docs, block), strict=True)):
                spans, items, best = found
                if batch.num_columns > 2:  # what earlier blocks found
                    had = [c[i].as_py() for c in batch.columns[3:]]
                    runs = [(x["start"], x["stop"] - x["start"]) for x in had[0]]
                    spans = merged(runs + [(a, b - a) for a, b in spans])
                    items = sorted({*had[1], *items})
                    best = better(tuple(had[2:]), best)
                text = () if last else (batch.column(1)[i].as_py(),)
                spans = [{"start": a, "stop": b} for a, b in spans]
                rows.append((batch.column(0)[i].as_py(), *text, len(ids) - 1, spans, items, *best))
            yield batch_of(rows, target)

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any covered word, with their columns unchanged."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        block = Block(items, window)

        @tidied
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, found in _shards(batches, at, block):
                clean = [not spans for spans, _, _ in search(found, block, longest=False)]
                yield pc.filter(batch, pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', \
'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("\\\n", "")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, width, array_to_string(words[p:p + width - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(10, len(words)) AS width,
               unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p
        FROM b WHERE len(words) > 0)),
grams AS (
  SELECT rid, p, width, array_to_string(words[p:p + width - 1], ' ') AS gram
  FROM (SELECT rid, words, width, unnest(range(1, len(words) - width + 2)) AS p
        FROM d, (SELECT DISTINCT width FROM windows))),
hits AS (SELECT rid, p, g.width, item_id FROM grams g JOIN windows USING (width, gram)),
covered AS (
  SELECT rid, count(DISTINCT w) AS n
  FROM (SELECT rid, unnest(range(p, p + width)) AS w FROM hits) GROUP BY rid),
owners AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN owners o ON o.rid = d.rid
"""
