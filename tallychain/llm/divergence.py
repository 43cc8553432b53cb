"""Which sources of a language use other terms than the rest: counts of packed, sorted terms.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII.  Tasks count them in
numpy, by length: terms of up to 8 bytes are packed into one unsigned 64-bit word, of up to 16 into
two, and sorted by radix, 16 bits at a time; longer terms are sorted as bytes, in one bucket per
length.  As terms enter in the order of their groups and documents and the sorts are stable, runs
of equal (term, group) give the occurrences and the runs inside them the documents.  Runs of many
pieces of text are merged the same way before a task hands them on, and Spark adds them up.

A term's count per source and per language is turned into a smoothed share in units of 1e-9, in
exact integers.  Two sources differ by the sum of the differences of their shares over all kept
terms.  For it, the shares of one term form a row (a block of at most `BLOCK` sources against
another), rows are spread over all tasks, and each task adds up the differences of its rows for all
pairs of the block at once: what leaves a task is one sum per pair of sources, never per term.

Memory: a text longer than `PIECE` is counted in pieces that end between terms; a task holds one
piece, and at most `HELD` merged runs.

Defined results: NULL text, language and source read as ''.  Every row is a document of its own, so
repeated rows and keys count again.  A group without kept terms has value 0 against others of a
language without kept terms, and no rows of part ``term``.  A language with one source has no rows
of part ``pair``.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import table, written

MIN_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Bytes of text counted at once.
PIECE = 2 << 20
#: Merged runs that a task holds before it hands them on.
HELD = 1 << 19
#: Sources whose differences are added up together.
BLOCK = 64


def _term_bytes() -> bytes:
    table_ = bytearray(range(256))
    for b in range(128):
        table_[b] = ord(chr(b).lower()) if chr(b).isalpha() else 0
    return bytes(table_)


#: Letters in lower case, bytes beyond ASCII as they are, all else 0.
TERM_BYTES = _term_bytes()
#: The first n bytes of a word.
HEAD = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by unsigned words, most significant word first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word[order] >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                # numpy sorts 16-bit numbers by radix.
                order = order[np.argsort(digit, kind="stable")]
    return order


class Runs:
    """Counts of (term, group) for terms of one bucket; ``keys`` are words, or one byte column."""

    def __init__(self, keys: list[np.ndarray], group, n, docs) -> None:
        self.keys, self.group, self.n, self.docs = keys, group, n, docs

    def __len__(self) -> int:
        return len(self.group)

    @staticmethod
    def order(keys: list[np.ndarray]) -> np.ndarray:
        if keys[0].dtype.kind == "S":
            return np.argsort(keys[0], kind="stable")
        return radix_order(keys)

    @classmethod
    def counted(cls, keys: list[np.ndarray], doc: np.ndarray, group_of: np.ndarray) -> Runs:
        """Runs of single occurrences that come in the order of their groups and documents."""
        order = cls.order(keys)
        keys, doc = [k[order] for k in keys], doc[order]
        group = group_of[doc]
        new_term = _changes(*keys)
        starts = np.flatnonzero(new_term | _changes(group))
        docs = np.add.reduceat((new_term | _changes(doc)).astype(np.int64), starts)
        n = np.diff(np.append(starts, len(doc)))
        return cls([k[starts] for k in keys], group[starts], n, docs)

    @classmethod
    def merged(cls, parts: list[Runs], one_document: bool = False) -> Runs:
        keys = [np.concatenate(k) for k in zip(*(p.keys for p in parts), strict=True)]
        group, n, docs = (
            np.concatenate([getattr(p, c) for p in parts]) for c in ("group", "n", "docs")
        )
        first = np.argsort(group, kind="stable")
        order = first[cls.order([k[first] for k in keys])]
        keys, group, n, docs = [k[order] for k in keys], group[order], n[order], docs[order]
        starts = np.flatnonzero(_changes(*keys, group))
        add = np.maximum if one_document else np.add
        return cls(
            [k[starts] for k in keys], group[starts],
            np.add.reduceat(n, starts), add.reduceat(docs, starts),
        )

    def terms(self) -> pa.Array:
        """The terms as bytes; none of them holds a zero."""
        if self.keys[0].dtype.kind == "S":
            rows = self.keys[0].view(np.uint8).reshape(len(self), -1)
        else:
            rows = np.stack(self.keys, axis=1).astype(">u8").view(np.uint8)
        used = rows != 0
        ends = np.zeros(len(self) + 1, np.int32)
        np.cumsum(used.sum(axis=1), out=ends[1:])
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(rows[used].tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(self), buffers)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def count_terms(data: bytes, starts: np.ndarray, group_of: np.ndarray) -> dict[int, Runs]:
    """Runs by bucket (1 and 2: words; above: bytes of a term) over joined, translated texts.

    ``starts`` are the texts' places in ``data``, which has a zero between them.
    """
    flat = np.frombuffer(data + bytes(17), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = flat[: len(data)] != 0
    edge = np.diff(inside)
    begin = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - begin
    doc = np.searchsorted(starts, begin, side="right") - 1
    # The word that starts at any byte, without copying.
    word_at = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
    out: dict[int, Runs] = {}
    short = length <= 8
    if short.any():
        keys = [word_at[begin[short]].astype(np.uint64) & HEAD[length[short]]]
        out[1] = Runs.counted(keys, doc[short], group_of)
    middle = (length > 8) & (length <= 16)
    if middle.any():
        at = begin[middle]
        tail = word_at[at + 8].astype(np.uint64) & HEAD[length[middle] - 8]
        out[2] = Runs.counted([word_at[at].astype(np.uint64), tail], doc[middle], group_of)
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]):
        chosen = long[length[long] == size]
        if len(chosen) * size <= PIECE:
            column = flat[begin[chosen][:, None] + np.arange(size)].reshape(-1).view(f"S{size}")
        else:
            parts = [flat[b : b + size].tobytes() for b in begin[chosen]]
            column = np.array(parts, f"S{size}")
        out[int(size)] = Runs.counted([column], doc[chosen], group_of)
    return out


class Tally:
    """The runs of one task: merged as they come, handed on when there are many."""

    def __init__(self) -> None:
        self.parts: dict[int, list[Runs]] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.held = self.fresh = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, runs: dict[int, Runs]) -> None:
        for bucket, r in runs.items():
            self.parts.setdefault(bucket, []).append(r)
            self.fresh += len(r)

    def merge(self) -> None:
        self.parts = {b: [Runs.merged(p)] for b, p in self.parts.items()}
        self.held = sum(len(p[0]) for p in self.parts.values())
        self.fresh = 0

    @property
    def full(self) -> bool:
        if self.fresh > HELD:
            self.merge()
        return self.held > HELD

    def flush(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.merge()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for (runs,) in self.parts.values():
            group = pa.array(runs.group)
            columns = [langs.take(group), sources.take(group), runs.terms(), runs.n, runs.docs]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=schema)
        self.parts, self.groups, self.held = {}, {}, 0


def texts_of(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string column."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    return ends[column.offset : column.offset + len(column) + 1], memoryview(data or b"")


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut between terms into pieces of about `PIECE` bytes."""
    at = 0
    while len(data) - at > PIECE:
        cut = data.find(b"\0", at + PIECE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


COUNTS = "lang string, source string, term binary, n long, docs long"
COUNTS_ARROW = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()),
    ("docs", pa.int64()),
])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, tally = COUNTS_ARROW, Tally()
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ends, data = texts_of(batch.column(2))
        size = np.diff(ends)
        group = np.array(list(map(tally.group, langs, sources)), np.int64)
        order = np.argsort(group, kind="stable")
        # Documents of about one piece together; a longer one by itself, in several.
        total = np.cumsum(size[order] + 1)
        for rows in np.split(order, np.flatnonzero(np.diff(total // PIECE)) + 1):
            texts = [bytes(data[ends[k] : ends[k + 1]]).translate(TERM_BYTES) for k in rows]
            small = [k for k, t in enumerate(texts) if len(t) <= PIECE]
            if small:
                lengths = np.array([len(texts[k]) + 1 for k in small])
                joined = b"\0".join(texts[k] for k in small)
                tally.add(count_terms(joined, np.cumsum(lengths) - lengths, group[rows[small]]))
            for k in set(range(len(texts))) - set(small):
                own: dict[int, list[Runs]] = {}
                for piece in pieces(texts[k]):
                    found = count_terms(piece, np.zeros(1, np.int64), group[rows[k : k + 1]])
                    for bucket, runs in found.items():
                        own.setdefault(bucket, []).append(runs)
                tally.add({b: Runs.merged(p, one_document=True) for b, p in own.items()})
            if tally.full:
                yield from tally.flush(schema)
                group = np.array(list(map(tally.group, langs, sources)), np.int64)
    yield from tally.flush(schema)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (
        texts.mapInArrow(_count_batches, COUNTS)
        .withColumn("term", F.col("term").cast("string"))
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)) in exact integers; NULL without terms."""
    count, total, terms = (
        (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)") for c in (count, total, terms)
    )
    unit, more = F.lit(UNIT).cast("decimal(10,0)"), F.lit(SMOOTHING).cast("decimal(1,0)")
    below = F.nullif(total + more * terms, F.lit(0))
    return F.lit(1) + F.call_function("div", (count + more) * unit, below)


def _ranked(rows: DataFrame) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by_value))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of differences for all pairs of a block, over the rows of one task."""
    sums: dict[tuple, np.ndarray] = {}
    seen: dict[tuple, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = row["lang"], row["low"], row["high"]
            base = np.array(row["base"] + row["base_high"], np.int64)
            split = len(row["base"])
            # The second block's places follow those of the first.
            shift = {row["high"]: split - row["high"] * BLOCK, row["low"]: -row["low"] * BLOCK}
            for x in row["shares"]:
                base[x["place"] + shift[x["place"] // BLOCK]] = x["p"]
            first = base[:split]
            second = first if row["low"] == row["high"] else base[split:]
            gap = np.abs(first[:, None] - second[None, :])
            sums[key] = sums[key] + gap if key in sums else gap
            seen[key] = seen.get(key, 0) + 1
    for (lang, low, high), gap in sums.items():
        a, b = (x.ravel() for x in np.indices(gap.shape))
        n = gap.size
        columns = [
            pa.array([lang] * n), a + low * BLOCK, b + high * BLOCK, gap.ravel(),
            np.full(n, seen[lang, low, high]),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, GAPS_ARROW, strict=True)], schema=GAPS_ARROW
        )


GAPS = "lang string, a int, b int, gap long, terms long"
GAPS_ARROW = pa.schema([
    ("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("gap", pa.int64()),
    ("terms", pa.int64()),
])


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: each source against each other one of its language."""
    block = (F.col("place") / F.lit(BLOCK)).cast("int")
    places = groups.withColumn("block", block)
    bases = places.groupBy("lang", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "base"))).alias("s"), F.max("blocks").alias("blocks")
    ).select("lang", "block", "blocks", F.col("s.base").alias("base"))
    both = (
        bases.withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1)))
        .withColumnRenamed("block", "low")
        .join(
            bases.select("lang", F.col("block").alias("high"), F.col("base").alias("base_high")),
            ["lang", "high"],
        )
        .select("lang", "low", "high", "base",
                F.when(F.col("low") == F.col("high"), F.array().cast("array<bigint>"))
                .otherwise(F.col("base_high")).alias("base_high"))
    )
    # A share goes to every pair of blocks that its source is in.
    shares = (
        kept.join(places.select("lang", "source", "place", "block", "blocks", "total", "terms"),
                  ["lang", "source"])
        .select("lang", "term", "place", share("n", "total", "terms").alias("p"), "block",
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("lang", "term", F.least("block", "other").alias("low"),
                 F.greatest("block", "other").alias("high"))
        .agg(F.collect_list(F.struct("place", "p")).alias("shares"))
    )
    rows = shares.join(both, ["lang", "low", "high"]).drop("term")
    gaps = rows.mapInArrow(_differences, GAPS).where("a < b").groupBy("lang", "a", "b").agg(
        F.sum("gap").alias("gap"), F.sum("terms").alias("seen")
    )
    one, two = (
        groups.select("lang", F.col("place").alias(p), F.col("source").alias(f"source_{p}"),
                      F.col("base").alias(f"base_{p}"), *extra)
        for p, extra in (("a", ["terms"]), ("b", []))
    )
    # The result itself has a row for each two sources of a language.
    pairs = one.join(two, "lang").where("a < b").join(gaps, ["lang", "a", "b"], "left")
    # Terms that no source of the two blocks has differ by the shares of a count of 0.
    unseen = F.col("terms") - F.coalesce("seen", F.lit(0))
    apart = F.coalesce(F.abs(F.col("base_a") - F.col("base_b")), F.lit(0))
    value = (F.coalesce("gap", F.lit(0)) + unseen * apart).alias("value")
    sides = [
        F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), value)
        for x, y in ("ab", "ba")
    ]
    return pairs.select("lang", F.inline(F.array(*sides)))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = written(term_counts(docs), "term-counts")
    vocabulary = (
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"))
        .where(F.col("in_docs") >= min_docs)
        .select("lang", "term", "lang_n")
    )
    kept = written(
        counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept-terms"
    )
    languages = (
        kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
        .groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("term").alias("terms"))
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    everything = Window.partitionBy("lang")
    groups = (
        docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .fillna(0, ["total", "lang_total", "terms"])
        .withColumns({
            "place": F.row_number().over(by_source) - 1,
            "blocks": F.ceil(F.count(F.lit(1)).over(everything) / F.lit(BLOCK)).cast("int"),
            "base": share(F.lit(0), "total", "terms"),
        })
    )
    groups = written(groups, "term-groups")
    pairs = _ranked(_pairs(kept, groups)).withColumn("part", F.lit("pair"))
    own, whole = share("n", "total", "terms"), share("lang_n", "lang_total", "terms")
    typical = (
        kept.join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value"))
        .where(F.col("value") > 0)
    )
    typical = _ranked(typical).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(typical).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(sums.total, 0) + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (langs.total + 5 * v)::HUGEINT AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN sums USING (lang, source)
    LEFT JOIN c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
      SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
      GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
  PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""
