"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A rule is a test over statistics of one text.  Each statistic is computed at most once per
document and only when a rule asks for it, so a document that an early rule rejects never
pays for the later ones.  `plan_cascade` runs every rule on a sample, measures what each costs
and rejects, and orders the rules by rejections per second.  The order changes the time only:
a document is kept if no rule rejects it, whatever the order.

Defined results: a NULL or empty text has no words, all counts 0, and is rejected as too short.
Repeated rows are judged one by one; other columns are ignored, whatever their names.  An empty
table gives no rows, and an empty sample leaves the rules in their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import map_rows, table, tidied, values

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"


class Statistics:
    """Lazily computed counts over one whole text."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words; every code point outside words is one byte of white space."""
        return len(self.text) - (len(self.data) - len(self.data.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that occur twice or more, first occurrences included."""
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        # Pairs become dense ids first, so that a window fits into one exact 64-bit key.
        k = len(ids)
        _, pairs = np.unique(codes[:-1] * k + codes[1:], return_inverse=True)
        _, inverse, counts = np.unique(
            pairs[:-1] * k + codes[2:], return_inverse=True, return_counts=True
        )
        repeated = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= repeated
        return int(covered.sum())

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter: ASCII letters or any code point beyond ASCII."""
        return sum(1 for w in self.words if not w.isascii() or w.translate(None, NOT_LETTERS))


NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Statistics], bool]


#: The fixed part of the verdict.
BASE_RULES = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
#: Widely published limits: one symbol to ten words, mean word of 3 to 10 characters, thirty
#: per cent repeated lines (more than three of them), four words in five with a letter.
METHOD_RULES = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("short_words", lambda s: s.word_chars < 3 * s.n_words),
    Rule("long_words", lambda s: s.word_chars > 10 * s.n_words),
    Rule(
        "repeated_lines",
        lambda s: s.n_dup_lines > 3 and 100 * s.n_dup_lines > 30 * len(s.lines),
    ),
    Rule("few_letters", lambda s: 5 * s.n_letter_words < 4 * s.n_words),
)
SAMPLE_ROWS = 400


def plan_cascade(
    docs: DataFrame,
    rules=BASE_RULES + METHOD_RULES,
    sample_rows: int = SAMPLE_ROWS,
    key: str = "doc_id",
):
    """``rules`` by estimated rejections per second on ``sample_rows`` rows, best first.

    The sample (the rows with the smallest hashes of their key) is bounded and only decides the
    order in which rules are tried.  Its first pass reads keys only.
    """
    place = F.xxhash64(key)
    last = docs.select(place.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return tuple(rules)
    rows = docs.where(place <= last).select("text").limit(sample_rows).collect()
    return order_by_gain(rules, [Statistics(r.text) for r in rows])


def order_by_gain(rules, sample: list[Statistics]):
    if not sample:
        return tuple(rules)
    gain = []
    for k, rule in enumerate(rules):
        fresh = [Statistics(s.text) for s in sample]
        start = time.perf_counter()
        rejected = sum(rule.rejects(s) for s in fresh)
        seconds = max(time.perf_counter() - start, 1e-9)
        gain.append((-rejected / seconds, k))
    return tuple(rules[k] for _, k in sorted(gain))


def first_rejection(statistics: Statistics, rules) -> str | None:
    """Name of the first rule that rejects; rules behind it are not evaluated."""
    return next((r.name for r in rules if r.rejects(statistics)), None)


def filter_documents(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns unchanged."""
    order = rules or plan_cascade(docs)
    at = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [first_rejection(Statistics(t), order) is None for t in values(batch.column(at))]
            yield pc.filter(batch, pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


REPORT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the base statistics and the verdict of base rules and cascade."""
    order = plan_cascade(docs, METHOD_RULES, key=key)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {REPORT}"

    def judged(doc_id, text) -> tuple:
        s = Statistics(text)
        failed = any(r.rejects(s) for r in BASE_RULES)
        kept = not failed and first_rejection(s, order) is None
        counts = (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)
        return doc_id, *counts, failed, kept

    return map_rows(docs.select(key, "text"), schema, judged)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (
  SELECT rid, p, array_to_string(words[p:p + 2], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
hot AS (SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeats AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM hot, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
      AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS BIGINT)
      AS n_letter_words
  FROM w LEFT JOIN lines l ON l.rid = w.rid LEFT JOIN repeats r ON r.rid = w.rid),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words
       OR word_chars > 10 * n_words OR n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines
       OR 5 * n_letter_words < 4 * n_words) AS kept
FROM judged
"""
