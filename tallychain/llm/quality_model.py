"""Quality classifier: a sparse rule ensemble that runs as Spark column expressions.

Each text is described by statistics, all built-in functions of the whole text.  On a bounded
sample of labelled rows, shallow boosted trees find useful cuts; every path from a root to a node
becomes a rule, a conjunction of comparisons.  A logistic regression with an L1 penalty over the
rules (and a row of ones) keeps few of them, and the kept ones become one column expression:
the logistic function of a weighted sum of conditions.  No Python runs when documents are scored.

`learn` sees statistics and labels only.  Statistics are written once; fitting and scoring read
that narrow table, so each text is read once.

Defined results: a NULL or empty text has all statistics 0 and gets a score like any other; rows
without a label are scored but not learnt from; repeated rows are scored one by one; if the
labels hold fewer than two classes, every score is the smoothed share of label 1 (0.5 without
labels); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import table, texts, written

#: Bound of the training sample.
SAMPLE_ROWS = 10_000
TREES, DEPTH, BINS, SHRINK = 30, 3, 32, 0.2
#: Penalties that a fifth of the sample chooses from, strongest first.
PENALTIES = (0.02, 0.01, 0.005, 0.002, 0.001)
LIMIT = 0.7


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one DOUBLE column per statistic of ``text``."""
    text = F.col("text")
    size = F.length(text)

    def count(chars: str) -> Column:
        return size - F.length(F.translate(text, chars, ""))

    words = F.split(F.translate(text, "\n\r\t", "   "), " ")
    lines = F.split(text, "\n")
    df = texts(docs, *keys).select(
        *keys,
        size.alias("n_chars_"),
        F.array_distinct(words).alias("distinct_words_"),
        F.size(words).alias("n_words_"),
        F.size(lines).alias("n_lines_"),
        F.size(F.array_distinct(lines)).alias("n_distinct_lines_"),
        count(" \n\r\t").alias("n_spaces_"),
        count("#*$%&|<>{}[]\\^~_=+@").alias("n_symbols_"),
        count("0123456789").alias("n_digits_"),
        count(".,;:!?").alias("n_points_"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals_"),
    )
    c = {n.rstrip("_"): F.col(n) for n in df.columns if n.endswith("_")}
    n_words = F.when(c["n_chars"] > 0, c["n_words"]).otherwise(0)
    shares = {
        "log_words": F.log1p(n_words),
        "word_length": _share(c["n_chars"] - c["n_spaces"], n_words),
        "symbols_per_word": _share(c["n_symbols"], n_words),
        "digits": _share(c["n_digits"], c["n_chars"]),
        "points_per_word": _share(c["n_points"], n_words),
        "capitals": _share(c["n_capitals"], c["n_chars"]),
        "words_per_line": _share(n_words, c["n_lines"]),
        "repeated_lines": _share(c["n_lines"] - c["n_distinct_lines"], c["n_lines"]),
        "distinct_words": _share(F.size(c["distinct_words"]), n_words),
        "spaces": _share(c["n_spaces"], c["n_chars"]),
    }
    return df.select(*keys, *(v.cast("double").alias(k) for k, v in shares.items()))


FEATURES = (
    "log_words", "word_length", "symbols_per_word", "digits", "points_per_word", "capitals",
    "words_per_line", "repeated_lines", "distinct_words", "spaces",
)

#: A condition: statistic, True for "at most", bound.  A rule: a set of conditions.
Condition = tuple[str, bool, float]
Rule = frozenset


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """Probability of label 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, below, bound in sorted(rule):
        out = out & ((F.col(name) <= bound) if below else (F.col(name) > bound))
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, below, bound in rule:
        column = x[:, FEATURES.index(name)]
        out &= (column <= bound) if below else (column > bound)
    return out


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.round(np.quantile(c, quantiles), 6)) for c in x.T]


def _grow(codes, cuts, slope, curve, rows, path, depth, rules) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, step) of one tree on gradients; adds the path to every node to ``rules``."""
    if path:
        rules.add(frozenset(path))
    best = (1e-9, None, None)
    g, h = slope[rows], curve[rows]
    base = g.sum() ** 2 / (h.sum() + 1)
    for f, bounds in enumerate(cuts if depth < DEPTH else ()):
        if not len(bounds):
            continue
        c = codes[rows, f]
        gl = np.cumsum(np.bincount(c, g, len(bounds) + 1))[:-1]
        hl = np.cumsum(np.bincount(c, h, len(bounds) + 1))[:-1]
        n = np.cumsum(np.bincount(c, minlength=len(bounds) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
        gain[(n < 10) | (n > len(rows) - 10)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    _, f, k = best
    if f is None:
        return [(rows, g.sum() / (h.sum() + 1))]
    left = codes[rows, f] <= k
    name, bound = FEATURES[f], float(cuts[f][k])
    return [
        leaf
        for side, below in ((left, True), (~left, False))
        for leaf in _grow(
            codes, cuts, slope, curve, rows[side], [*path, (name, below, bound)], depth + 1, rules
        )
    ]


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees on the logistic loss."""
    cuts = _cuts(x)
    codes = np.stack([np.searchsorted(b, c) for b, c in zip(cuts, x.T, strict=True)], axis=1)
    r, rules, total = np.random.default_rng(5), set(), np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(r.random(len(y)) < 0.7)
        if not len(rows):
            continue
        for leaf, step in _grow(codes, cuts, y - p, p * (1 - p), rows, [], 0, rules):
            total[leaf] += SHRINK * step
    return sorted(rules, key=lambda rule: (len(rule), sorted(rule)))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights (the first one is the free intercept) by accelerated proximal steps."""
    n = len(y)
    v = np.ones(z.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = z.T @ (z @ (v / np.linalg.norm(v)))
    rate = 3.5 * n / max(np.linalg.norm(v), 1e-9)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(250):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        new = v - rate * (z.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t_new
    return w


def _loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from trees, weights from the lasso, the penalty from a held-out fifth."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    if not n1 or not n0:
        return RuleModel(float(np.log((n1 + 1) / (n0 + 1))), ())
    rules, columns = [], {}
    for rule in tree_rules(x, y):  # of rules that hold for the same rows, the shortest one
        column = holds(rule, x)
        if columns.setdefault(column.tobytes(), rule) is rule:
            rules.append(rule)
    z = np.column_stack([np.ones(len(y)), *(holds(r, x) for r in rules)]).astype(np.float64)
    test = np.arange(len(y)) % 5 == 0
    w, best = np.zeros(z.shape[1]), (np.inf, PENALTIES[-1])
    for penalty in PENALTIES:
        w = _lasso(z[~test], y[~test], penalty, w)
        best = min(best, (_loss(z[test], y[test], w), penalty))
    w = _lasso(z, y, best[1], np.zeros(z.shape[1]))
    kept = tuple((r, round(float(a), 6)) for r, a in zip(rules, w[1:], strict=True) if abs(a) > 1e-6)
    return RuleModel(round(float(w[0]), 6), kept)


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from ``measured`` (key, statistics) joined with ``labels`` (key, label 0 or 1).

    At most ``rows`` labelled rows, those with the smallest hashes, reach the driver.
    """
    sample = (
        measured.join(labels.where("label is not null"), key)
        .orderBy(F.xxhash64(key), *FEATURES)
        .limit(rows)
        .select(*FEATURES, F.col("label").cast("double"))
        .collect()
    )
    data = np.array([tuple(r) for r in sample], np.float64).reshape(-1, len(FEATURES) + 1)
    return learn(data[:, :-1], data[:, -1])


def score(measured: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    return measured.withColumn(name, F.round(model.column(), 9))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    measured = written(statistics(docs, "doc_id"), "statistics")
    labels = table(spark, folder, "labels").where(~held_out("doc_id"))
    model = fit(measured, labels.select("doc_id", F.col("quality").alias("label")))
    return score(measured, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"),
    )
