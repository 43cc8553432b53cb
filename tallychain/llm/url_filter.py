"""URL filter: rules first, then a likelihood ratio of two character language models.

Rules decide what they fit: by host and its subdomains and the start of the path, the longest
rule first.  Every url that no rule fits is judged by two smoothed variable-order Markov models
over the characters of the url, one of accepted and one of rejected urls (those that a rule
allows or blocks; `train_and_score` takes any labels).  The score is the difference of their
log-likelihoods per character.

A model of order `ORDER` predicts a character from the `ORDER` characters before it.  The estimate
for a context is mixed with that of the context one character shorter (Witten-Bell: a context
seen n times with t different successors gives the shorter one the weight t / (n + t)), down to a
uniform distribution; an unseen context hands over to the shorter one entirely, so the order
varies with what was seen.

The threshold is calibrated on a fifth of the labelled urls, which the models do not learn from:
the value with the fewest misjudged urls, both labels weighing the same.

Everything is DataFrame functions.  Counts are taken over all urls, partial sums before each
shuffle; all counts of shorter grams are sums over those of the longest ones.  Equal urls are
scored once.

The planner takes the bytes of a kept table, compressed as they are, for the size of what is made
from it, be it a row per character.  Joins with such frames are hinted to be merged, as it
would broadcast what does not fit into the driver.

Defined results: a NULL url or one without ``://`` has empty host and path, no rule, and is judged by
the models on its text (NULL: as the empty text).  Where there are no accepted or no rejected
urls, or the text is empty, the score is 0 and the verdict is allow only if 0 reaches the
threshold, which is 0 without labels.  Ties with the threshold are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallychain.llm.common import table, written

#: The fixed rules: verdict, host, start of the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Stands before the first character of a url.
START = "\x02"
#: Characters that a model can tell apart at its lowest order.
ALPHABET = 128
HELD_OUT = 5
BINS = 1000
#: Ratios of so many grams may be broadcast: each is a row of at most 64 bytes.
MOST_BROADCAST = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; NULL if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = None
    for v, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of each url: the character with the `ORDER` before it."""
    padded = F.concat(F.lit(START * ORDER), "text")
    places = F.sequence(F.lit(1), F.length("text"))
    return urls.where(F.length("text") > 0).select(
        "*", F.explode(F.transform(places, lambda i: F.substr(padded, i, F.lit(ORDER + 1)))).alias("gram")
    )


def _log_ratio(counts: DataFrame) -> DataFrame:
    """gram, ratio: log of accepted over rejected probability, for every gram in ``counts``.

    ``counts`` has gram, a and r (how often in accepted and rejected urls, zeros included).
    """
    df = None
    for k in range(ORDER + 1):
        # Counts of the last k + 1 characters, and of the k before the last one.
        ending = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(ending.alias("e")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("e", 1, k))
        seen = seen.select(
            "e", "a", "r",
            *(F.sum(m).over(context).alias(f"n_{m}") for m in "ar"),
            *(F.count_if(F.col(m) > 0).over(context).alias(f"t_{m}") for m in "ar"),
        )
        if k == 0:
            seen = seen.select("*", *(F.lit(1.0 / ALPHABET).alias(f"p_{m}") for m in "ar"))
        else:
            # The estimates for the context one character shorter.
            shorter = df.withColumnRenamed("e", "s").hint("merge")
            seen = seen.join(shorter, F.substring("e", 2, k) == F.col("s"))
        df = seen.select("e", *(_mixed(m).alias(f"p_{m}") for m in "ar"))
    return df.select(F.col("e").alias("gram"), F.round(F.log("p_a") - F.log("p_r"), 9).alias("ratio"))


def _mixed(m: str) -> Column:
    n, t, shorter = F.col(f"n_{m}"), F.col(f"t_{m}"), F.col(f"p_{m}")
    return F.when(n > 0, (F.col(m) + t * shorter) / (n + t)).otherwise(shorter)


def train_and_score(urls: DataFrame) -> DataFrame:
    """text, score of each different ``text``.

    ``urls`` has different texts, ``accepted`` and ``rejected`` (how many rows of either label)
    and ``held_out`` (its labels calibrate and are not learnt).
    """
    learnt = ~F.col("held_out")
    each = _grams(urls)
    counts = each.groupBy("gram").agg(
        F.sum(F.when(learnt, F.col("accepted")).otherwise(0)).alias("a"),
        F.sum(F.when(learnt, F.col("rejected")).otherwise(0)).alias("r"),
    )
    counts = written(counts, "url-grams")
    ratios = _log_ratio(counts)
    if counts.count() > MOST_BROADCAST:
        ratios = ratios.hint("merge")
    # Every gram has a ratio; the left side of a left join, here all characters, is never broadcast.
    scored = each.select("text", "gram").join(ratios, "gram", "left")
    score = F.sum("ratio") / F.length("text")
    return scored.groupBy("text").agg(F.round(score, 6).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The score with the fewest misjudged urls, labels weighing the same.

    Scores are counted in bins of 1 / `BINS`; clipped to +-20 there are at most 40,001 of them.
    """
    place = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * BINS).cast("long")
    bins = scores.groupBy(place.alias("bin")).agg(
        F.sum("accepted").alias("a"), F.sum("rejected").alias("r")
    )
    # Wrong at a threshold: accepted below it, rejected at or above it.
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = bins.select(
        "bin",
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("missed"),
        (F.sum("r").over(everything) - F.coalesce(F.sum("r").over(below), F.lit(0))).alias("let"),
        F.sum("a").over(everything).alias("all_a"),
        F.sum("r").over(everything).alias("all_r"),
    ).where("all_a > 0 and all_r > 0")
    wrong = F.col("missed") / F.col("all_a") + F.col("let") / F.col("all_r")
    best = sums.orderBy(wrong, "bin").select("bin").first()
    return best[0] / BINS if best else 0.0


def judge(pages: DataFrame, rules=RULES, key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict, score of the models."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(key, "url").select(key, F.coalesce("url", F.lit("")).alias("text"),
                                             host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "ruled": verdict})
    urls = parsed.groupBy("text").agg(
        F.count_if(F.col("ruled") == "allow").alias("accepted"),
        F.count_if(F.col("ruled") == "block").alias("rejected"),
    )
    urls = urls.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    urls = written(urls, "urls")
    scores = written(
        urls.join(train_and_score(urls).hint("merge"), "text", "left").select(
            "text", "accepted", "rejected", "held_out", F.coalesce("score", F.lit(0.0)).alias("score")
        ),
        "url-scores",
    )
    limit = threshold(scores.where("held_out and accepted + rejected > 0"))
    by_model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return (
        parsed.join(scores.select("text", "score").hint("merge"), "text", "left")
        .select(key, "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"),
                "score")
    )


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))
