import math
from collections import Counter

import pytest

from tallychain.llm import url_filter as u
from tallychain.llm.common import written

CASES = [
    ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://m.example.com/fr/1", "m.example.com", "/fr/1", "com/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
    ("https://a.net/ES/x", "a.net", "/ES/x", None, None),
    ("https://com", "com", "", None, None),
    ("x://b.com?u=/z", "b.com", "", None, None),
    ("http://b.com/://c.net/es/", "b.com", "/://c.net/es/", "com/", "allow"),
    ("b.com/en/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://Ü.com/ä\nb", "Ü.com", "/ä\nb", "com/", "allow"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, url, 1.0) for k, (url, *_) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score double")
    got = {r.page_id: r for r in u.judge(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")


def model(urls):
    """Log-probability of a url under a Witten-Bell model, straight from the definition."""
    seen, after = Counter(), {}
    for url, n in urls.items():
        padded = u.START * u.ORDER + url
        for i in range(u.ORDER, len(padded)):
            for k in range(u.ORDER + 1):
                ctx, ch = padded[i - k : i], padded[i]
                seen[ctx, ch] += n
                after.setdefault(ctx, Counter())[ch] += n

    def log(url):
        padded, total = u.START * u.ORDER + url, 0.0
        for i in range(u.ORDER, len(padded)):
            p = 1.0 / u.ALPHABET
            for k in range(u.ORDER + 1):
                own = after.get(padded[i - k : i])
                if own:
                    n, t = sum(own.values()), len(own)
                    p = (own[padded[i]] + t * p) / (n + t)
            total += math.log(p)
        return total

    return log


def test_scores_against_the_definition(spark):
    urls = {f"http://good{k % 7}.org/a/{k}": (1 + k % 2, 0) for k in range(30)}
    urls |= {f"http://spam{k % 5}.org/b/{k}": (0, 1) for k in range(20)} | {"http://new.org/é": (0, 0)}
    rows = [(t, a, r, t.endswith("3")) for t, (a, r) in urls.items()]
    df = spark.createDataFrame(rows, "text string, accepted long, rejected long, held_out boolean")
    yes = model({t: a for t, a, _, h in rows if a and not h})
    no = model({t: r for t, _, r, h in rows if r and not h})
    got = {r.text: r.score for r in u.train_and_score(df).collect()}
    assert got == pytest.approx({t: (yes(t) - no(t)) / len(t) for t in urls}, abs=2e-6)


def test_threshold_has_the_fewest_errors(spark):
    rows = [(0.5, 3, 0), (0.2, 1, 1), (-0.1, 0, 2), (-0.4, 1, 5), (99.0, 1, 0), (-99.0, 0, 1)]
    scores = spark.createDataFrame(rows, "score double, accepted long, rejected long")

    def wrong(t):
        missed = sum(a for s, a, _ in rows if s < t) / sum(a for _, a, _ in rows)
        return missed + sum(r for s, _, r in rows if s >= t) / sum(r for _, _, r in rows)

    assert wrong(u.threshold(scores)) == min(wrong(s) for s, _, _ in rows)
    assert u.threshold(scores.limit(0)) == 0.0


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = [(1, "http://a.org/x", "s"), (1, "http://a.org/x", "s"), (None, "http://a.com/x", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string")
    found = u.judge(pages)
    assert found.count() == 3
    assert u.judge(pages.limit(0)).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_nothing_but_few_ratios_is_broadcast(spark, settings, monkeypatch):
    settings("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = [(k, f"http{'s' * (k % 2)}://a{k % 9}.{('com', 'net')[k % 2]}/es/{k}") for k in range(400)]
    pages = written(spark.createDataFrame(rows + [(400, "x://new")], "page_id long, url string"), "pages")
    plans = []

    def noted(df, name):
        plans.append(df)
        return written(df, name)

    def judged():
        plans.clear()
        plans.append(u.judge(pages))
        found = [df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") for df in plans]
        return sum(found), sorted(plans[-1].collect())

    monkeypatch.setattr(u, "written", noted)
    n, few = judged()
    assert n <= 1
    monkeypatch.setattr(u, "MOST_BROADCAST", 0)
    n, many = judged()
    assert n == 0 and many == few
