from collections import Counter

from edge_rows import edge_documents

from tallychain.llm import quality_rules as q


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + o for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_statistics_against_brute_force(edges):
    got = sorted(tuple(r)[:6] for r in q.report(edges).fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if d is None else d, *brute(t)) for d, t in edge_documents())
    assert got == want


def test_filter_keeps_columns_and_agrees_with_the_report(edges, nothing):
    kept = q.filter_documents(edges)
    assert kept.columns == edges.columns
    verdicts = {(r.doc_id): r.kept for r in q.report(edges).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, yes in verdicts.items() if yes}
    assert q.filter_documents(nothing).count() == 0
    assert q.report(nothing).count() == 0


def test_cascade_stops_at_the_first_rejection_and_order_is_by_gain():
    calls = []

    def rule(name, verdict, cost):
        def rejects(s):
            calls.append(name)
            sum(range(cost))
            return verdict

        return q.Rule(name, rejects)

    rules = [rule("never", False, 200_000), rule("costly", True, 200_000), rule("cheap", True, 10)]
    order = q.order_by_gain(rules, [q.Statistics("a b c")] * 5)
    assert [r.name for r in order] == ["cheap", "costly", "never"]
    calls.clear()
    assert q.first_rejection(q.Statistics("a b c"), order) == "cheap"
    assert calls == ["cheap"]
