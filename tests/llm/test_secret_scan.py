import hashlib

import numpy as np
import pytest
from edge_rows import prose

from tallychain.llm import secret_scan as s


def hexes(k, n):
    return hashlib.sha256(str(k).encode()).hexdigest()[:n]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password=abc12345", [(0, 17, "assign")]),
        ("PassWord : 'abc'", []),  # too short
        ("token:token:abcdefgh", []),  # the first match takes the second keyword
        ("ſecret=abcdefgh Key=abcdefgh", []),  # only ASCII letters have two cases
        ('api_key = "Zm9v+/=_.-x"', [(0, 22, "assign")]),
        ("é AKIA" + "A1" * 8, [(2, 22, "access")]),
        ("AKIA" + "A" * 15, []),
        ("é" + "0f" * 12, [(1, 25, "hex")]),
        ("0f" * 11 + "F", []),
        ("secret=" + "a0" * 12, [(0, 31, "assign"), (7, 31, "hex")]),
        ("", []),
    ],
)
def test_exact_spans(text, want):
    assert s.exact_spans(text) == want


def findings(n):
    out = []
    for k in range(n):
        left = prose(k, 4)[:20] + " "
        secret = hexes(k, 20)
        out.append((left + "key " + secret + " end", len(left) + 4, 20, True))
        out.append((left + "mail2.example.com end", len(left), 17, False))
        out.append((left + "4929" + f"{k:012d}" + " end", len(left), 16, False))
    return out


def test_network_learns_and_its_gradients_are_right():
    net = s.CharNet()
    classes, inside, _ = s.encoded([f[:3] for f in findings(6)])
    y = np.array([f[3] for f in findings(6)], np.float32)

    def loss():
        z = net.forward(classes, inside)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for w, g in zip(net.parameters(), net.gradients(classes, inside, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-2
        high = loss()
        w[at] -= 2e-2
        low = loss()
        w[at] += 1e-2
        assert (high - low) / 2e-2 == pytest.approx(float(g[at]), rel=0.1, abs=1e-4)
    detector = s.fit(findings(150))
    fresh = findings(190)[450:]
    truth = np.array([f[3] for f in fresh])
    accepted = detector.accepts([f[:3] for f in fresh])
    assert (accepted == truth).mean() > 0.95
    assert s.fit([f for f in findings(3) if f[3]]) is None


def test_thresholds_reach_the_recall_however_low_the_scores_are():
    rows = []
    for k in range(400):  # secrets look like the rest, so every score is near their share
        left = prose(k, 4)[:20] + " "
        rows.append((left + hexes(k, 20) + " end", len(left), 20, k % 8 == 0))
    detector = s.fit(rows)
    held = [f for f in rows if f[3] and hashlib.md5(f[0].encode()).digest()[0] % 5 == 0]
    assert held and detector.accepts([f[:3] for f in held]).mean() >= s.RECALL
    # A shape without labelled secrets goes by all secrets.
    scores = detector.probabilities([f[:3] for f in held])
    assert "upper" not in detector.thresholds and detector.otherwise <= np.median(scores) < 0.9


def test_long_candidates_are_read_whole():
    long = "m" * 130 + hexes(1, 20)
    classes, inside, owner = s.encoded([("xx " + long + " yy", 3, 150)])
    assert len(owner) == 4 and inside.sum() == 150


def test_all_rows_and_masking(spark, edges, nothing):
    rows = [(k, f"{prose(k, 30)} password={hexes(k, 18)} {prose(k, 5)}") for k in range(40)]
    rows += [(100 + k, f"{prose(k, 30)} mail{k}.example.com/x1") for k in range(40)] + [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = s.secrets(docs).collect()
    assert len(found) == len(rows)
    texts = dict(rows[:80])
    for r in found:
        exact = [(x.start, x.stop, x.kind) for x in r.spans if x.kind != "neural"]
        if r.doc_id in texts and r.doc_id != 7:
            assert exact == s.exact_spans(texts[r.doc_id])
    clean = s.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not any("password=" in (r.text or "") for r in clean.collect())
    assert s.redacted(edges).count() == edges.count()
    assert s.secrets(nothing).count() == 0


def test_keys_that_reach_beyond_an_exact_match_go_whole(spark, monkeypatch):
    class All:
        def accepts(self, findings):
            return np.ones(len(findings), bool)

    long = "Zx9Kq7Lm" + "0f" * 12 + "Pq8Rt5Vn"
    rows = [(1, f"key {long} end"), (2, "password=abc12345def x"), (3, "secret=" + "a0" * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in s.find_secrets(s.scan(docs), All()).collect()}
    assert found[1] == [(4, 44, "neural"), (12, 36, "hex")]
    assert found[2] == [(0, 20, "assign")] and found[3] == [(0, 31, "assign"), (7, 31, "hex")]
    monkeypatch.setattr(s, "fit", lambda findings: All())
    clean = {r.doc_id: r.text for r in s.redacted(docs).collect()}
    assert clean == {1: "key [secret] end", 2: "[secret] x", 3: "[secret]"}


def test_all_findings_train_and_set_the_thresholds(spark, monkeypatch):
    lines = [(f"{prose(k, 3)} password={hexes(k, 18)}", f"{prose(k, 3)} mail{k}.example.com/x1") for k in range(3300)]
    rows = [(at, "\n".join(x[at % 2] for x in lines[at // 2 * 100 :][:100])) for at in range(66)]
    scanned = s.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    want = set()
    for _, text in rows:
        exact = s.exact_spans(text)
        for a, b in s.candidates(text):
            left = max(0, a - s.CONTEXT)
            want.add((text[left : b + s.CONTEXT], a - left, b - a, s.overlaps(exact, a, b)))
    assert min(sum(f[3] for f in want), sum(not f[3] for f in want)) > 3000
    table = s.labelled_findings(scanned)
    assert {tuple(r) for r in table.collect()} == want
    # All held-out findings are counted, all others train, in whatever partitions they come.
    monkeypatch.setattr(s, "SHARD_ROWS", 1000)
    data = s.TableFindings(table)
    data.split({False}, {True})
    held = [f for f in want if s.is_held_out(f[0])]
    assert data.total == len(want) - len(held) and data.shards.count() > 3
    assert data.tally(s.CharNet()) == s.tally(s.CharNet(), held)
    one, two = (s.fit(t) for t in (table.coalesce(1), table.repartition(7)))
    assert (one.net.state() == two.net.state()).all()
    assert (one.slope, one.shift, one.thresholds) == (two.slope, two.shift, two.thresholds)
    accepted = one.accepts([f[:3] for f in held])
    truth = np.array([f[3] for f in held])
    assert accepted[truth].mean() >= s.RECALL and accepted[~truth].mean() < 0.05


def test_windows_of_a_long_candidate_go_to_different_shards(spark):
    rows = s.training_rows([("ab1" * 3000, 0, 9000, True)])
    keys = [r[0] for r in rows]
    assert len(rows) == 188 and len({k % 16 for k in keys}) == 16
