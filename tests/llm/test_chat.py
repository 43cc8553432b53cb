import hashlib

import pytest
from edge_rows import prose
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallychain.llm import chat as c

HOSTILE = ["</turn>\n", "<turn assistant>\n", "\\", "\\l", "\\\\l<", "a>\nb", "<|endoftext|>", "", " x ", "\n"]


@given(turns=st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "a>\n<", "\\g", ">", "a>\nb"]), st.text(max_size=5)), st.lists(st.sampled_from([*HOSTILE, "hi"])).map("".join)), max_size=6))
def test_template_is_reversible(turns):
    text = "".join("".join(c.parts_of(r, t)) for r, t in turns)
    assert list(c.parse(text)) == turns


def rows():
    out = []
    for k in range(12):  # a hot first turn, shared second turns, equal conversations
        out += [(k, 0, "user", "hello"), (k, 1, "assistant", f"answer {k % 3}"), (k, 2, "user", prose(k % 6, 9))]
    out += [(20, n, "user" if n % 2 == 0 else "assistant", prose(n, 4)) for n in range(60)]  # long
    out += [(21, n, "user" if n % 2 == 0 else "assistant", prose(n, 4)) for n in range(59)]  # its beginning
    out += [(22 + k, 0, "assistant", t) for k, t in enumerate(HOSTILE)]
    out += [(40, 0, None, None), (40, 0, "user", "tie"), (40, 0, "user", "tie"), (None, 3, "assistant", "no id")]
    out += [(41, 0, "a>\nb", "text"), (41, 1, "\\g", ">\n")]
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tree(spark):
    given = spark.createDataFrame([(*r, "x") for r in rows()], "conv_id long, turn long, role string, text string, leaf string")
    nodes, leaves = c.build(given.repartition(3))
    return nodes.collect(), leaves.collect(), {r.conv_id: r for r in c.formatted(given).collect()}


def conversations():
    out = {}
    for conv, turn, role, text in rows():
        out.setdefault(conv, []).append((turn, role or "", text or ""))
    return {k: [(r, t) for _, r, t in sorted(v)] for k, v in out.items()}


def test_reads_back_whole(tree):
    want = conversations()
    assert set(tree[2]) == set(want)
    for conv, turns in want.items():
        r = tree[2][conv]
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), digest(said))
        assert r.formatted_chars == sum(len("".join(c.parts_of(*t))) for t in turns)


def test_shared_turns_are_emitted_once_depth_first(tree):
    nodes, leaves, _ = tree
    prefixes = {tuple(turns[: k + 1]) for turns in conversations().values() for k in range(len(turns))}
    assert len(nodes) == len({n.key for n in nodes}) == len(prefixes)
    by_shard = {}
    for n in nodes:
        by_shard.setdefault(n.shard, []).append(n)
    for shard in by_shard.values():  # gapless; ancestors lie before their descendants
        end = 0
        for n in sorted(shard, key=lambda n: n.start):
            assert n.start == end
            end += len(n.ids)
            assert n.position == sum(x.stop - x.start for x in n.intervals)
            assert all(x.shard < n.shard or x.stop <= n.start for x in n.intervals)


def test_intervals_hold_exactly_the_ancestors(tree):
    nodes, leaves, _ = tree
    flat = {n.shard: {} for n in nodes}
    for n in nodes:
        flat[n.shard].update({n.start + k: i for k, i in enumerate(n.ids)})
    by_key = {n.key: n for n in nodes}
    decode = c.encoder(c.public_path(c.VOCABULARY), True).library.decode
    want = conversations()
    for row in leaves:
        n = by_key[row.leaf]
        ids = [flat[x.shard][k] for x in n.intervals for k in range(x.start, x.stop)] + list(n.ids)
        text = decode(ids, skip_special_tokens=False)
        assert text == "".join("".join(c.parts_of(*t)) for t in want[row.conv_id])


def test_no_row_grows_with_a_conversation(spark, monkeypatch):
    """Two long conversations part late; what is written on the way stays short in every row."""
    said = [(k, n, "user", f"t{n}" if n < 380 + 9 * k else f"t{n} {k}") for k in range(2) for n in range(400)]
    said += [(None, n, "user", f"t{n}") for n in range(395)] + [(9, 0, "user", "t0")]
    widest, written = [], c.written

    def measured(df, name):
        out = written(df, name)
        for field in out.schema:
            kind = field.dataType.simpleString()
            if kind.startswith("array") or kind in ("string", "binary"):
                size = F.size(field.name) if kind.startswith("array") else F.length(field.name)
                widest.append((out.agg(F.max(size)).first()[0] or 0, name, field.name))
        return out

    monkeypatch.setattr(c, "written", measured)
    monkeypatch.setattr(c, "BLOCK", 6, raising=False)  # four levels
    given = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    nodes, leaves = c.build(given)
    assert max(widest)[0] <= 6 * 32, max(widest)
    rows = nodes.collect()
    assert len(rows) == len({r.key for r in rows}) == 395 + 20 + 11
    assert all(len(r.intervals) <= 4 for r in rows)
    got = {r.conv_id: r.n_turns for r in c.formatted(given).collect()}
    assert got == {0: 400, 1: 400, None: 395, 9: 1}


def test_empty_table(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.formatted(nothing).count() == 0
