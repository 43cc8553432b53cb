"""Stages of the pipeline on the smallest tables, each against brute force on its own input."""

import os
import re
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_decontaminate import brute as benchmark_hits
from test_jaccard_join import shingles
from test_quality_rules import brute as counts
from tokenizers import Tokenizer

from tallychain.llm import packing, secret_scan, tokens
from tallychain.llm.common import map_rows, table, written
from tallychain.llm.tokens import public_path

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    frames = [table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], SMALL), name))
    assert all(f.columns == COLUMNS for f in frames[:-1])
    return [{r.doc_id: r for r in f.collect()} for f in frames[:-1]], frames[-1].collect()


def test_quality_rules(outputs):
    before, after = outputs[0][0], outputs[0][1]
    assert set(after) < set(before)
    for d, r in before.items():
        n, chars, symbols, dup, repeated = counts(r.text)
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words)
        bad = n < 50 or 2 * repeated > n or 10 * symbols > n or not 3 * n <= chars <= 10 * n
        bad = bad or (dup > 3 and 10 * dup > 3 * len(lines)) or 5 * letters < 4 * n
        assert (d in after) == (not bad)
        assert d not in after or after[d] == r


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs[0][1], outputs[0][2]
    sets = {d: shingles(r.text) for d, r in before.items()}
    root = {d: d for d in before}
    for a in sorted(before):
        for b in before:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = {d: new if x == old else x for d, x in root.items()}
    assert set(after) == set(root.values())
    assert all(after[d] == before[d] for d in after)


def test_benchmark_and_secrets(outputs, spark):
    before, clean, masked = outputs[0][2], outputs[0][3], outputs[0][4]
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").collect()]
    assert set(clean) == {d for d, r in before.items() if not benchmark_hits(r.text, items)[1]}
    assert set(masked) == set(clean)
    for d, r in clean.items():
        assert not secret_scan.exact_spans(masked[d].text or "")
        if not any(secret_scan.candidates(r.text or "")) and not secret_scan.exact_spans(r.text or ""):
            assert masked[d] == r


def test_sequences(outputs):
    docs, rows = outputs[0][4], outputs[1]
    library = Tokenizer.from_file(public_path(packing.VOCABULARY))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, 0)
        by_doc[r.doc_id] += r.length
    want = {d: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in docs.items()}
    assert by_doc == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_masking_trains_on_all_findings(spark, monkeypatch):
    lines = [f"w{k} password=Ab{k:012d}" for k in range(3100)] + [f"w{k} mail{k}.example.com/x1" for k in range(3100)]
    rows = [(k, "\n".join(lines[k * 100 : k * 100 + 100]), "en", "s", 0) for k in range(62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    monkeypatch.setattr(secret_scan, "fit", lambda findings: seen.append(findings))
    masked = corpus_pipeline.secrets(spark, docs, SMALL)
    assert {r["secret"]: r["count"] for r in seen[0].groupBy("secret").count().collect()} == {True: 3100, False: 3100}
    assert not any("password" in r.text for r in masked.collect())


def test_masking_leaves_no_finding_out_of_weights_and_thresholds(spark, monkeypatch):
    lines = [f"v{k} token=Cd{k:012d}" for k in range(3200)] + [f"v{k} host{k}.example.org/y2" for k in range(3200)]
    rows = [(k, "\n".join(lines[k * 100 : k * 100 + 100]), "en", "s", 0) for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    used = {}

    class Watched(secret_scan.TableFindings):
        def tally(self, net):
            counted = super().tally(net)
            used.update(trained=self.total, shards=self.shards.agg({"*": "count"}).first()[0])
            used["counted"] = [sum(n for (_, label, _), n in counted.items() if label == x) for x in (True, False)]
            return counted

    monkeypatch.setattr(secret_scan, "TableFindings", Watched)
    monkeypatch.setattr(secret_scan, "SHARD_ROWS", 1000)
    masked = corpus_pipeline.secrets(spark, docs, SMALL)
    held = [0, 0]
    for _, text, *_ in rows:
        for a, b in secret_scan.candidates(text):
            window = text[max(0, a - secret_scan.CONTEXT) : b + secret_scan.CONTEXT]
            held["token=" not in text[a:b]] += secret_scan.is_held_out(window)
    # Each of the 6,400 findings, one window each, either trains or sets the thresholds.
    assert used["counted"] == held and min(held) > 0
    assert used["trained"] == 6400 - sum(held) and used["shards"] > 3
    assert not any("token=" in r.text for r in masked.collect())


def test_packing_leaves_no_words_in_the_workers(spark):
    rows = [(k, f"word{k} and other{k} words") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert corpus_pipeline.sequences(spark, docs, "").count() == 400
    path = public_path(packing.VOCABULARY)

    def known(batches):
        for batch in batches:
            n = len(tokens.encoder(path, False).words)
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    # As many tasks at once as the session has cores: every worker is asked.
    left = spark.range(64).repartition(16).mapInArrow(known, "n long")
    assert {r.n for r in left.collect()} == {0}


def test_a_task_gives_freed_memory_back(spark):
    def churned(key) -> tuple:
        blocks = [np.ones(100_000, np.uint8) for _ in range(2000)]
        sys.last_block = blocks[-1]  # stays: the heap cannot shrink from its end
        return (os.getpid(),)

    (row,) = map_rows(spark.range(1).coalesce(1), "pid long", churned).collect()
    pages, shared = map(int, Path(f"/proc/{row.pid}/statm").read_text().split()[1:3])
    assert (pages - shared) * os.sysconf("SC_PAGE_SIZE") < 200_000_000
