"""Secret scan: three exact patterns, and a character convolutional network for the rest.

Every run of 12 or more characters of the secret alphabet that has a digit or mixed case is a
candidate.  The network reads the whole candidate with `CONTEXT` characters on either side:
learned character vectors and an inside/outside channel, one convolution, ReLU, maximum over all
places, one output.  It is written in numpy and trained on all labelled findings but the held-out
fifth, which sets calibration and thresholds (of a scan, equal findings count once).  They are dealt by
digest into shards of about `SHARD_ROWS` windows, each shard takes the common weights through one
epoch of its own, and the mean of the shards, weighted by their windows, is where the next epoch
starts.  Platt scaling on the held-out fifth of all findings turns the output into a probability,
and for each shape of candidate the threshold is the highest one that still reaches `RECALL` on the
held-out secrets; a shape without any takes the threshold of all shapes together.  Both come from
exact counts of the held-out findings by output, in steps of 1 / `STEPS`.

Findings are labelled by the patterns: a candidate that overlaps an exact match is a secret.
`fit` takes any labelled findings, as a table or a list, so reviewed ones can replace these.

Exact matches are leftmost and non-overlapping per kind; the network adds the whole span of each
accepted candidate that no exact matches cover to its ends.  Spans count code points, ends exclusive.  Defined results: a NULL or empty text
has no spans; repeated rows are scanned one by one; without findings of both labels nothing is
added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallychain.llm.common import (
    arrow_schema,
    batch_of,
    map_rows,
    partitions_of,
    table,
    tidied,
    values,
    written,
)

#: Fixed patterns: kind, pattern, group whose length counts, least length.
PATTERNS = (
    (
        "assign",
        re.compile(
            r"""(?ai:(password|passwd|secret|token|api_?key))"""
            r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        2,
        6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "neural")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}.*[a-z]")
CONTEXT = 24
#: Characters of a candidate in one window; longer ones get several, the best one counts.
WINDOW = 48

#: Windows of a shard, about.
SHARD_ROWS = 8192
#: Outputs are counted in steps of 1 / STEPS, up to LIMIT on either side.
STEPS, LIMIT = 1024, 32
RECALL = 0.98
EPOCHS, BATCH, RATE = 6, 64, 3e-3
VECTOR, WIDTH, FILTERS = 8, 5, 24


def exact_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all exact matches, by start, then kind as listed."""
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        if MIXED.search(m.group()):
            yield m.span()


def overlaps(spans: list[tuple], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b, _ in spans)


def covered(spans: list[tuple], start: int, end: int) -> bool:
    """Whether the spans (start, end), by start, leave nothing of the given one."""
    for a, b in spans:
        if a <= start < b:
            start = b
    return start >= end


SCANNED = (
    "exact array<struct<start: long, stop: long, kind: string>>, "
    "candidates array<struct<start: long, stop: long, lead: int, window: string, secret: boolean>>"
)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: exact spans and candidates with their context, labelled by the patterns."""

    def per_row(doc_id, text) -> tuple:
        text = text or ""
        exact = exact_spans(text)
        found = []
        for a, b in candidates(text):
            left = max(0, a - CONTEXT)
            found.append(
                {
                    "start": a,
                    "stop": b,
                    "lead": a - left,
                    "window": text[left : b + CONTEXT],
                    "secret": overlaps(exact, a, b),
                }
            )
        spans = [{"start": a, "stop": b, "kind": k} for a, b, k in exact]
        return doc_id, spans, found

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {SCANNED}"
    return map_rows(docs.select(key, "text"), schema, per_row)


# Characters as classes: printable ASCII, then line break, other white space, beyond ASCII, none.
BREAK, SPACE, BEYOND, NONE = 95, 96, 97, 98
CLASSES = 99


def encoded(findings: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, lead, length of the candidate) -> classes, inside flags, finding of each row."""
    rows, owner = [], []
    for k, (window, lead, n) in enumerate(findings):
        for at in range(0, n, WINDOW):
            rows.append((window, lead, min(WINDOW, n - at), at))
            owner.append(k)
    size = WINDOW + 2 * CONTEXT
    classes = np.full((len(rows), size), NONE, np.int16)
    inside = np.zeros((len(rows), size), np.float32)
    for r, (window, lead, n, at) in enumerate(rows):
        start = lead + at - CONTEXT  # place in the window that goes to column 0
        part = window[max(0, start) : lead + at + n + CONTEXT]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(codes < 127, codes.astype(np.int64) - 32, BEYOND)
        c = np.where(codes == 10, BREAK, np.where(codes < 32, SPACE, c))
        left = max(0, -start)
        classes[r, left : left + len(c)] = c
        inside[r, CONTEXT : CONTEXT + n] = 1
    return classes, inside, np.array(owner, np.int64)


@dataclass
class CharNet:
    """Character vectors, one convolution, ReLU, maximum over places, one output."""

    seed: int = 7
    vectors: np.ndarray = field(init=False)
    filters: np.ndarray = field(init=False)
    shifts: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        fan = WIDTH * (VECTOR + 1)
        self.vectors = r.normal(0, 0.5, (CLASSES, VECTOR)).astype(np.float32)
        self.filters = r.normal(0, (2 / fan) ** 0.5, (fan, FILTERS)).astype(np.float32)
        self.shifts = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.shifts, self.out, self.bias]

    def _unfolded(self, classes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.vectors[classes], inside[..., None]], axis=2)
        n = x.shape[1] - WIDTH + 1
        return np.concatenate([x[:, k : k + n] for k in range(WIDTH)], axis=2)

    def forward(self, classes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        u = self._unfolded(classes, inside)
        top = np.maximum(u @ self.filters + self.shifts, 0).max(axis=1)
        return top @ self.out + self.bias[0]

    def gradients(self, classes, inside, labels) -> list[np.ndarray]:
        """Of the mean logistic loss, in the order of `parameters`."""
        b = len(labels)
        u = self._unfolded(classes, inside)
        act = np.maximum(u @ self.filters + self.shifts, 0)
        place = act.argmax(axis=1)
        top = np.take_along_axis(act, place[:, None, :], axis=1)[:, 0]
        slope = (1 / (1 + np.exp(-(top @ self.out + self.bias[0]))) - labels) / b
        g_top = slope[:, None] * self.out * (top > 0)
        at = u[np.arange(b)[:, None], place]  # rows x filters x inputs
        g_filters = np.einsum("bf,bfi->if", g_top, at)
        g_u = (g_top[:, :, None] * self.filters.T).reshape(b, FILTERS, WIDTH, VECTOR + 1)
        g_vectors = np.zeros_like(self.vectors)
        places = place[:, :, None] + np.arange(WIDTH)
        chars = classes[np.arange(b)[:, None, None], places]
        np.add.at(g_vectors, chars.reshape(-1), g_u[..., :VECTOR].reshape(-1, VECTOR))
        return [g_vectors, g_filters, g_top.sum(0), slope @ top, np.array([slope.sum()])]

    def state(self) -> np.ndarray:
        """Weights, both moments of Adam and its steps so far, as one row of numbers."""
        flat = np.concatenate([w.reshape(-1) for w in self.parameters()]).astype(np.float64)
        return np.concatenate([flat, np.zeros(2 * len(flat) + 1)])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for w in self.parameters():
            w[...] = state[at : at + w.size].reshape(w.shape)
            at += w.size

    def epoch(self, state: np.ndarray, rows: tuple, seed: list[int]) -> np.ndarray:
        """The state after one epoch of Adam on shuffled batches of (classes, inside, labels)."""
        self.load(state)
        weights = self.parameters()
        flat, first, second = np.split(state[:-1], 3)
        moments, at = [], 0
        for w in weights:
            part = slice(at, at + w.size)
            moments.append([x[part].reshape(w.shape).astype(np.float32) for x in (first, second)])
            at += w.size
        step = float(state[-1])
        order = np.random.default_rng([self.seed, *seed]).permutation(len(rows[2]))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            step += 1
            grads = self.gradients(*(x[batch] for x in rows))
            for w, (m, v), g in zip(weights, moments, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        parts = [*weights, *(m for m, _ in moments), *(v for _, v in moments)]
        return np.concatenate([*(x.reshape(-1).astype(np.float64) for x in parts), [step]])

    def logits(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        """One output per finding: that of its best window."""
        out = np.full(len(findings), -np.inf, np.float32)
        for at in range(0, len(findings), 1024):
            classes, inside, owner = encoded(findings[at : at + 1024])
            for k in range(0, len(owner), 1024):
                part = slice(k, k + 1024)
                np.maximum.at(out, at + owner[part], self.forward(classes[part], inside[part]))
        return out


def shape_of(candidate: str) -> str:
    """Shapes with thresholds of their own."""
    if re.fullmatch(r"[0-9.+/_=-]+", candidate):
        return "digits"
    if re.fullmatch(r"[0-9a-f]+", candidate):
        return "hex"
    return "upper" if re.fullmatch(r"[A-Z0-9]+", candidate) else "other"


def steps(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -LIMIT, LIMIT) * STEPS).astype(np.int64)


def _platt(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic calibration, by Newton steps on smoothed targets."""
    n1, n0 = (counts * labels).sum(), (counts * (1 - labels)).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        w = counts * np.maximum(p * (1 - p), 1e-9)
        off = counts * (p - target)
        g = np.array([(off * logits).sum() + 1e-3 * (a - 1), off.sum()])
        h = np.array([[(w * logits**2).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum()]])
        da, db = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def _scores(place: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * (place / STEPS) + shift, -30, 30)))


@dataclass
class Detector:
    net: CharNet
    slope: float
    shift: float
    thresholds: dict[str, float]
    otherwise: float

    def probabilities(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        return _scores(steps(self.net.logits(findings)), self.slope, self.shift)

    def accepts(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        limit = [
            self.thresholds.get(shape_of(w[lead : lead + n]), self.otherwise)
            for w, lead, n in findings
        ]
        return self.probabilities(findings) >= np.array(limit)


def is_held_out(window: str) -> bool:
    return hashlib.md5(window.encode("utf-8", "surrogatepass")).digest()[0] % 5 == 0


def training_rows(findings: list[tuple]) -> list[tuple[int, bytes, int, bool]]:
    """(key, classes, characters inside, secret) of every window of (window, lead, length, secret)."""
    classes, inside, owner = encoded([f[:3] for f in findings])
    sizes = inside.sum(axis=1).astype(int).tolist()
    keys, out, last, part = [], [], -1, 0
    for f in findings:
        digest = hashlib.md5(f"{f[1]} {f[2]} {f[0]}".encode("utf-8", "surrogatepass")).digest()
        keys.append(int.from_bytes(digest[:8], "little"))
    for row, n, k in zip(classes.astype(np.uint8), sizes, owner.tolist(), strict=True):
        last, part = k, part + 1 if k == last else 0
        key = (keys[k] + part * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)
        out.append((key, row.tobytes(), n, bool(findings[k][3])))
    return out


def trained(state: np.ndarray, rows: list[tuple[int, bytes, int, bool]], seed: list[int]) -> np.ndarray:
    """The state after one epoch over `training_rows`, in the order given."""
    classes = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
    place = np.arange(classes.shape[1])
    stop = CONTEXT + np.array([r[2] for r in rows])[:, None]
    inside = ((place >= CONTEXT) & (place < stop)).astype(np.float32)
    labels = np.array([r[3] for r in rows], np.float32)
    return CharNet().epoch(state, (classes.astype(np.int64), inside, labels), seed)


def tally(net: CharNet, findings: list[tuple]) -> Counter:
    """How many of (window, lead, length, secret) have each (shape, secret, step of the output)."""
    place = steps(net.logits([f[:3] for f in findings])).tolist()
    return Counter(
        (shape_of(w[lead : lead + n]), bool(secret), at)
        for (w, lead, n, secret), at in zip(findings, place, strict=True)
    )


class ListedFindings:
    """Findings in memory: one shard."""

    def __init__(self, findings: list[tuple]) -> None:
        self.findings = [(*f[:3], bool(f[3]), is_held_out(f[0])) for f in findings]

    def counts(self) -> Counter:
        return Counter((held, secret) for *_, secret, held in self.findings)

    def split(self, train: set[bool], test: set[bool]) -> None:
        self.rows = sorted(training_rows([f[:4] for f in self.findings if f[4] in train]))
        self.test = [f[:4] for f in self.findings if f[4] in test]

    def epoch(self, state: np.ndarray, number: int) -> np.ndarray:
        return trained(state, self.rows, [number, 0])

    def tally(self, net: CharNet) -> Counter:
        return tally(net, self.test)


class TableFindings:
    """Findings as a table: shards are trained and outputs counted where they lie.

    Shards and the order in them follow from the rows alone, and means are taken in decimals, so the
    result does not depend on partitions.
    """

    def __init__(self, findings: DataFrame) -> None:
        digest = F.conv(F.substring(F.md5(F.col("window").cast("binary")), 1, 2), 16, 10)
        held = (digest.cast("int") % 5 == 0).alias("held")
        self.findings = written(findings.select("window", "lead", "n", "secret", held), "findings")

    def counts(self) -> Counter:
        rows = self.findings.groupBy("held", "secret").count().collect()
        return Counter({(r["held"], r["secret"]): r["count"] for r in rows})

    def split(self, train: set[bool], test: set[bool]) -> None:
        schema = "key long, classes binary, n int, secret boolean"
        target = arrow_schema(schema)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield batch_of(training_rows(list(zip(*map(values, part.columns), strict=True))), target)

        bare = self.findings.select("window", "lead", "n", "secret")
        rows = written(bare.where(F.col("held").isin(list(train))).mapInArrow(run, schema), "training")
        self.total = rows.count()
        shards = max(1, -(-self.total // SHARD_ROWS))
        each = rows.select(
            F.pmod("key", F.lit(shards).cast("long")).alias("shard"), F.struct(*rows.columns).alias("row")
        ).repartition(partitions_of(rows), "shard")
        each = each.groupBy("shard").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        self.shards = written(each, "shards")
        self.test = bare.where(F.col("held").isin(list(test)))

    def epoch(self, state: np.ndarray, number: int) -> np.ndarray:
        target = arrow_schema("state array<double>")

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, rows in zip(*map(values, batch.columns), strict=True):
                    rows = [(r["key"], r["classes"], r["n"], r["secret"]) for r in rows]
                    new = trained(state, rows, [number, shard])
                    yield batch_of([((len(rows) * new).tolist(),)], target)

        new = self.shards.mapInArrow(run, "state array<double>").select(F.posexplode("state"))
        new = new.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,18)")).alias("x"))
        out = np.zeros(len(state))
        for r in new.collect():
            out[r["pos"]] = float(r["x"]) / self.total
        return out

    def tally(self, net: CharNet) -> Counter:
        schema = "shape string, secret boolean, step long, n long"
        target = arrow_schema(schema)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = tally(net, list(zip(*map(values, batch.columns), strict=True)))
                yield batch_of([(*k, n) for k, n in found.items()], target)

        rows = self.test.mapInArrow(run, schema).groupBy("shape", "secret", "step").agg(F.sum("n").alias("n"))
        return Counter({(r["shape"], r["secret"], r["step"]): r["n"] for r in rows.collect()})


def fit(findings: DataFrame | list[tuple[str, int, int, bool]], recall: float = RECALL) -> Detector | None:
    """Train on (window, lead, n, secret); a fifth is held out for calibration."""
    data = ListedFindings(findings) if isinstance(findings, list) else TableFindings(findings)
    counts = data.counts()
    if len({secret for _, secret in counts}) < 2:
        return None
    if len(counts) == 4:
        data.split({False}, {True})
    else:  # too few findings to hold any out
        data.split({False, True}, {False, True})
    net = CharNet()
    state = net.state()
    for number in range(EPOCHS):
        state = data.epoch(state, number)
    net.load(state)
    found = sorted(data.tally(net).items())
    shapes = np.array([shape for (shape, _, _), _ in found])
    secret = np.array([label for (_, label, _), _ in found])
    place = np.array([at for (_, _, at), _ in found])
    n = np.array([count for _, count in found])
    slope, shift = _platt(place / STEPS, secret.astype(float), n)
    # The last digits of an output depend on the batch it is computed in: one step of room.
    scores = _scores(place - np.sign(slope), slope, shift)

    def at(rows: np.ndarray) -> float:
        order = np.flatnonzero(rows)[np.argsort(scores[rows], kind="stable")]
        passed = np.cumsum(n[order])
        return float(scores[order[np.searchsorted(passed, int((1 - recall) * passed[-1]), "right")]])

    limits = {s: at(secret & (shapes == s)) for s in sorted(set(shapes[secret].tolist()))}
    return Detector(net, slope, shift, limits, at(secret))


def labelled_findings(scanned: DataFrame) -> DataFrame:
    """Every different finding: window, lead, n (its length), secret."""
    each = scanned.select(F.inline("candidates")).select(
        "window", "lead", (F.col("stop") - F.col("start")).alias("n"), "secret"
    )
    return each.distinct()


SPANS = "array<struct<start: long, stop: long, kind: string>>"


def find_secrets(scanned: DataFrame, detector: Detector | None, key: str = "doc_id") -> DataFrame:
    """Per row of ``scan``'s result: `key`, `spans` of all kinds, by start."""
    schema = f"{key} {scanned.schema[key].dataType.simpleString()}, spans {SPANS}"
    target = arrow_schema(schema)
    rank = {kind: k for k, kind in enumerate(KINDS)}

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = batch.column(1).to_pylist()
            open_ = []
            for spans, cs in zip(exact, batch.column(2).to_pylist(), strict=True):
                known = [(s["start"], s["stop"]) for s in spans]
                open_.append([c for c in cs if not covered(known, c["start"], c["stop"])])
            flat = [(c["window"], c["lead"], c["stop"] - c["start"]) for cs in open_ for c in cs]
            taken = iter(detector.accepts(flat).tolist() if detector and flat else [False] * len(flat))
            rows = []
            for doc_id, spans, cs in zip(values(batch.column(0)), exact, open_, strict=True):
                more = [
                    {"start": c["start"], "stop": c["stop"], "kind": "neural"}
                    for c in cs
                    if next(taken)
                ]
                spans = sorted(spans + more, key=lambda s: (s["start"], rank[s["kind"]]))
                rows.append((doc_id, spans))
            yield batch_of(rows, target)

    return scanned.select(key, "exact", "candidates").mapInArrow(run, schema)


def secrets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scan, train on the findings, and return the spans of every row of ``docs``."""
    scanned = written(scan(docs, key), "secret-scan")
    return find_secrets(scanned, fit(labelled_findings(scanned)), key)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``; in `text` each secret span is replaced by ``mark``."""
    detector = fit(labelled_findings(written(scan(docs), "secret-scan")))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = [(a, b) for a, b, _ in exact_spans(text)]
        rest = [c for c in candidates(text) if not covered(spans, *c)]
        if rest and detector:
            windows = [
                (text[max(0, a - CONTEXT) : b + CONTEXT], a - max(0, a - CONTEXT), b - a)
                for a, b in rest
            ]
            spans += [c for c, yes in zip(rest, detector.accepts(windows), strict=True) if yes]
        out, done = [], 0
        for a, b in sorted(spans):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in values(batch.column(at))], pa.string())
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets(table(spark, folder, "documents"))

    def joined(spans):
        part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
        return F.array_join(F.transform(spans, part), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "neural")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("neural").alias("n_neural"),
    )
