"""Document quality by a linear-chain conditional random field over lines (operator 13).

Every line of a text is good or bad. What speaks for good is a weighted sum of the line's features and of those of the lines
before and after it; a table of transitions ties the labels of neighbouring lines. Forward-backward passes give the
chance of each line to be good, and their mean, weighted by the lines' lengths, is the document's quality; a
logistic curve turns it into the chance of label 1.

Labels are of documents. Lines of good documents are good; those of a bad document start as bad, and from then on are what
the model makes of them, given that one line at least is bad: expected counts under that condition are exact, as
only the sequence of good lines alone is ruled out.

The model is fitted on a bounded sample of labelled documents (MOST_TRAIN, half of each label, picked by a hash of the id, of at
most MOST_LINES lines each), whose line features are made on the executors. All documents are scored whole, in time
proportional to their length.

Cases: a null text is scored as an empty one, which is one empty line; documents with contradicting or null labels don't teach;
with one label alone, or none, every score is the share of label 1, or one half; repeated rows get the same score; an
empty table gives no rows; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import fold_col, rows_in_arrow, texts

#: Labelled documents, as expected by their hashes, that the model is fitted on, and lines that one of these has at most.
MOST_TRAIN, MOST_LINES = 4000, 400
#: Lines whose features are held at once.
CHUNK = 4096
#: Rounds of line labels, and gradient steps in each.
ROUNDS, STEPS, RATE, DECAY = 3, 80, 0.1, 1e-4
GOOD_FROM = 0.7

_KINDS = {"A": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": b"abcdefghijklmnopqrstuvwxyz", "0": b"0123456789", " ": b" \t\x0b\x0c\r", "#": b"#$%&*|@^~=<>{}[]\\/+_", "u": bytes(range(128, 256))}
_SHAPE = bytearray(range(256))
for _sign, _own in _KINDS.items():
    for _b in _own:
        _SHAPE[_b] = ord(_sign)
_SHAPE = bytes(_SHAPE)
#: Levels that shares are compared with, as well as taken as they are.
LEVELS = np.array([0.02, 0.1, 0.3, 0.6], np.float32)
SHARES, PLAIN = 12, 8
WIDTH = SHARES * (1 + len(LEVELS)) + PLAIN


# ---- features

def raw_features(lines: list[str], seen: set[int]) -> np.ndarray:
    """SHARES shares and PLAIN further numbers of each line; seen has the hashes of the document's lines before these."""
    out = np.zeros((len(lines), SHARES + PLAIN), np.float32)
    for k, line in enumerate(lines):
        row, n = out[k], len(line)
        if not line or line.isspace():
            row[SHARES] = 1
            continue
        raw = line.encode("utf-8", "replace")
        shape, size = raw.translate(_SHAPE), len(raw)
        words = line.lower().split()
        m = len(words)
        upper, lower = shape.count(b"A"), shape.count(b"a")
        row[0] = upper / max(1, upper + lower)
        row[1] = shape.count(b"0") / size
        row[2] = shape.count(b"#") / size
        row[3] = (shape.count(b"# ") + shape.endswith(b"#")) / m
        row[4] = raw.count(b"|") / m
        row[5] = raw.count(b"!") / m
        row[6] = (raw.count(b".") + raw.count(b",")) / m
        row[7] = shape.count(b"u") / size
        row[8] = 1 - len(set(words)) / m
        row[9] = sum(map(eq, words, words[1:])) / max(1, m - 1)
        row[10] = shape.count(b" ") / size
        row[11] = shape.count(b"AA") / max(1, upper + lower)
        row[SHARES + 1] = np.log1p(n) / 10
        row[SHARES + 2] = np.log1p(m) / 8
        row[SHARES + 3] = min(2.0, n / m / 10)
        row[SHARES + 4] = raw[-1:] in b".?!"
        row[SHARES + 5] = line[0].isupper()
        row[SHARES + 6] = (h := hash(line)) in seen
        row[SHARES + 7] = 1
        seen.add(h)
    return out


def widened(raw: np.ndarray) -> np.ndarray:
    """Lines x WIDTH: shares, which levels they reach, and the other numbers."""
    shares = raw[:, :SHARES]
    return np.concatenate([shares, (shares[:, :, None] > LEVELS).reshape(len(raw), -1), raw[:, SHARES:]], axis=1, dtype=np.float32)


# ---- chain: bad is 0, good is 1; flat arrays hold the lines of all documents one after another

@dataclass
class Chains:
    """Where documents lie in arrays of lines, longest first."""

    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, sizes: list[int]) -> Chains:
        size = np.array(sizes, np.int64)
        start = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        order = np.argsort(-size, kind="stable")
        return cls(start[order], size[order])

    def __post_init__(self) -> None:
        # How many documents have a line number t.
        self.with_line = np.searchsorted(-self.size, -np.arange(self.size.max(initial=0)), side="left")
        self.last = self.start + self.size - 1


def forward_backward(good: np.ndarray, step: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums of the label sequences up to and behind each line, and each document's log sum, in the order of chains.

    good: what speaks for good at each line; step: 2 x 2 transitions."""
    up, down = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    up[chains.start, 1] = good[chains.start]
    for t in range(1, len(chains.with_line)):
        i = chains.start[: chains.with_line[t]] + t
        a, b = up[i - 1, 0], up[i - 1, 1]
        up[i, 0] = np.logaddexp(a + step[0, 0], b + step[1, 0])
        up[i, 1] = np.logaddexp(a + step[0, 1], b + step[1, 1]) + good[i]
    for t in range(1, len(chains.with_line)):
        i = chains.last[: chains.with_line[t]] - t
        a, b = down[i + 1, 0], down[i + 1, 1] + good[i + 1]
        down[i, 0] = np.logaddexp(a + step[0, 0], b + step[0, 1])
        down[i, 1] = np.logaddexp(a + step[1, 0], b + step[1, 1])
    return up, down, np.logaddexp(up[chains.last, 0], up[chains.last, 1])


def spread(per_doc: np.ndarray, chains: Chains, n: int) -> np.ndarray:
    """A number of each document at all its lines."""
    order = np.argsort(chains.start, kind="stable")
    return np.repeat(per_doc[order], chains.size[order]) if n else np.zeros(0)


def line_chances(good: np.ndarray, step: np.ndarray, chains: Chains) -> np.ndarray:
    """The chance of each line to be good."""
    up, down, whole = forward_backward(good, step, chains)
    return np.exp(up[:, 1] + down[:, 1] - spread(whole, chains, len(good)))


# ---- model

@dataclass
class LineModel:
    weights: np.ndarray  # WIDTH x 3: the line's own features, those of the line before and of the one after
    edge: np.ndarray  # bias, first line, last line
    step: np.ndarray  # 2 x 2
    curve: tuple[float, float]  # slope and offset from a document's log odds
    share: float | None = None  # the answer of a model that met less than two labels

    def score(self, quality: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(quality), self.share)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * odds(quality) + self.curve[1], -50, 50)))


def odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def goodness(model: LineModel, text: str) -> tuple[np.ndarray, np.ndarray]:
    """What speaks for good at each line of a text, and the lines' lengths; features are held for CHUNK lines at a time."""
    lines, seen = text.split("\n"), set()
    own = np.concatenate([widened(raw_features(lines[i : i + CHUNK], seen)) @ model.weights for i in range(0, len(lines), CHUNK)])
    good = own[:, 0] + model.edge[0]
    good[1:] += own[:-1, 1]
    good[:-1] += own[1:, 2]
    good[0] += model.edge[1]
    good[-1] += model.edge[2]
    return good, np.maximum(1, np.fromiter(map(len, lines), np.int64, len(lines)))


def judged(model: LineModel, some: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Chances of the lines of each text, and the texts' qualities."""
    if model.share is not None:
        return [np.full(t.count("\n") + 1, model.share) for t in some], np.full(len(some), model.share)
    if not some:
        return [], np.zeros(0)
    good, long = zip(*[goodness(model, t) for t in some], strict=True)
    sizes = [len(g) for g in good]
    p = line_chances(np.concatenate(good), model.step, Chains.of(sizes))
    cut = np.cumsum(sizes)[:-1]
    return (each := np.split(p, cut)), np.array([float((q * w).sum() / w.sum()) for q, w in zip(each, long, strict=True)])


def fit_lines(raw: list[np.ndarray], long: list[np.ndarray], label: np.ndarray, prior: float) -> LineModel:
    """The model from raw features and lengths of the lines of labelled documents; prior is the share of label 1 among all."""
    chains = Chains.of([len(r) for r in raw])
    n = sum(map(len, raw))
    x = widened(np.concatenate(raw))
    size = np.array([len(r) for r in raw])
    doc = np.repeat(np.arange(len(raw)), size)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    inner = np.flatnonzero(~first)
    # Both labels weigh the same, and so do all documents of a label.
    weight = (1 / (np.array([(label == 0).sum(), (label == 1).sum()])[label] * size))[doc]
    order = np.argsort(chains.start, kind="stable")  # from documents in turn to their places in chains
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    kind = label[doc]
    shapes = [(WIDTH, 3), (3,), (2, 2)]
    model = LineModel(*[np.zeros(s) for s in shapes], curve=(1.0, 0.0))

    def scores() -> np.ndarray:
        own = x @ model.weights
        good = own[:, 0] + model.edge[0] + first * model.edge[1] + last * model.edge[2]
        good[inner] += own[inner - 1, 1]
        good[inner - 1] += own[inner, 2]
        return good

    def expected(good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good lines and of pairs of labels, and the log chance that all lines of a document are good."""
        up, down, whole = forward_backward(good, model.step, chains)
        z = spread(whole, chains, n)
        pairs = np.stack([np.exp(up[inner - 1, a] + model.step[a, b] + b * good[inner] + down[inner, b] - z[inner]) for a in (0, 1) for b in (0, 1)], axis=1)
        all_good = np.bincount(doc, good, len(raw)) + (size - 1) * model.step[1, 1] - whole[order]
        return np.exp(up[:, 1] + down[:, 1] - z), pairs, all_good

    moment, spreadout, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    aim, aim_pairs = kind.astype(float), np.zeros((len(inner), 4))
    aim_pairs[np.arange(len(inner)), kind[inner] * 3] = 1
    for round_ in range(ROUNDS):
        if round_:
            p, pairs, all_good = expected(scores())
            out = np.exp(np.minimum(all_good, -1e-6))[doc]  # ruled out in bad documents
            bad = kind == 0
            aim = np.where(bad, np.clip((p - out) / (1 - out), 0, 1), 1.0)
            ruled = out[inner][:, None] * np.array([0, 0, 0, 1.0])
            aim_pairs = np.where(bad[inner][:, None], np.clip((pairs - ruled) / (1 - out[inner][:, None]), 0, 1), np.array([0, 0, 0, 1.0]))
        for _ in range(STEPS):
            t += 1
            p, pairs, _ = expected(scores())
            r = (aim - p) * weight
            grads = [
                np.stack([x.T @ r, x[inner - 1].T @ r[inner], x[inner].T @ r[inner - 1]], axis=1),
                np.array([r.sum(), r[first].sum(), r[last].sum()]), ((aim_pairs - pairs) * weight[inner][:, None]).sum(0).reshape(2, 2),
            ]
            for k, (value, g) in enumerate(zip((model.weights, model.edge, model.step), grads, strict=True)):
                g = g - DECAY * value
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spreadout[k] = 0.99 * spreadout[k] + 0.01 * g * g
                value += RATE * (moment[k] / (1 - 0.9**t)) / (np.sqrt(spreadout[k] / (1 - 0.99**t)) + 1e-8)
    p = line_chances(scores(), model.step, chains)
    w = np.concatenate(long)
    model.curve = fit_curve(odds(np.bincount(doc, p * w, len(raw)) / np.bincount(doc, w, len(raw))), label, prior)
    return model


def fit_curve(z: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through z, the labels weighing as they do among all documents."""
    weight = np.where(label == 1, prior / max(1, (label == 1).sum()), (1 - prior) / max(1, (label == 0).sum()))
    x, w = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (label - p)) - 1e-4 * (w - [1.0, 0.0])
        w = w + np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(w[0]), float(w[1])


# ---- tables

def taught(labels: DataFrame, teach: Column | None = None) -> DataFrame:
    """(doc_id, quality): the documents of labels that have one label, and may teach."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.coalesce(teach, F.lit(False)) if teach is not None else F.lit(True)))
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    return one.filter("quality = _most AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))


def fit_quality(docs: DataFrame, labels: DataFrame, teach: Column | None = None) -> LineModel:
    """The model of documents (doc_id, text) and labels (doc_id, quality) for which teach, on doc_id, holds."""
    known = taught(labels, teach)
    of = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    nothing = LineModel(np.zeros((WIDTH, 3)), np.zeros(3), np.zeros((2, 2)), (1.0, 0.0))
    if len(of) < 2:
        nothing.share = float(next(iter(of), 0.5))
        return nothing
    each = F.when(F.col("quality") == 1, MOST_TRAIN / 2 / of[1]).otherwise(MOST_TRAIN / 2 / of[0])
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < each * 1_000_000)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"quality": [], "raw": [], "long": []}
            for text, quality in zip(texts(batch), batch.column("quality").to_pylist(), strict=True):
                if text.count("\n") < MOST_LINES:
                    lines = text.split("\n")
                    out["quality"].append(quality)
                    out["raw"].append(raw_features(lines, set()).astype(np.float16).tobytes())
                    out["long"].append(np.array([max(1, len(x)) for x in lines], np.int64).tobytes())
            return out

        return run

    # The sample has MOST_TRAIN rows by expectation, whatever the size of labels.
    mine = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "quality")
    got = sorted(rows_in_arrow(mine, make, "quality int, raw binary, long binary").collect(), key=lambda r: (r["quality"], bytes(r["raw"]), bytes(r["long"])))
    if len({r["quality"] for r in got}) < 2:
        nothing.share = of[1] / (of[0] + of[1])
        return nothing
    raw = [np.frombuffer(r["raw"], np.float16).reshape(-1, SHARES + PLAIN).astype(np.float32) for r in got]
    return fit_lines(raw, [np.frombuffer(r["long"], np.int64) for r in got], np.array([r["quality"] for r in got]), of[1] / (of[0] + of[1]))


def score_quality(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, score, quality for every row of docs: the chance of label 1, and the length-weighted mean chance of its lines to be good."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            _, quality = judged(model, texts(batch))
            return {"doc_id": batch.column("doc_id"), "score": model.score(quality), "quality": quality}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, quality double")


def label_lines(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, line (from 0), start, length (code points), good (its chance) for every line of every row of docs."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            some = texts(batch)
            chances, _ = judged(model, some)
            long = [[len(x) for x in t.split("\n")] for t in some]
            times = [len(x) for x in long]
            return {
                "doc_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(some)), times))), "line": np.concatenate([np.arange(k) for k in times] or [np.zeros(0, int)]),
                "start": np.concatenate([np.concatenate([[0], np.cumsum(np.array(x) + 1)[:-1]]) for x in long] or [np.zeros(0, int)]), "length": np.concatenate([np.array(x) for x in long] or [np.zeros(0, int)]),
                "good": np.concatenate(chances or [np.zeros(0)]),
            }

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, line long, start long, length long, good double")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels, fold_col("doc_id", 4) != 2)
    out = score_quality(docs, model)
    return out.select("doc_id", (fold_col("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "quality")
