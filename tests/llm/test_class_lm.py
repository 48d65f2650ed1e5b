import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, texts_of

from sparkweave.llm import class_lm as c
from sparkweave.llm.common import fold, fold_col


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def scored(df):
    model, counts = c.fit_class_lm(df.filter(fold_col("doc_id", 7) != 2))
    return model, c.score_documents(df, model, counts)


@pytest.mark.parametrize("head", [150_000, 40])
def test_base_scores(spark, docs_of, monkeypatch, head):
    monkeypatch.setattr(c, "HEAD", head)
    monkeypatch.setattr(c, "CLUSTERED", 30)
    rows = [(100 + i, t) for i, t, _ in texts_of()] + [r for r in ODD if r[0] is not None]
    model, out = scored(docs_of(rows))
    n = Counter()
    for i, t in rows:
        if fold(i, 7) != 2:
            n.update([*plain_words(t), None])
    tokens, kinds = sum(n.values()), len(n)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert model.tokens == tokens and sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        own = [*plain_words(t), None]
        base = sum(math.log10((n[w] + 1) / (tokens + kinds + 1)) for w in own)
        for r in got[i]:
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(n[w] > 0 for w in own) and r["base_score"] == pytest.approx(base, abs=1e-6)
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_classes_beat_the_base_on_held_out_texts(spark, docs_of):
    df = docs_of([(i, t) for i, t, _ in texts_of("/root/testdata/sf0.01")])
    _, out = scored(df)
    held = [r for r in out.collect() if fold(r["doc_id"], 7) == 2]
    n = sum(r["n_tokens"] for r in held)
    base, model = (10 ** (-sum(r[k] for r in held) / n) for k in ("base_score", "score"))
    assert len(held) > 80 and model < 0.8 * base


def test_transitions_and_emissions_are_distributions(spark, docs_of):
    model, _ = c.fit_class_lm(docs_of([(i, t) for i, t, _ in texts_of()][:60]))
    assert np.allclose((10**model.step).sum(1), 1)
    held = np.zeros(len(model.within))
    np.add.at(held, model.classes, model.counts + 1.0)
    assert np.allclose(held[: model.end] + 1, np.where(held[: model.end] > 0, 10 ** model.within[: model.end], 1), rtol=1e-9) or len(model.counts) == c.HEAD


def test_exchange_raises_the_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(5)
    n = 24
    b = np.zeros((n + 1, n + 1))
    for _ in range(6000):  # words of three kinds that follow one another in turn
        k = rng.integers(0, 3)
        b[k * 8 + rng.integers(0, 8), ((k + 1) % 3) * 8 + rng.integers(0, 8)] += 1
    of = c.exchange(b, n, classes=3, sweeps=20)

    def likelihood(of):
        k = of.max() + 1
        held = np.zeros((n + 1, k))
        held[np.arange(n + 1), of] = 1
        g = held.T @ b @ held
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(g) - x(g.sum(0)) - x(g.sum(1))

    assert likelihood(of) > likelihood(np.concatenate([np.arange(n) % 3, [3]])) + 100
    assert all(len(set(of[i * 8 : i * 8 + 8])) == 1 for i in range(3)) and len(set(of[:n])) == 3


def test_no_training_rows(spark, docs_of):
    df = docs_of([(1, "a b")])
    model, counts = c.fit_class_lm(df.limit(0))
    r = c.score_documents(df, model, counts).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], model.tokens) == (3, 0, 0.0, 0) and c.score_documents(df.limit(0), model, counts).count() == 0


def test_sweeps_go_on_until_nothing_changes():
    rng = np.random.default_rng(3)
    n = 200
    b = np.pad(rng.poisson(0.6 * rng.pareto(1.2, n)[:, None] * rng.pareto(1.2, n)[None, :]).clip(0, 500).astype(float), ((0, 1), (0, 1)))
    of = c.exchange(b, n, classes=12)
    assert np.array_equal(of, c.exchange(b, n, classes=12, sweeps=500)) and not np.array_equal(of, c.exchange(b, n, classes=12, sweeps=6))


def test_rarer_words_join_the_class_that_raises_the_likelihood_most():
    rng = np.random.default_rng(7)
    k, shapes_at = 4 + c.SHAPES + 1, 4
    x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
    whole = rng.integers(0, 40, (k, k)).astype(float)
    shapes, lengths, codes, ns, want = [], [], [], [], []
    grid = whole.copy()
    words = []
    for _ in range(30):
        s = int(rng.integers(0, c.SHAPES))
        r, le = (np.bincount(rng.integers(0, k, 6), minlength=k) * rng.integers(1, 9) * 1.0 for _ in range(2))
        r[shapes_at + s] = le[shapes_at + s] = 0
        grid[shapes_at + s] += r
        grid[:, shapes_at + s] += le
        words.append((s, r, le))

    for s, r, le in words:
        gains = []
        for g in range(k - 1):  # rows and columns as they would be with the word in g alone, each counted by itself
            rows, cols = grid.copy(), grid.copy()
            for m, sign, at in ((rows, -1, shapes_at + s), (rows, 1, g)):
                m[at] += sign * r
            for m, sign, at in ((cols, -1, shapes_at + s), (cols, 1, g)):
                m[:, at] += sign * le
            size = grid.sum(1)[: k - 1].copy()
            size[shapes_at + s] -= r.sum()
            size[g] += r.sum()
            gains.append(x(rows) + x(cols) - 2 * x(size))
        want.append(int(np.argmax(gains)))
        own = [(a, int(v)) for a, v in enumerate(np.concatenate([r, le])) if v]
        shapes.append(s)
        lengths.append(len(own))
        codes += [a for a, _ in own]
        ns += [v for _, v in own]
    n, got = c.best_classes(grid, shapes_at, *(np.array(v) for v in (shapes, lengths, codes, ns)))
    assert n.tolist() == [int(r.sum()) for _, r, _ in words] and got.tolist() == want


@pytest.mark.parametrize("head", [150_000, 25])
def test_scores_by_hand_over_all_classes(spark, docs_of, monkeypatch, head):
    monkeypatch.setattr(c, "HEAD", head)
    monkeypatch.setattr(c, "CLUSTERED", 20)
    rows = [(i, t) for i, t, _ in texts_of()][:80]
    df = docs_of(rows)
    model, words = c.fit_class_lm(df.filter(fold_col("doc_id", 7) != 2))
    known = {r["h"]: (r["n"], r["cls"]) for r in words.collect()}
    end = model.end
    code = lambda t: [end, *(known.get(c.word_hash(w), (0, model.shapes_at + c.shape(w)))[1] for w in c.words_of(t or "")), end]
    grid, size, kinds = np.zeros((end + 1, end + 1)), np.zeros(end + 1), np.zeros(end + 1)
    for i, t in rows:
        if fold(i, 7) != 2:
            for a, b in zip(code(t), code(t)[1:], strict=False):
                grid[a, b] += 1
    for n, cls in known.values():
        size[cls] += n
        kinds[cls] += 1
    share = (grid.sum(0) + 1) / (grid.sum() + end + 1)
    step = (grid + c.DRAW * share) / (grid.sum(1, keepdims=True) + c.DRAW)
    got = {r["doc_id"]: r["score"] for r in c.score_documents(df, model, words).collect()}
    for i, t in rows:
        own = code(t)
        emit = sum(math.log10((known.get(c.word_hash(w), (0, 0))[0] + 1) / (size[cls] + kinds[cls] + 1)) for w, cls in zip(c.words_of(t or ""), own[1:-1], strict=True))
        assert got[i] == pytest.approx(sum(math.log10(step[a, b]) for a, b in zip(own, own[1:], strict=False)) + emit, abs=1e-6)
    assert len({cls for _, cls in known.values()}) > c.SHAPES


def test_neighbours_are_those_of_a_plain_count(spark, docs_of, monkeypatch):
    monkeypatch.setattr(c, "MOST_NEIGHBOURS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # words go on from batch to batch
    try:
        rows = [(i, t) for i, t, _ in texts_of()][:40]
        n = Counter(w for _, t in rows for w in c.words_of(t or ""))
        top = {w: k % 3 for k, (w, _) in enumerate(n.most_common(9))}
        h = sorted((c.word_hash(w), n[w], k) for w, k in top.items())
        model = c.ClassModel(*(np.array(x) for x in zip(*h, strict=True)), np.zeros((12, 12)), 0.0, np.zeros(12), 0, 0, 3)
        want = Counter()
        of = lambda w: model.end if w is None else top.get(w, 3 + c.shape(w))
        for _, t in rows:
            words = [None, *c.words_of(t or ""), None]
            for a, w, b in zip(words, words[1:], words[2:], strict=False):
                if w not in top:
                    want[c.word_hash(w), of(b)] += 1
                    want[c.word_hash(w), 12 + of(a)] += 1
        grid = np.random.default_rng(1).integers(50, 90, (12, 12)) + 10_000.0
        found = c.neighbours(docs_of(rows), model)
        got = Counter()
        for r in found.collect():
            for a, k in zip(np.frombuffer(r["codes"], np.uint8).tolist(), np.frombuffer(r["ns"], np.int64).tolist(), strict=True):
                got[r["h"], a] += k
        assert got == want
        placed = {r["h"]: (r["n"], r["cls"]) for r in c.classes_by_exchange(found, grid, 3).collect()}
        assert len(placed) == len(n) - 9
        for w in set(n) - set(top):
            own = sorted((a, k) for (x, a), k in want.items() if x == c.word_hash(w))
            m, cls = c.best_classes(grid, 3, np.array([c.shape(w)]), np.array([len(own)]), *(np.array(x) for x in zip(*own, strict=True)))
            assert placed[c.word_hash(w)] == (m[0], cls[0]) and m[0] == n[w]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_words_of_a_batch_are_those_of_its_texts_and_only_distinct_ones_are_hashed(monkeypatch):
    texts = [None, "", " ", "a  B\tb\x0bC\x0cd\r\ne ", "  \x1cx\x1f y\x85z\u00a0w\u2003\u3000v \x00", "É é ÀB ß İ", "longwords9 longwords! a.", "1.", "end", " a " * 50, "\U0001f600 é!", *(t for _, t, _ in texts_of())]
    seen = []
    monkeypatch.setattr(c.xxhash, "xxh3_64_intdigest", lambda w, own=c.xxhash.xxh3_64_intdigest: (seen.append(w), own(w))[1])
    for lo, hi in ((0, len(texts)), (3, 9), (0, 3), (5, 5)):
        seen.clear()
        w = c.Words.of(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(lo, hi - lo))
        own = [c.words_of(t or "") for t in texts[lo:hi]]
        flat = [x for t in own for x in t]
        assert len(seen) == len(set(flat)) == len(w.h)
        assert w.lengths.tolist() == [len(t) for t in own] and w.h[w.at].tolist() == [c.word_hash(x) for x in flat] and w.shapes[w.at].tolist() == [c.shape(x) for x in flat]
        assert w.laid(w.h, 7).tolist() == [7, *(y for t in own for y in (*map(c.word_hash, t), 7))]
