from itertools import product

import numpy as np
import pytest
from conftest_llm import ODD

from sparkweave.llm import line_crf
from sparkweave.llm.common import fold, fold_col
from sparkweave.llm.line_crf import Chains, fit_quality, forward_backward, judged, label_lines, line_chances, op13_quality_classifier, score_quality

SF01 = "/root/testdata/sf0.01"


def test_chances_equal_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    sizes = [3, 1, 6, 2, 6]
    good, step = rng.normal(size=sum(sizes)) * 2, rng.normal(size=(2, 2))
    want = []
    at = 0
    for n in sizes:
        u = good[at : at + n]
        at += n
        total, each = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(step[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
        want.append(each / total)
    assert np.allclose(line_chances(good, step, Chains.of(sizes)), np.concatenate(want))


def test_long_chain_has_no_overflow():
    p = line_chances(np.full(50_000, 3.0), np.array([[2.0, 0], [0, 2.0]]), Chains.of([50_000]))
    assert np.isfinite(p).all() and p.min() > 0.9
    up, down, whole = forward_backward(np.zeros(0), np.zeros((2, 2)), Chains.of([]))
    assert len(up) == len(down) == len(whole) == 0


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return fit_quality(docs, labels, fold_col("doc_id", 4) != 2)


def test_held_out_documents(spark):
    got = {r["doc_id"]: r for r in op13_quality_classifier(spark, SF01).collect()}
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{SF01}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    for quality in (0, 1):
        mine = [p == q for p, q in held if q == quality]
        assert len(mine) >= 5 and sum(mine) / len(mine) >= 0.95


def test_bad_lines_of_a_mixed_document_are_told(spark, model, docs_of):
    good = "The there is of thand and erenter on that the ander, inone of ther."
    bad = "onan*** the&&& it%%% there### in%%% and$$$ ofand*** ther&&& on%%%"
    lines = [good, good.replace("there", "other"), bad, bad.replace("and", "ing"), bad.replace("on", "er")]
    rows = sorted(map(tuple, label_lines(docs_of([(1, "\n".join(lines)), (2, None)]), model).collect()))
    assert [r[:4] for r in rows if r[0] == 1] == [(1, k, sum(len(x) + 1 for x in lines[:k]), len(x)) for k, x in enumerate(lines)]
    assert [r[1:4] for r in rows if r[0] == 2] == [(0, 0, 0)]
    chance = [r[4] for r in rows if r[0] == 1]
    # The line before bad ones is doubted, as its neighbour speaks against it.
    assert chance[0] > 0.5 > max(chance[2:]) and chance[1] > 3 * max(chance[2:])


def test_quality_is_the_length_weighted_mean(model):
    text = "Short.\n" + "The there is of thand and erenter on that the ander. " * 5 + "\n*** ### |"
    (each,), (quality,) = judged(model, [text])
    long = [max(1, len(x)) for x in text.split("\n")]
    assert np.isclose(quality, np.average(each, weights=long))


def test_lines_are_judged_alike_in_pieces_and_in_company(model, monkeypatch):
    some = [t or "" for _, t in ODD] + ["a\n" * 300 + "b !!"]
    alone = [judged(model, [t])[1][0] for t in some]
    assert np.allclose(judged(model, some)[1], alone)
    monkeypatch.setattr(line_crf, "CHUNK", 7)
    assert np.allclose(judged(model, some)[1], alone)


def test_odd_rows_and_clashing_names(model, docs_of):
    docs = docs_of(ODD).selectExpr("*", "1 AS quality", "2 AS `a.b`")
    got = score_quality(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(of[5]) == 1 and of[1] == of[2]  # repeated rows alike; null as empty
    assert score_quality(docs.limit(0), model).count() == 0


@pytest.mark.parametrize(("labels", "share"), [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 1), (1, 0), (None, 0), (3, None)], 0.5), ([(77, 1), (78, 0), (79, 1)], 2 / 3)])
def test_labels_that_teach_nothing(spark, docs_of, labels, share):
    """No labels, one label, contradicting and null ones, and labels of documents that aren't there."""
    docs = docs_of([(1, "a b c"), (2, "d"), (3, None)])
    model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), None)
    got = score_quality(docs, model).collect()
    assert len(got) == 3 and all(np.isclose(r["score"], share) for r in got)
