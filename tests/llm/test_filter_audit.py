import hashlib
import re
from itertools import permutations

import pytest
from conftest_llm import ODD, SF

from sparkweave.llm.filter_audit import BIT, LETTERS, audit_filters, failed, op12_filter_interaction_audit, words

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order walked document by document; docs: (doc_id, text, lang), labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    parts = {}
    for doc_id, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and doc_id > first[text])
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    rows = []
    for part, kinds in parts.items():
        lost = dict.fromkeys(LETTERS, 0)
        for order in map("".join, permutations(LETTERS)):
            left = kinds
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                lost[f] += len(gone)
                rows.append([part, order, k + 1, len(left), len(gone), sum(f in x[0] for x in kinds) - len(gone), sum(x[0] == f for x in kinds), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        for r in rows[-600:]:
            r.append(lost[r[1][r[2] - 1]])
    return sorted(map(tuple, rows))


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS mask", "1 AS part")


def got(docs, labels):
    return sorted(map(tuple, audit_filters(docs, labels).select(*COLUMNS).collect()))


def test_equals_a_walk_through_every_order(spark, docs_of, labels_of):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, long, "en"), (2, long, "en"), (3, long + " $", "en"), (4, "UP " * 300, None), (5, "a b", ""), (6, None, "de"), (7, "", "en"), (8, long, "de"), (9, long.upper(), "en"), (None, long, "en"), (None, "other", "en"), (8, long, "de")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, None), (4, 1, None), (9, 0, 0), (99, 1, 1), (None, 1, 1)]
    assert got(docs_of(rows), labels_of(labels)) == brute(rows, labels)


def test_odd_rows(docs_of, labels_of):
    rows = [(i, t, "en") for i, t in ODD]
    assert got(docs_of(rows), labels_of([(4, 1, 1)])) == brute(rows, [(4, 1, 1)])


def test_dotted_and_clashing_names(docs_of, labels_of):
    docs = docs_of([(1, "a b", "en")]).selectExpr("*", "1 AS `a.b`", "2 AS before", "3 AS hash")
    assert audit_filters(docs, labels_of([(1, 1, 1)])).count() == 600


def test_empty_table(docs_of, labels_of):
    assert got(docs_of([(1, "a", "en")]).limit(0), labels_of([])) == []


def test_words_are_split_at_the_six_blanks_alone(spark, docs_of):
    some = [" \t\n\x0b\x0c\ra\x0bb c d \x1fe ", "", "   ", "\x0b", "x"]
    df = docs_of(list(enumerate(some)))
    mine = {r["doc_id"]: r["w"] for r in df.select("doc_id", words(df["text"]).alias("w")).collect()}
    assert mine == {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in enumerate(some)}


def test_masks_and_hashes(docs_of):
    r = failed(docs_of([(1, "É|" + "Q" * 3, "en")])).first()
    assert r["mask"] == BIT["A"] + BIT["C"] + BIT["D"] and bytes(r["hash"]) == hashlib.sha256(("É|" + "Q" * 3).encode()).digest()


def test_query_reads_all_rows(spark):
    rows = op12_filter_interaction_audit(spark, SF)
    assert rows.columns == COLUMNS
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, rows.collect())) == brute(docs, labels)
