"""Rows without a doc_id in the operators that group, pack and score documents."""

import math
import zlib
from array import array

from sparkweave.llm import class_lm, jaccard, packing
from sparkweave.llm.common import fold_col

LONG = " ".join(f"w{k}" for k in range(60))


def test_they_are_packed_each_for_itself(docs_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = [(None, "no id at all"), (None, "another one"), (None, "no id at all"), (None, None), (1, "with an id")]
    got = packing.pack_documents(docs_of(rows)).collect()
    want = sorted(zlib.crc32(array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in got) == want and sum(r["doc_id"] is None for r in got) == 4
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[1] + a[2] == b[1] for a, b in zip(places, places[1:]) if a[0] == b[0])


def test_they_are_scored(docs_of):
    rows = [(None, "aa bb aa"), (None, None), *[(i, "aa bb cc") for i in range(20)]]
    df = docs_of(rows)
    model, counts = class_lm.fit_class_lm(df.filter(fold_col("doc_id", 7) != 2))
    got = [r for r in class_lm.score_documents(df, model, counts).collect() if r["doc_id"] is None]
    assert sorted(r["n_tokens"] for r in got) == [1, 4] and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_they_link_others_or_stay_alone(docs_of):
    got = [tuple(r) for r in jaccard.link_components(docs_of([(None, LONG), (None, "other words of its own"), (3, LONG), (7, LONG), (None, None)])).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == 5 and {r for r in got if r[0] is not None} == {(3, 58, 3), (7, 58, 3)}
    assert sorted(r[1] for r in got if r[0] is None) == [0, 3, 58]
