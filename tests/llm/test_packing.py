import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, texts_of
from tokenizers import Tokenizer

from sparkweave.llm import packing as p


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(p.vocabulary_path())


def ids(plain, t):
    return np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids_are_the_tokenizers(plain):
    e = p.Encoder(p.vocabulary_path())
    odd = ["a b ćd", "Ünï ΑΣ ςΣ İstanbul", "x<|endoftext|>y", "a\x1cb", "", "  ", "日本語 テキスト ﬁ", "​zero line\u0085n", "don't I'LL it's'S 12 3,4", "a﻿ b", "é x", "ª º µ ß ÿ", "naïve... (ok)!? --- a'b"]
    rng = random.Random(3)
    odd += ["".join(rng.choice("aB'é.,!%3 \ńſ") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for t in odd + [t or "" for _, t, _ in texts_of()]:
        assert e.encode(t) + b"\0\0\0\0" == ids(plain, t).tobytes(), t


@pytest.mark.parametrize("seed", range(5))
def test_sweep_packs_all_without_gaps_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    sizes = [min(2048, max(1, int(rng.lognormvariate(rng.uniform(3, 7), 1.2)))) for _ in range(4000)]
    counts = Counter(sizes)
    held, seen = defaultdict(list), Counter()
    for length, a, b, first, at in p.sweep(counts):
        seen[length] += b - a
        for r in range(b - a):
            held[first + r].append((at, length))
    assert seen == counts
    for row in held.values():
        end = 0
        for at, length in sorted(row):
            assert at == end
            end += length
        assert end <= 2048
    assert len(held) <= 1.03 * sum(sizes) / 2048 + 1 + sum(c for k, c in counts.items() if k > 1024) * 0.1


def test_rows(spark, docs_of, plain):
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, t) for i, t, _ in texts_of()]
    rows += [(9000 + k, "one and the same text") for k in range(500)]
    got = p.pack_documents(docs_of(rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t, *_ in rows:
        if i == 5:
            assert len(by[5]) == 2  # a repeated row is packed each time
            continue
        want = ids(plain, t)
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(want)
        for r in pieces:
            own = want[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(own.tobytes())
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for row in held.values():
        end = 0
        for at, length in sorted(row):
            assert at == end
            end += length
        assert end <= 2048
    assert len(held) <= sum(r["length"] for r in got) / 2048 * 1.05 + 2
    assert p.pack_documents(docs_of([]).limit(0)).count() == 0
