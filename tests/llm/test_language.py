import numpy as np
from conftest_llm import ODD, texts_of

from sparkweave.llm import language as g
from sparkweave.llm.common import fold, fold_col


def test_codewords_differ():
    for n in (2, 3, 4, 5, 12, 40):
        code = g.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
        assert apart.min() >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark, docs_of):
    rows = [r for r in texts_of("/root/testdata/sf0.01") if r[1]]
    df = docs_of(rows)
    codes = g.fit_language(df, fold_col("doc_id", 3) != 1)
    got = {r["doc_id"]: r for r in g.identify_language(df, codes).collect()}
    held = [(i, lang) for i, _, lang in rows if fold(i, 3) == 1]
    assert len(held) > 200 and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(spark, docs_of):
    df = docs_of([*ODD, (20, "the house and the garden", None), (21, "the old house and the green garden", "en"), (22, "das alte haus und der garten", "de"), (23, "12 34 !?", "en")])
    codes = g.fit_language(df)
    got = {r["doc_id"]: r["lang_pred"] for r in g.identify_language(df, codes).collect()}
    assert all(got[i] == "und" for i in (1, 2, 3, 7, 8, 23)) and got[22] == "de" and got[21] == "en"
    assert {r["lang_pred"] for r in g.identify_language(df, None).collect()} == {"und"}
    kept = g.keep_known_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 20, 21, 22} and kept.filter("doc_id = 5").count() == 2
    assert g.fit_language(df.limit(0)) is None and g.identify_language(df.limit(0), None).count() == 0


def test_the_stage_acts_on_the_decoding(spark, docs_of):
    rows = [r for r in texts_of("/root/testdata/sf0.01") if r[1]]
    de, fr = (next(t for _, t, lang in rows if lang == x and len(t) > 600) for x in ("de", "fr"))
    odd = [(10**6, "Съешь же ещё этих мягких французских булок, да выпей же чаю " * 4), (10**6 + 1, "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて " * 4), (10**6 + 2, "ok"), (10**6 + 3, "Re."), (10**6 + 4, None), (10**6 + 5, "1 2 3")]
    df = docs_of(rows + [(i, t, None) for i, t in odd])
    kept = {r["doc_id"] for r in g.keep_known_language(df).select("doc_id").collect()}
    assert kept == {i for i, _, _ in rows if g.has_letter(_ or "x")} | {10**6 + 2, 10**6 + 3} and de and fr
    assert g.keep_known_language(docs_of([(1, "ein text", None), (2, "12", None)]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).count() == 1


def test_decoding_matches_a_plain_decoder():
    rng = np.random.default_rng(2)
    code = g.codewords(6)
    codes = g.Codes(list("abcdef"), code, np.zeros((1, code.shape[1])), rng.random(code.shape[1]))
    f = rng.normal(0, 2, (40, code.shape[1]))
    best, score, lead, far = g.decode(codes, f)
    for k, row in enumerate(f):
        loss = [sum(t * np.log1p(np.exp(-m * w)) for t, m, w in zip(codes.trust, row, word, strict=True)) for word in code]
        p = sorted(np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum())
        assert best[k] == int(np.argmin(loss)) and abs(score[k] - p[-1]) < 1e-9 and abs(lead[k] - (p[-1] - p[-2])) < 1e-9 and abs(far[k] - min(loss) / code.shape[1]) < 1e-9
