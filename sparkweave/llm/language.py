"""Language ID by error-correcting output codes (operator 3).

Every language gets a codeword; one binary classifier per codeword bit predicts that bit from hashed
byte 2- to 4-gram frequencies of the whole lower-cased text. Loss-weighted decoding adds the logistic loss
of each bit, weighted by that bit's training accuracy, and takes the nearest codeword, of equally near ones the first in
order of the languages' names; a text whose two nearest codewords lie close together is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (MOST_TRAIN, spread over languages, picked
by a hash of the id), as sparse n-gram counts made on the executors. Prediction reads the text alone.

Cases: a null text, or one without a letter, is `und` with score 0; rows with a null language don't teach;
without any labelled row every text is `und`; repeated rows get the same answer; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import fold_col, rows_in_arrow, texts

BUCKETS = 8192
#: Labelled rows, as expected by their hashes, that the classifiers are fitted on, over all languages.
MOST_TRAIN = 2400
#: Characters handled at once, for bounded memory.
CHUNK = 1 << 20
MARGIN = 0.05
#: Mean loss of a bit, or more if labelled texts reach more, beyond which a text is far from every codeword (a guess has 0.69),
#: the letters that it takes to say so, and the texts that every language must have taught for that.
FAR, LEAST_LETTERS, LEAST_TAUGHT = 0.42, 40, 40


@dataclass
class Codes:
    langs: list[str]
    words: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets + 1 x bits
    trust: np.ndarray  # per bit
    far: float = np.inf  # the mean loss of a bit beyond which a text belongs to no language


def codewords(n: int) -> np.ndarray:
    """n codewords: all distinct splits where few, else bits of a fixed random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [[1 if j == 0 or (m >> (j - 1)) & 1 else -1 for j in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(cols).T.astype(float)
    rng = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart.min()
    return best


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 2- to 4-grams of the whole text."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(1, len(text)), CHUNK):
        b = np.frombuffer((" " + text[max(0, at - 3) : at + CHUNK].lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(65599) + b[2:]
        four = three[:-1] * np.uint32(65599) + b[3:]
        for k, g in enumerate((two, three, four)):
            total += np.bincount((g * np.uint32(2654435761) + np.uint32(k * 97)) >> np.uint32(19), minlength=BUCKETS)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def fit_codes(x: np.ndarray, langs: list[str], steps: int = 120) -> Codes:
    """Logistic regressions for all bits at once, by accelerated gradient steps."""
    known = sorted(set(langs))
    words = codewords(len(known))
    y = words[[known.index(v) for v in langs]]
    share = np.array([1.0 / (len(known) * langs.count(v)) for v in known])
    per_row = share[[known.index(v) for v in langs]][:, None].astype(np.float32)
    w, v = np.zeros((x.shape[1], words.shape[1]), np.float32), np.zeros((x.shape[1], words.shape[1]), np.float32)
    for k in range(steps):
        f = np.clip(x @ v, -30, 30)
        grad = x.T @ (-y / (1 + np.exp(y * f)) * per_row).astype(np.float32)
        new = v - 60.0 * (grad + 1e-5 * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    right = ((x @ w) * y > 0).astype(np.float32)
    trust = (right * per_row).sum(0)
    codes = Codes(known, words, w, trust / max(trust.sum(), 1e-9) * len(trust))
    # What the languages' own texts reach, but for one in a thousand, is not far; a few texts don't show what a language reaches.
    if min(map(langs.count, known)) >= LEAST_TAUGHT:
        codes.far = max(FAR, float(np.quantile(decode(codes, x @ w)[3], 0.999)))
    return codes


def decode(codes: Codes, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score from 0 to 1, the lead over the next one, and its mean loss, for rows of bit margins."""
    loss = (np.logaddexp(0, -f[:, None, :] * codes.words[None]) * codes.trust).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0), loss.min(1) / f.shape[1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def fit_language(docs: DataFrame, teach: Column | None = None) -> Codes | None:
    """The codes learnt from rows of docs (text, lang, doc_id) for which teach holds; None without labels."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(teach, F.lit(False)) if teach is not None else F.lit(True)))
    of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not of:
        return None
    each = max(8, MOST_TRAIN // len(of))
    share = F.create_map(*[x for k, n in of.items() for x in (F.lit(k), F.lit(int(1e6 * min(1.0, each / n))))])
    some = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.length("text")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))

    def make():
        def count(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"lang": [], "at": [], "n": []}
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                middle = len(text) // 2
                for part in (text, text[middle : middle + 48]):  # a short piece as well, as short texts occur
                    if has_letter(part):
                        c = gram_counts(part)
                        at = np.flatnonzero(c)
                        out["lang"].append(lang)
                        out["at"].append(at.astype(np.uint16).tobytes())
                        out["n"].append(np.minimum(c[at], 65535).astype(np.uint16).tobytes())
            return out

        return count

    got = sorted(rows_in_arrow(some.select("text", "lang"), make, "lang string, at binary, n binary").collect(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    if not got:
        return None
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = features(np.frombuffer(r["n"], np.uint16))
    return fit_codes(x, [r["lang"] for r in got])


def predict(codes: Codes | None, some: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """lang_pred, score, whether the text is ambiguous, and its distance from the nearest codeword, for a list of texts."""
    lang, score, lead, far = ["und"] * len(some), np.zeros(len(some)), np.ones(len(some)), np.zeros(len(some))
    at = [i for i, t in enumerate(some) if codes and t is not None and has_letter(t)]
    for i in range(0, len(at), 64):
        own = at[i : i + 64]
        f = features(np.stack([gram_counts(some[j]) for j in own])) @ codes.weights
        best, score[own], lead[own], far[own] = decode(codes, f)
        for j, b in zip(own, best, strict=True):
            lang[j] = codes.langs[b]
    return lang, score, lead < MARGIN, far


def identify_language(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            lang, score, unsure, _ = predict(codes, batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "ambiguous": unsure}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    codes = fit_language(docs, fold_col("doc_id", 3) != 1)
    out = identify_language(docs, codes)
    return out.select("doc_id", (fold_col("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known_language(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language can't be told; all columns stay.

    These are texts without a letter, and texts of at least LEAST_LETTERS letters that lie far from every codeword or as near to
    two: another language or script, or no language. Shorter texts say too little for that and stay; where a
    language has fewer than LEAST_TAUGHT labelled texts all that have a letter stay."""
    codes = fit_language(docs, fold_col("doc_id", 3) != 1)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = batch.column("text").to_pylist()
            _, _, unsure, far = predict(codes, some)
            doubtful = (unsure | (far > codes.far)) & np.isfinite(codes.far) if codes else np.zeros(len(some), bool)
            return batch.filter(pa.array([t is not None and has_letter(t) and not (d and letters(t) >= LEAST_LETTERS) for t, d in zip(some, doubtful, strict=True)], pa.bool_()))

        return run

    return rows_in_arrow(docs, make, docs.schema)
