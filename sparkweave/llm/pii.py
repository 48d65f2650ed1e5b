"""Personal data by weak-supervision aggregation (operator 10).

Candidate spans come from patterns (mail, address, card, phone in several forms, ids, names after a cue).
Regex, checksum, gazetteer and context labelers vote for or against each. Over all documents the votes are
counted by pattern; expectation-maximisation on these counts estimates how reliable each labeler is, without
any gold labels, and its posteriors train a logistic span classifier on the votes and on surface features.
Base spans, which follow four fixed patterns, always stay; the classifier adds further ones.

Two passes over the texts: one for the vote counts (rows bounded by the number of vote patterns), one that
labels. Nothing is grouped by document, so no key can be hot. Work on a text is linear.

Cases: a null text counts as empty; very long texts are scanned whole; repeated rows repeat their
result and count once each in the statistics; an empty table gives no rows (the labelers then keep their
starting reliabilities); columns beside doc_id and text are not read, and masking keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import overlaps, rows_in_arrow, texts, with_column
from sparkweave.llm.secrets import joined

KINDS = ("email", "ip", "card", "phone", "id", "iban", "name")
BASE = KINDS[:4]
#: The patterns of the base spans. A digit before the address pattern can only lead to the same failure.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OTHER_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])")
NUMBER_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
#: Cues in the languages of the corpus; a name's words start with a capital of any script.
NAME_CUE = regex.compile(
    r"(?<!\p{L})(?:[Mm]y name is|[Nn]ame:|Mrs?\.|Ms\.|Dr\.|[Ss]igned,|[Cc]ontact:|[Mm]ein Name ist|[Ii]ch hei(?:ß|ss)e|Herrn?|Frau|[Jj]e m['’]appelle|[Mm]on nom est|Mme|[Nn]om:|[Mm]e llamo|[Mm]i nombre es|Sra?\.|[Nn]ombre:)"
    r"\x20+(\p{Lu}\p{Ll}+(?:[\x20-]\p{Lu}\p{Ll}+){1,2})"
)
CUES = ("ame is", "ame:", "Mr", "Ms.", "Dr.", "igned,", "ontact:", "Name ist", "ch hei", "Herr", "Frau", "appelle", "nom est", "Mme", "om:", "llamo", "nombre es", "Sr", "ombre:")
#: The gazetteers: usual first names, ends of host names, beginnings of country codes.
FIRST_NAMES = frozenset("anna anne carlos claire daniel david elena emma eva hans isabel james jean john jose julia karl laura linda luis maria marie mark martin mary michael paul peter pierre robert sarah sofia susan thomas".split())
HOST_ENDS = frozenset("com org net edu gov de fr es io uk eu info at ch us it".split())
PHONE_STARTS = ("+1", "+33", "+34", "+39", "+41", "+43", "+44", "+49")
FOR = re.compile(r"mail|contact|call|phone|tel|fax|mobile|reach|visa|card|account|iban|ssn|social|address|host|server|login|name|born|@", re.I)
AGAINST = re.compile(r"version|isbn|figure|section|chapter|page|order|invoice|build|release|ticket|article|equation|table", re.I)
NEAR = 40
LABELERS = ("regex", "checksum", "gazetteer", "context for", "context against", "shape")
THRESHOLD = 0.5
_DIGITS = b"0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from one @ to the next, so that runs without @ cost nothing."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            found.append((s, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return found


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    size: int


def _votes(text: str, kind: str, s: int, e: int, valid: bool, check: int, start: int | None = None) -> tuple[int, ...]:
    word = text[s:e]
    before = text[max(0, s - NEAR) : s if start is None else start]
    if kind == "email":
        known = 1 if word.rpartition(".")[2].lower() in HOST_ENDS else 0
    elif kind == "phone":
        known = 1 if word.startswith(PHONE_STARTS) else 0
    elif kind == "name":
        known = 1 if word.split()[0].lower() in FIRST_NAMES else 0
    else:
        known = 0
    digits = [c for c in word if c.isdigit()]
    odd = len(digits) >= 6 and len(set(digits)) <= 2
    return (1 if valid else -1, check, known, 1 if FOR.search(before) else 0, -1 if AGAINST.search(before) else 0, -1 if odd else 0)


def candidates(text: str) -> list[Candidate]:
    """All candidate spans of a text with their votes; base ones are marked."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[Candidate] = []

    def add(kind: str, s: int, e: int, base: bool, valid: bool, check: int) -> None:
        found.append(Candidate(kind, s, e, base, _votes(text, kind, s, e, valid, check), min(4, (e - s) // 6)))

    if b"@" in raw:
        for s, e in emails(text):
            add("email", s, e, True, True, 0)
    if len(raw.translate(None, _DIGITS)) != len(raw):
        if b"." in raw:
            for m in IP.finditer(text):
                good = all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m.groups())
                add("ip", *m.span(), good, good, 0)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19:
                    good = luhn(digits)
                    add("card", *m.span(), good, good, 1 if good else -1)
        if b"+" in raw:
            for m in PHONE.finditer(text):
                good = 9 <= sum(c in "0123456789" for c in m[0]) <= 15
                add("phone", *m.span(), good, good, 0)
        taken = overlaps([(c.start, c.end) for c in found if c.base])
        for kind, pattern in (("phone", OTHER_PHONE), ("id", NUMBER_ID), ("iban", IBAN)):
            for m in pattern.finditer(text):
                if not taken(*m.span()):
                    add(kind, *m.span(), False, True, _iban_check(m[0]) if kind == "iban" else 0)
    if any(cue in text for cue in CUES):
        for m in NAME_CUE.finditer(text):
            add("name", *m.span(1), False, True, 0)
    return found


def _iban_check(word: str) -> int:
    plain = word.replace(" ", "")
    return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1


@dataclass
class SpanModel:
    reliability: np.ndarray  # labelers x true class x vote (-1, 0, 1)
    weights: np.ndarray

    def keeps(self, c: Candidate) -> bool:
        return 1 / (1 + np.exp(-np.clip(self.weights @ _features(c.kind, c.votes, c.size), -30, 30))) >= THRESHOLD


def _features(kind: str, votes: tuple[int, ...], size: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 5)
    x[0], x[1 + KINDS.index(kind)] = 1, 1
    for k, v in enumerate(votes):
        x[1 + len(KINDS) + 2 * k + (v > 0)] = v != 0
    x[1 + len(KINDS) + 2 * len(LABELERS) + size] = 1
    return x


def fit_votes(counts: dict[tuple[str, tuple[int, ...], int], int], rounds: int = 50) -> SpanModel:
    """Reliabilities by expectation-maximisation, then a logistic classifier on the posteriors."""
    keys = sorted(counts)
    # The starting reliabilities favour votes that point the right way; they also act as pseudo-counts.
    start = np.array([[[0.45, 0.45, 0.1], [0.1, 0.3, 0.6]]] * len(LABELERS))
    reliability = start.copy()
    post = np.zeros(0)
    if keys:
        votes = np.array([k[1] for k in keys]) + 1
        n = np.array([counts[k] for k in keys], float)
        prior = 0.5
        for _ in range(rounds):
            like = np.ones((len(keys), 2))
            for j in range(len(LABELERS)):
                like *= reliability[j][:, votes[:, j]].T
            like *= (1 - prior, prior)
            post = like[:, 1] / like.sum(1)
            prior = float((post @ n + 1) / (n.sum() + 2))
            weak = 0.2 * n.sum() + 5
            for j in range(len(LABELERS)):
                for c, p in enumerate((1 - post, post)):
                    seen = np.bincount(votes[:, j], weights=p * n, minlength=3) + weak * start[j, c]
                    reliability[j, c] = seen / seen.sum()
    # Every vote pattern that could occur teaches a little, so that unseen patterns get the labelers' answer.
    rows, y, w = [], [], []
    for k, p in zip(keys, post, strict=True):
        rows.append(_features(*k))
        y.append(p)
        w.append(min(1.0, counts[k] / 50) + 0.2)
    for kind in KINDS:
        for good in (-1, 1):
            for check in (-1, 0, 1):
                for known in (0, 1):
                    for near in (0, 1):
                        for away in (-1, 0):
                            v = (good, check, known, near, away, 0)
                            odds = sum(np.log(reliability[j, 1, x + 1] / reliability[j, 0, x + 1]) for j, x in enumerate(v))
                            rows.append(_features(kind, v, 2))
                            y.append(1 / (1 + np.exp(-odds)))
                            w.append(0.05)
    x, y, w = np.array(rows), np.array(y), np.array(w)
    weights = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(weights))
        weights -= np.linalg.solve(hess, x.T @ (w * (p - y)) + 0.05 * weights)
    return SpanModel(reliability, weights)


def vote_counts(docs: DataFrame) -> DataFrame:
    """(kind, votes, size, n): how often each vote pattern occurs over all documents."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            seen = Counter((c.kind, " ".join(map(str, c.votes)), c.size) for t in texts(batch) for c in candidates(t))
            return {"kind": [k[0] for k in seen], "votes": [k[1] for k in seen], "size": [k[2] for k in seen], "n": list(seen.values())}

        return run

    return rows_in_arrow(docs.select("text"), make, "kind string, votes string, size int, n long").groupBy("kind", "votes", "size").agg(F.sum("n").alias("n"))


def fit_pii(docs: DataFrame) -> SpanModel:
    """The model of the documents; what comes to the driver is one row per vote pattern that occurs."""
    rows = vote_counts(docs).collect()
    return fit_votes({(r["kind"], tuple(map(int, r["votes"].split())), r["size"]): r["n"] for r in rows})


def find_pii(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that the classifier adds."""
    found = candidates(text)
    return [(c.kind, c.start, c.end) for c in found if c.base], [(c.kind, c.start, c.end) for c in found if not c.base and model.keeps(c)]


def masked(text: str, model: SpanModel) -> str:
    """The text with each span, overlapping ones merged, replaced by its kind in angle brackets."""
    base, more = find_pii(text, model)
    if not base and not more:
        return text
    out, at = [], 0
    for kind, s, e in sorted(base + more, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def label_pii(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), **{f"n_{k}": [] for k in BASE}, "base_sha256": [], "spans": [], "n_added": []}
            for text in texts(batch):
                base, more = find_pii(text, model)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                out["spans"].append(joined(base + more, KINDS))
                out["n_added"].append(len(more))
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_pii(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with personal data masked in text; every row and column stays, a null text stays null."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [None if t is None else masked(t, model) for t in batch.column("text").to_pylist()]
            return with_column(batch, "text", pa.array(new, batch.schema.field("text").type))

        return run

    return rows_in_arrow(docs, make, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return label_pii(docs, fit_pii(docs))
