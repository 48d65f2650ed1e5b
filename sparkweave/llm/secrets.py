"""Secret scans by dictionary-primed compression novelty (operator 4).

Base spans follow three fixed patterns. Beside them, every long mixed token in a sensitive context is a
candidate: a zstandard compressor, primed with a dictionary of common identifiers, packs the surrounding
text with and without the candidate, and the bytes that the candidate adds tell how much of it neither the
dictionary nor the surroundings explain. Strings that stay incompressible are reported as `novel`. In NAME=value the
value is the candidate and the name belongs to its context. Letters without digits count wherever they are assigned; in prose
only if they aren't built like words, and identifiers of the usual 8-4-4-4-12 form only where they are assigned.

Work on a text is linear: byte look-ups decide which patterns can match at all.

Cases: a null text counts as empty and has no spans; very long texts are scanned whole; repeated rows
repeat their result; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.common import overlaps, rows_in_arrow, texts

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: What primes the compressor: identifiers and words usual in code and configuration.
IDENTIFIERS = """
import return function class public static private const self value string number object index length
config settings environment variable default name user username account email host port server client
database connection endpoint service request response header authorization bearer basic credential
password passwd secret token api_key apikey access_key secret_key private_key public_key client_id
client_secret session cookie signature checksum digest sha1 sha256 md5 uuid version release commit branch
master main origin repository package module library path file directory http https www example.com
localhost 127.0.0.1 true false null none undefined 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 2020-01-01 2021 2022 2023 2024 changeme placeholder
_2023_12_31_235959 _2024_01_01_000000 2025-06-15T12:30:00Z v1.2.3
"""
SENSITIVE = re.compile(r"pass|secret|token|key|auth|cred|bearer|private|sign|login|session|api", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: A variable's name and its sign in a candidate, whose value follows.
NAMED = re.compile(r"[A-Za-z_-][A-Za-z0-9_/-]*=+(?=[^=])")
#: What ends the text before a value that is assigned.
ASSIGNED = re.compile(r"""[:=]\x20*["'`]?\Z""")
#: Forms of identifiers that name something and are no secrets unless they are assigned.
NAME_OF_A_THING = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Parts of a candidate that can be words.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A piece of a path that names something: words, and numbers behind them.
PLACE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}(?:[_-](?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4})*")
#: Characters around and of a candidate, length of a part that can be a word, and digits that a name made of words may have.
NEAR, LEAST, WORDLIKE, FEW_DIGITS = 64, 16, 4, 3
#: Bytes that a candidate must add, as a share of its length.
NOVEL_SHARE = 0.5

_RUN = bytes(ord("t") if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else ord(" ") for i in range(256))
_HEX = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(" ") for i in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    found = []
    if b":" in raw or b"=" in raw:
        low = raw.lower()
        if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed bytes against the identifier dictionary and the surroundings."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=6)
        self.pack = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, candidate: str, after: str) -> int:
        around = before + after
        whole = len(self.pack.compress((before + candidate + after).encode("utf-8", "replace")))
        return whole - len(self.pack.compress(around.encode("utf-8", "replace")))


def wordlike(candidate: str) -> bool:
    """Whether a candidate's parts are as long as words, with few digits, or a path's pieces all name something.

    In prose these are as novel as secrets to the compressor."""
    parts = PART.findall(candidate)
    if "/" in candidate and all(map(PLACE.fullmatch, candidate.split("/"))):
        return True
    return sum(map(len, parts)) >= WORDLIKE * len(parts) and sum(map(str.isdigit, candidate)) <= FEW_DIGITS


def novel_spans(text: str, raw: bytes, novelty: Novelty, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if b"t" * LEAST not in raw.translate(_RUN):
        return []
    found, held = [], overlaps([(s, e) for _, s, e in taken])
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        named = NAMED.match(text, s, e)
        # The name of an assigned value is its context, unless the value alone is too short.
        start = named.end() if named and e - named.end() >= LEAST else s
        word = text[start:e]
        if not any(c.isalpha() for c in word):
            continue
        if held(start, e):
            continue
        before, after = text[max(0, s - NEAR) : start], text[e : e + NEAR]
        if not SENSITIVE.search(before):
            continue
        if NAME_OF_A_THING.fullmatch(word) and not ASSIGNED.search(before):
            continue
        if not ASSIGNED.search(before) and wordlike(word):
            continue
        if novelty.added(before, word, after) >= NOVEL_SHARE * len(word):
            found.append(("novel", start, e))
    return found


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def find_secrets(text: str, novelty: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and the method's further ones, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    return base, novel_spans(text, raw, novelty, base)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""

    def make():
        novelty = Novelty()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_novel": []}
            for text in texts(batch):
                base, more = find_secrets(text, novelty)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
                out["spans"].append(joined(base + more, KINDS))
                out["n_novel"].append(len(more))
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
