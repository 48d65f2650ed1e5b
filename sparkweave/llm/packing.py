"""Best-fit packing in bulk-synchronous rounds (operator 8).

Documents are tokenised, closed by id 0, and cut into pieces of at most CAPACITY tokens. Pieces then go into
sequences best-fit by decreasing length. All pieces of one length, and all sequences with one gap, are
interchangeable, so both sides are kept range-sorted by size as runs: lengths as counts, gaps as runs of
consecutive sequences. One round takes the longest length that is left, sweeps over the gaps from its
successor upwards, gives every gap in turn one piece (conflicts go by rank: the first pieces of the length get
the first sequences of the run), updates the gaps, opens new sequences for what fits nowhere, and repeats.
A round costs as many steps as runs are touched; lengths and gaps are at most CAPACITY, so the sweep's work is
bounded by CAPACITY whatever the number of documents, and only the count of each length reaches the driver.

Pieces find their places by rank within their length, in a distributed way: ranks are row numbers inside small
salted groups plus the groups' prefix counts, so that a length that a third of all pieces share is no hot key.

Cases: a null or empty text is the single id 0; longer texts are cut, the last piece may be shorter; repeated
rows are packed each for itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import kept, parts, rows_in_arrow, texts, written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Words kept in each of two generations of a worker's look-up tables.
MOST_WORDS = 140_000
#: Intervals that may be broadcast; the plan has fewer by far, as it doesn't grow with the documents.
MOST_BROADCAST = 2_000_000
_END = b"\0\0\0\0"
#: White space to str.split() that the tokenizer doesn't take for such, and what may begin a special token: such texts are encoded whole.
#: Signs that may follow a word; the tokenizer takes a run of them for one piece. No apostrophe, as it looks for some letters after one.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def vocabulary_path(name: str = VOCABULARY) -> str:
    from public_tokenizers import path

    return str(path(name))


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the others in turn from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def _latin(word: str) -> bool:
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder(dict):
    """Texts to the bytes of their ids, 4 each; every distinct word is encoded once and kept.

    White space separates what the tokenizer encodes, so a text's ids are those of its words in turn. Letters
    up to U+00FF, and a tail of ASCII signs, are separate pieces to the tokenizer: letters go straight to its
    merges, tails are kept as well. All other words go through the whole tokenizer. The table of words has two
    generations: when the younger is full it becomes the older, from which what is asked for again returns."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def tail(self, signs: str) -> bytes:
        ids = self.whole(signs)
        if len(self.tails) < MOST_WORDS:
            self.tails[signs] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(_SIGNS)
            if core.isalpha() and (core.isascii() or _latin(core)):
                tail, core = word[len(core) :], core.lower()
                ids = self.cores.get(core)
                if ids is None:
                    letters = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
                    ids = self.cores[core] = array("I", [t.id for t in self.merges(letters)]).tobytes()
                if tail:
                    ids += self.tails.get(tail) or self.tail(tail)
            else:
                ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(x in text for x in _ODD):
            return self.whole(text)
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        if len(self.cores) > MOST_WORDS:
            self.cores.clear()
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's pieces."""
    path = path or vocabulary_path()

    def make():
        encode = kept(("encoder", path), lambda: Encoder(path)).encode

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), map(encode, texts(batch)), strict=True):
                ids += _END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of runs of pieces, from the count of each length.

    Piece r of a run goes to sequence first + r - first rank, at the run's offset."""
    plan = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, number)
    order: list[int] = []  # the gaps in use, sorted
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        at = bisect.bisect_left(order, length)
        while left and at < len(order):
            gap = order[at]
            first, number = gaps[gap].pop()
            took = min(number, left)
            plan.append((length, rank, rank + took, first, capacity - gap))
            rank, left = rank + took, left - took
            if took < number:
                gaps[gap].append((first + took, number - took))
            if not gaps[gap]:
                order.pop(at)
            if rest := gap - length:
                if not gaps[rest]:
                    bisect.insort(order, rest)
                gaps[rest].append((first, took))
            at = bisect.bisect_left(order, length)
        each = capacity // length
        for k in range(min(each, left)):
            # New sequences take several pieces of the length, one after another, as best fit would.
            took = -(-(left - k) // each)
            plan.append((length, rank, rank + took, opened, k * length))
            rank += took
        if left:
            full, over = divmod(left, each)
            for first, number, held in ((opened, full, each), (opened + full, 1 if over else 0, over)):
                if number and (rest := capacity - held * length):
                    if not gaps[rest]:
                        bisect.insort(order, rest)
                    gaps[rest].append((first, number))
            opened += full + (over > 0)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, a written table, with sequence_id and offset."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * parts(spark))))
    by_salt = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sweep(counts, capacity)
    before = by_salt.withColumn("_before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY _salt) - n")).drop("n")
    ranked = salted.withColumn("_in", F.expr("row_number() OVER (PARTITION BY length, _salt ORDER BY doc_id, piece, ids_crc32) - 1"))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    runs = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _first long, offset long")
    runs = F.broadcast(runs) if len(plan) <= MOST_BROADCAST else runs
    placed = ranked.join(runs, (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*[ranked[c] for c in pieces.columns], (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every row's pieces."""
    return pack(written(token_pieces(docs, path), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
