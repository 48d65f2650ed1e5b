"""Benchmark decontamination by template canonicalisation (operator 7).

Texts become templates: numbers, units and names turn into typed placeholders, other words into their
lower-cased letters. Windows of WINDOW template words are hashed together with the equality pattern of
their slots, and document windows meet benchmark windows in a hash join. Beside them, windows of the same words
without any placeholder meet one another, whatever their slots. Matches that continue one another
(same item, same distance between the places) form a run. Template windows with few plain words lengthen or bridge a run, but
don't make one by themselves. A run counts when it spans RUN words, or
a shorter item but for a word, and its slots are consistent: one value of the item always stands for one value of
the document, so that re-parameterised questions are caught and chance matches of templates are not. A run whose slots
conflict is split there: what counts by itself is each stretch of RUN words whose slots hold the item's own values, and each
consistent stretch of BROKEN_RUN words with other values.

Document windows are tested against the sorted benchmark hashes while texts are read, so only matches leave
the scan. These hashes are broadcast when there are at most MOST_HASHES of them; beyond that all document
windows go into the same hash join, whose benchmark side is broadcast up to MOST_BROADCAST rows. Matches are pre-aggregated per document and item; no pair of documents
is ever formed, so a passage that a third of all documents share costs each of them its own windows.

Cases: null or empty texts match nothing; an item of fewer words than a window is one window of its own, by its words as they are
alone where it has less than LEAST_WORDS, as a template of so few words says nothing; an empty benchmark or table gives no rows; repeated documents repeat their result once per
distinct id; extra columns are not read, and filtering keeps them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import kept, rows_in_arrow, texts, without, written

WINDOW, RUN, LEAST_WORDS, LEAST_LITERAL = 8, 10, 5, 4
#: Words of a stretch with other values than the item's that counts although its run's slots conflict elsewhere; shorter ones are another question.
BROKEN_RUN = 2 * RUN
MOST_HASHES, MOST_BROADCAST = 2_000_000, 200_000
#: Words kept in a worker's look-up table.
MOST_WORDS = 250_000
#: Units of measure and money that give way to a placeholder.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds"
    " ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year"
    " years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers".split()
)
NUMBER = re.compile(r"[$€£]?[-+]?[0-9][0-9.,:/]*(?:[a-z%°]{0,3})")
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
STRIP = ".,;:!?\"'()[]{}<>«»“”‘’¿¡*_#`~|"
#: Signs within words that copies write in different ways.
APOSTROPHES = str.maketrans("", "", "'’‘`´")
#: What each word's entry says beside its template and its own hash.
NUM, UNIT, CAPITAL, ENDS, LITERAL = 1, 2, 4, 8, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of benchmark windows: template with few plain words, template with enough, words as they are.
POOR, ENOUGH, PLAIN = 0, 1, 2
_PLAIN = np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Look-up from a raw word to its place in the arrays of template hashes, value hashes and flags."""

    def __init__(self) -> None:
        super().__init__()
        self._room(1 << 16)

    def _room(self, n: int) -> None:
        """Arrays with n places, which keep what they had; single values are set through views, which is faster."""
        old = (self.t, self.v, self.f) if hasattr(self, "t") else ()
        self.t, self.v, self.f = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        for mine, was in zip((self.t, self.v, self.f), old, strict=False):
            mine[: len(was)] = was
        self.views = memoryview(self.t), memoryview(self.v), memoryview(self.f)

    def __missing__(self, raw: str) -> int:
        at = self[raw] = len(self)
        if at >= len(self.t):
            self._room(2 * len(self.t))
        t, v, f = self.views
        if raw.isalpha() and raw.islower() and raw not in UNITS and raw not in NUMBER_WORDS:  # most words; no sign to strip
            t[at] = h = _hash(raw)
            v[at], f[at] = _value(h), LITERAL
            return at
        word = raw.strip(STRIP)
        low = word.lower()
        flags = ENDS if raw[-1] in ".!?:\"”»" else 0
        if low[:1] in _NUMERIC and NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kind, flags = "\x00number", flags | NUM
        elif low in UNITS:
            kind, flags = "\x00unit", flags | UNIT
        else:
            kind, flags = low, flags | (CAPITAL if word[:1].isupper() else 0) | (LITERAL if low else 0)
        bare = low.translate(APOSTROPHES)
        t[at] = h = _hash(kind)
        v[at], f[at] = _value(h if bare == kind else _hash(bare)), flags
        return at

    def of(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > MOST_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return self.t[at], self.v[at], self.f[at]


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace"))


def _value(h: int) -> int:
    """The hash of a word as it is, from that of its letters."""
    return (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


NAME = np.uint64(_hash("\x00name"))
_NUMERIC = frozenset("0123456789$€£+-")


def template(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, value hashes and whether the place is a slot, word by word; bare punctuation is left out."""
    t, v, f = words.of(text.split())
    if not len(t):
        return t, v, np.zeros(0, bool)
    first = np.concatenate([[True], (f[:-1] & ENDS) > 0])
    name = ((f & CAPITAL) > 0) & ~first
    t = np.where(name, NAME, t)
    kept = (f & (NUM | UNIT | LITERAL)) > 0
    return t[kept], v[kept], (name | ((f & (NUM | UNIT)) > 0))[kept]


def _bare(t: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of template words, without its slots' pattern."""
    h = np.zeros(max(0, len(t) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if len(h) else 0):
            h = (h ^ t[k : k + len(h)]) * _MIX
            h ^= h >> np.uint64(29)
    return h


def _pattern(v: np.ndarray, slot: np.ndarray) -> np.uint64:
    """Hash of the equality pattern of a window's slots."""
    seen: dict[int, int] = {}
    return np.uint64(_hash(str([seen.setdefault(int(x), len(seen)) for x in v[slot]])))


def _slots_inside(slot: np.ndarray, size: int) -> np.ndarray:
    held = np.concatenate([[0], np.cumsum(slot)])
    return held[size:] - held[:-size]


def window_hashes(t: np.ndarray, v: np.ndarray, slot: np.ndarray, size: int = WINDOW, bases: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window with the equality pattern of its slots; and whether it has enough plain words.

    With bases, the bare hashes of the other side, windows beyond them keep their bare hash, which no window with a pattern has."""
    h = _bare(t, size)
    if not len(h):
        return h, np.zeros(0, bool)
    inside = _slots_inside(slot, size)
    many = inside > 1
    if bases is not None:
        many &= bases.holds(h)
    for p in np.flatnonzero(many):
        h[p] ^= _pattern(v[p : p + size], slot[p : p + size])
    return h, size - inside >= min(LEAST_LITERAL, size - 1)


def plain_hashes(v: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of each window of words as they are, but for case, apostrophes and outer punctuation, so that no capital or full stop decides."""
    h = np.full(max(0, len(v) - size + 1), _PLAIN, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if len(h) else 0):
            h *= _MIX
            h += v[k : k + len(h)]
    return h ^ (h >> np.uint64(29))


class Hashes:
    """A set of hashes: sorted, after a table of their first bits that turns most others away."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        bits = min(24, max(12, (16 * len(known)).bit_length()))
        self.shift, self.first = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.first[known >> self.shift] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.first[h >> self.shift]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.known[np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)] == h[at]
        return out


def _reaching(met: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The places of met whose unbroken stretch has a strong one."""
    at = np.flatnonzero(met)
    if not len(at):
        return at
    stretch = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    return at[np.bincount(stretch, strong[at])[stretch] > 0]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, bare, size, kind, item_id, item_at, item_words, slots, vals): every window of every item, by template and by its plain words.

    An item shorter than a window gives one window of its own length."""

    def make():
        words = Words()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("hash", "bare", "size", "kind", "item_id", "item_at", "item_words", "slots", "vals")}
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch), strict=True):
                t, v, slot = template(text, words)
                size = min(len(t), WINDOW) or WINDOW
                bare, (h, good), plain = _bare(t, size), window_hashes(t, v, slot, size), plain_hashes(v, size)
                for p in range(len(h)):
                    here = np.flatnonzero(slot[p : p + size])
                    vals = v[p + here].view(np.int64).tolist()
                    for x, kind in ((h, ENOUGH if good[p] else POOR), (plain, PLAIN))[size < LEAST_WORDS :]:
                        for k, y in (("hash", int(x[p : p + 1].view(np.int64)[0])), ("bare", int(bare[p : p + 1].view(np.int64)[0])), ("size", size), ("kind", kind), ("item_id", item), ("item_at", p), ("item_words", len(t)), ("slots", here.tolist()), ("vals", vals)):
                            out[k].append(y)
            return out

        return run

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return rows_in_arrow(benchmark.select("item_id", "text"), make, f"hash long, bare long, size int, kind int, item_id {kind}, item_at int, item_words int, slots array<int>, vals array<long>")


def document_windows(docs: DataFrame, sizes: list[int], known: np.ndarray | None, bases: np.ndarray | None) -> DataFrame:
    """(doc_id, hash, size, doc_at, vals): windows of the sizes in use, by template and by their plain words, the latter without vals.

    With known and bases, only those with their hash among known, in stretches that can make a run."""

    def make():
        words = kept(("templates",), Words)
        here_known, here_bases = (None if x is None else Hashes(x) for x in (known, bases))

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "hash", "size", "doc_at", "vals")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                t, v, slot = template(text, words)
                for size in sizes:
                    (h, good), plain = window_hashes(t, v, slot, size, here_bases), plain_hashes(v, size)
                    if here_known is None:
                        by_template = by_plain = np.ones(len(h), bool)
                        at = np.arange(len(h))
                    else:
                        by_template, by_plain = here_known.holds(h), here_known.holds(plain)
                        at = _reaching(by_template | by_plain, by_template & good | by_plain)
                    for p in at.tolist():
                        if by_template[p]:
                            here = np.flatnonzero(slot[p : p + size])
                            for k, y in (("doc_id", doc), ("hash", int(h[p : p + 1].view(np.int64)[0])), ("size", size), ("doc_at", p), ("vals", v[p + here].view(np.int64).tolist())):
                                out[k].append(y)
                        if by_plain[p]:
                            for k, y in (("doc_id", doc), ("hash", int(plain[p : p + 1].view(np.int64)[0])), ("size", size), ("doc_at", p), ("vals", [])):
                                out[k].append(y)
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, hash long, size int, doc_at int, vals array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_words): documents that hold a run of an item, with its length in words."""
    known = benchmark_windows(benchmark)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    if not size["n"]:
        none = docs.select("doc_id").limit(0)
        return none.join(benchmark.select("item_id").limit(0), F.lit(True)).withColumn("n_windows", F.lit(0).cast("long")).withColumn("n_words", F.lit(0).cast("long"))
    hashes = bases = None
    if size["n"] <= MOST_HASHES:
        hashes, bases = (np.sort(np.array([r[0] for r in known.select(k).distinct().collect()], np.int64).view(np.uint64)) for k in ("hash", "bare"))
    found = document_windows(docs, size["sizes"], hashes, bases)
    known = known.drop("bare").withColumnRenamed("vals", "item_vals")
    known = F.broadcast(known) if size["n"] <= MOST_BROADCAST else known
    # Windows of plain words stand for the item's own values.
    pairs = found.join(known, ["hash", "size"]).withColumn("apart", F.col("doc_at") - F.col("item_at")).withColumn("vals", F.expr(f"IF(kind = {PLAIN}, item_vals, vals)"))
    pairs = written(pairs, "windows")
    run = ["doc_id", "item_id", "item_words", "apart"]
    spans = pairs.groupBy(*run, "item_at", "size").agg(F.max((F.col("kind") != POOR).cast("int")).alias("strong"), F.max((F.col("kind") == ENOUGH).cast("int")).alias("enough"), F.collect_set(F.arrays_zip(F.col("item_vals").alias("a"), F.col("vals").alias("b"))).alias("slots"))
    # Runs without a gap, by the usual row-number difference; a run's rows are bounded by its item's length.
    gap = spans.withColumn("island", F.expr("item_at - row_number() OVER (PARTITION BY doc_id, item_id, item_words, apart ORDER BY item_at)"))
    runs = gap.groupBy(*run, "island").agg(
        F.first("size").alias("size"), F.max("strong").alias("strong"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("item_at", "strong", "enough", F.flatten("slots").alias("slots")))).alias("windows"),
    )
    runs = runs.filter("strong = 1").filter(F.col("n") + F.col("size") - 1 >= F.least(F.lit(RUN), F.col("item_words") - 1))
    return _counted(runs).groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.max("n_words").alias("n_words"))


def consistent(slots: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The longest stretches, as (first, last + 1), of windows in which no value of the item stands for two of the document."""
    out, lo = [], 0
    last: dict[int, dict[int, int]] = {}  # value of the item: value of the document: last window with both
    for at, pairs in enumerate(slots):
        for a, b in pairs:
            last.setdefault(a, {})[b] = at
        new = max([lo, *(k + 1 for a in {a for a, _ in pairs} if len(last[a]) > 1 for k in sorted(last[a].values())[:-1])])
        if new > lo:
            if at > lo:
                out.append((lo, at))
            lo = new
    return [*out, (lo, len(slots))] if len(slots) > lo else out


def unchanged(slots: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The stretches, as (first, last + 1), of windows in which every slot holds the item's own value."""
    same = np.concatenate([[0], [all(a == b for a, b in pairs) for pairs in slots], [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(same))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _counted(runs: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_words) of the runs that count, split where slots conflict."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_windows", "n_words")}
            for r in batch.to_pylist():
                windows = r["windows"]
                slots = [[(x["a"], x["b"]) for x in w["slots"]] for w in windows]
                parts, enough = consistent(slots), [s for s, w in zip(slots, windows, strict=True) if w["enough"]]
                # Windows with few plain words may break off without making the others' run doubtful.
                whole = consistent(enough) in ([], [(0, len(enough))])
                least = min(RUN, r["item_words"] - 1)
                parts = [(x, y) for x, y in parts if y - x + r["size"] - 1 >= (least if whole else BROKEN_RUN)]
                if not whole:
                    parts += [(x, y) for x, y in unchanged(slots) if y - x + r["size"] - 1 >= least]
                parts = [(x, y) for x, y in parts if any(w["strong"] for w in windows[x:y])]
                if parts:
                    held = set().union(*(range(x, y) for x, y in parts))
                    for k, y in (("doc_id", r["doc_id"]), ("item_id", r["item_id"]), ("n_windows", len(held)), ("n_words", max(y - x for x, y in parts) + r["size"] - 1)):
                        out[k].append(y)
            return out

        return run

    doc, item = (runs.schema[k].dataType.simpleString() for k in ("doc_id", "item_id"))
    return rows_in_arrow(runs.select("doc_id", "item_id", "item_words", "size", "windows"), make, f"doc_id {doc}, item_id {item}, n_windows long, n_words long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; all columns stay, and so do documents with a null id."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
