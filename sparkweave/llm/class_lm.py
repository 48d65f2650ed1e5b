"""LM scoring by Brown class-based n-grams (operator 9).

Passes over the texts: (1) counts of all training words; (2) counts of class bigrams, with the CLUSTERED most
frequent words kept apart; exchange clustering then moves each of these words to the class that raises the
likelihood of the class bigrams most, until a sweep changes nothing; (3) for every other word, which classes it
follows and precedes, and how often. These words begin in the class of their shape, and one exchange step for all of them
at once moves each to the class that raises the likelihood most, against the same class counts. So every training word has a
class by exchange. (4) Texts become sequences of classes, a byte a word, from which transitions are counted and the
texts are scored: log10 P(class | class before) + log10 P(word | class), both smoothed, over a text's words and its end.
Words that never occurred in training have the class of their shape.

A batch's texts are split and their words numbered by Arrow; only its distinct words are hashed and looked up.

Counts cover all training documents. Those of the HEAD most frequent words, a bounded table, travel with the
tasks; rarer words leave the scan as (place, hash) and meet the full table of counts and classes in a hash join. No rare
word is frequent, by construction, so that join has no hot key.

Cases: a null or empty text is its end alone; very long texts are handled whole; repeated rows are scored
each for itself and all teach; without training documents all counts are 0; a word whose best classes tie stays where it
is, or goes to the first; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import dropped, fold_col, in_tasks, rows_in_arrow, scratch, slices, written

CLUSTERED, CLASSES, HEAD = 1000, 64, 150_000
SHAPES = 8
#: Pseudo-counts that draw class transitions towards the classes' own shares.
DRAW = 20.0
#: Counts of batches gathered before they are added up and passed on.
MOST_COUNTS = 1_000_000
#: Neighbours of words gathered before they are counted, rows of words added up at once, words judged at once, and counts whose gains are kept.
MOST_NEIGHBOURS, MERGED, JUDGED, FEW = 2_000_000, 20_000, 256, 16
#: A text's end; no word holds a space.
END = b" end"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


END_HASH = word_hash(END)


def words_of(text: str) -> list[bytes]:
    """ASCII capitals made small, then what stands between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    """The class that a word begins in, and where words never met stay: long or short, with or without a sign at its end, ASCII letters only or not."""
    return (len(word) > 8) + 2 * (not word[-1:].isalpha() and word[-1] < 128) + 4 * (not word.isascii())


@dataclass
class Words:
    """The words of a batch's texts: hash and shape of each distinct one, and each text's words by their places among these."""

    h: np.ndarray
    shapes: np.ndarray
    at: np.ndarray
    lengths: np.ndarray  # of the texts, in words

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Words:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text").cast(pa.string()).fill_null("")))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        sizes = pc.binary_length(kinds).to_numpy(zero_copy_only=False)
        if (sizes == 0).any():  # white space at the ends of a text leaves an empty word
            empty = sizes[at] == 0
            lengths = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty], minlength=len(lengths))
            at = at[~empty]
            at -= at > np.flatnonzero(sizes == 0)[0]
            kinds = kinds.filter(pa.array(sizes > 0))
        # Cut out of one buffer, as a list made by Arrow takes ten times as long.
        ends = np.frombuffer(kinds.buffers()[1], np.int32)[kinds.offset : kinds.offset + len(kinds) + 1] if len(kinds) else np.zeros(1, np.int32)
        data, cuts = kinds.buffers()[2].to_pybytes() if len(kinds) else b"", ends.tolist()
        h = [xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) for a, b in itertools.pairwise(cuts)]
        return cls(np.array(h, np.int64), shapes_of(data, ends.astype(np.int64)), at, lengths)

    def laid(self, of: np.ndarray, end: int) -> np.ndarray:
        """What `of` has for each word, with an end before the first text and after each one."""
        return laid(of[self.at], self.lengths, end)


def laid(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    out = np.full(len(values) + len(lengths) + 1, end, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = values
    return out


def shapes_of(words: bytes, cuts: np.ndarray) -> np.ndarray:
    """shape() of each of the words, one after another, that lie between the cuts."""
    starts, sizes = cuts[:-1], np.diff(cuts)
    if not len(sizes):
        return sizes
    data = np.frombuffer(words, np.uint8)[: cuts[-1]]
    last = data[cuts[1:] - 1]
    letter = ((last | 32) >= 97) & ((last | 32) <= 122)
    beyond = np.add.reduceat(data > 127, starts, dtype=np.int64) > 0
    return (sizes > 8) + 2 * (~letter & (last < 128)) + 4 * beyond


def found_in(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each h is among the sorted hashes, and its place there, or some place."""
    if not len(hashes):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    k = np.minimum(hashes.searchsorted(h), len(hashes) - 1)
    return hashes[k] == h, k


# ---- counting

def training_counts(docs: DataFrame) -> DataFrame:
    """(h, shape, n) of every word of docs, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [(np.zeros(0, np.int64),) * 3], 0

        def out() -> pa.RecordBatch:
            h, shapes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            del held[1:]
            kinds, first, at = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(shapes[first].astype(np.int32)), pa.array(np.bincount(at, n, len(kinds)).astype(np.int64))], ["h", "shape", "n"])

        for batch in batches:
            for piece in slices(batch):
                w = Words.of(piece)
                if piece.num_rows:
                    held.append((np.append(w.h, END_HASH), np.append(w.shapes, SHAPES), np.append(np.bincount(w.at, minlength=len(w.h)), len(w.lengths))))
                    waiting += len(w.h) + 1
                if waiting > MOST_COUNTS:
                    yield out()
                    waiting = 0
        yield out()

    return in_tasks(docs.select("text"), run, "h long, shape int, n long").groupBy("h", "shape").agg(F.sum("n").alias("n"))


def class_bigrams(docs: DataFrame, top: dict[int, int]) -> DataFrame:
    """(a, b, n): neighbours among the places of top (hash to place), then shapes, then the end, which also begins a text."""
    shapes_at, end = len(top), len(top) + SHAPES
    wide = end + 1

    hashes = np.array(sorted(top), np.int64)
    places = np.array([top[h] for h in sorted(top)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for piece in slices(batch):
                w = Words.of(piece)
                known, k = found_in(hashes, w.h)
                of = shapes_at + w.shapes
                of[known] = places[k[known]]
                ids = w.laid(of, end)
                total += np.bincount(ids[:-1] * wide + ids[1:], minlength=wide * wide)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // wide).astype(np.int32)), pa.array((at % wide).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    return in_tasks(docs.select("text"), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# ---- clustering

def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """Classes of the places of a bigram matrix; the first `words` places move between `classes` classes, the others keep one each.

    Sweeps go on until one changes nothing, or to the given number. Each move raises the likelihood by more than rounding, so they end."""
    n = len(bigrams)
    classes = max(1, min(classes, words)) if words else 0
    of = np.concatenate([np.arange(words) % max(classes, 1), classes + np.arange(n - words)]).astype(np.int64)
    k = classes + n - words
    held = np.zeros((n, k))
    held[np.arange(n), of] = 1
    right, left = bigrams @ held, bigrams.T @ held  # place x class: followed by, preceded by
    grid = held.T @ right
    moving = np.arange(classes)
    least = 1e-12 * float(_xlog(bigrams.sum()))
    after, before = bigrams.sum(1), bigrams.sum(0)
    rows, cols = np.bincount(of, after, k), np.bincount(of, before, k)
    for _ in itertools.count() if sweeps is None else range(sweeps):
        moved = 0
        for w in range(words):
            g, r, l, own = of[w], right[w], left[w], bigrams[w, w]
            # Without w.
            r0, l0 = r.copy(), l.copy()
            r0[g] -= own
            l0[g] -= own
            grid[g] -= r0
            grid[:, g] -= l0
            grid[g, g] -= own
            rows[g] -= after[w]
            cols[g] -= before[w]
            # What each class would gain: its row and column, and where these cross.
            row = _xlog(grid[moving] + r0).sum(1) - _xlog(grid[moving]).sum(1)
            col = _xlog(grid[:, moving] + l0[:, None]).sum(0) - _xlog(grid[:, moving]).sum(0)
            diag = grid[moving, moving]
            cross = _xlog(diag + r0[moving] + l0[moving] + own) - _xlog(diag + r0[moving]) - _xlog(diag + l0[moving]) + _xlog(diag)
            size = _xlog(rows[moving] + after[w]) - _xlog(rows[moving]) + _xlog(cols[moving] + before[w]) - _xlog(cols[moving])
            gain = row + col + cross - size
            to = int(gain.argmax())
            to = to if gain[to] > gain[g] + least else int(g)
            grid[to] += r0
            grid[:, to] += l0
            grid[to, to] += own
            rows[to] += after[w]
            cols[to] += before[w]
            if to != g:
                moved += 1
                of[w] = to
                right[:, g] -= bigrams[:, w]
                right[:, to] += bigrams[:, w]
                left[:, g] -= bigrams[w]
                left[:, to] += bigrams[w]
        if not moved:
            break
    return of


def neighbours(docs: DataFrame, top: ClassModel) -> DataFrame:
    """(h, shape, codes, ns) of every word of docs outside the head of top: how often it precedes class c (code c) and follows it (code k + c).

    codes and ns are packed, as bytes and eight bytes each; a word has a row from each task that met it, or some."""
    k = top.end + 1
    if 2 * k > 256:
        raise ValueError("codes of classes take a byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds, waiting, size = [], [], 0, 0

        def out() -> pa.RecordBatch:
            h, first, own = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for x, _ in kinds)]), return_index=True, return_inverse=True)
            shapes = np.concatenate([np.zeros(0, np.int64), *(x for _, x in kinds)])[first]
            keys = np.concatenate([np.zeros(0, np.int64), *held])
            keys, n = np.unique((own[keys >> 8] << 8) + (keys & 255), return_counts=True)
            held.clear()
            kinds.clear()
            ids, codes = keys >> 8, (keys & 255).astype(np.uint8)
            at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            ends, own = np.append(at[1:], len(ids)), ids[at]
            packed = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, ends[-1:]) * x.itemsize).astype(np.int32).tobytes() or bytes(4)), pa.py_buffer(x.tobytes())]) for x in (codes, n.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(shapes[own].astype(np.int32)), *packed], ["h", "shape", "codes", "ns"])

        for batch in batches:
            for piece in slices(batch):
                if waiting > MOST_NEIGHBOURS:
                    yield out()
                    waiting = size = 0
                w = Words.of(piece)
                head, cls, _ = top.known(w)
                rare = np.flatnonzero(~head)
                place = np.zeros(len(w.h), np.int64)
                place[rare] = np.arange(size, size + len(rare))
                kinds.append((w.h[rare], w.shapes[rare]))
                size += len(rare)
                ids = w.laid(cls, top.end)
                on = np.flatnonzero(w.laid(~head, 0))
                own = place[w.at[~head[w.at]]] << 8
                held += [own + ids[on + 1], own + (ids[on - 1] + k)]
                waiting += 2 * len(own)
        yield out()

    return in_tasks(docs.select("text"), run, "h long, shape int, codes binary, ns binary")


def cells_of(grid: np.ndarray) -> np.ndarray:
    """Code x class: what a word adds to if it is in the class; the end, the last one, takes no words."""
    return np.concatenate([grid[:-1].T, grid[:, :-1]])


def gains_of_few(cells: np.ndarray) -> np.ndarray:
    """What 1 to FEW neighbours more add to the likelihood, by code and class."""
    return np.stack([_xlog(cells + n) - _xlog(cells) for n in range(1, FEW + 1)])


def best_classes(grid: np.ndarray, shapes_at: int, shapes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, ns: np.ndarray, few: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of words after one exchange step against the class bigrams of grid, from their shape's class and their neighbours'.

    lengths says how many of codes and ns belong to each word."""
    k, m = len(grid), shapes_at + SHAPES
    cells = cells_of(grid)
    size, logs = grid[:m].sum(1), _xlog(cells)
    starts, word = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(lengths)), lengths)
    n = np.add.reduceat(np.where(codes < k, ns, 0), starts)
    own, each = shapes_at + shapes, np.arange(len(lengths))
    # Most words are met a few times only: what that adds is the same for all of them.
    few = gains_of_few(cells) if few is None else few
    gain = few[np.minimum(ns, FEW) - 1, codes]
    more = np.flatnonzero(ns > FEW)
    gain[more] = _xlog(cells[codes[more]] + ns[more, None]) - logs[codes[more]]
    # The word's own class holds it already: what it loses without it.
    at, mine = np.arange(len(codes)), own[word]
    gain[at, mine] = logs[codes, mine] - _xlog(cells[codes, mine] - ns)
    total = np.add.reduceat(gain, starts, axis=0) - 2 * (_xlog(size + n[:, None]) - _xlog(size))
    total[each, own] = np.add.reduceat(gain[at, mine], starts) - 2 * (_xlog(size[own]) - _xlog(size[own] - n))
    to = total.argmax(1)
    better = total[each, to] > total[each, own] + 1e-9 * np.maximum(1, np.abs(total[each, own]))
    return n, np.where(better, to, own)


def merged(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """h, shapes, lengths, codes, ns of the words of rows of neighbours() in the order of h, each word once."""
    h, shapes = batch.column("h").to_numpy(), batch.column("shape").to_numpy()
    lengths = pc.binary_length(batch.column("codes")).to_numpy()
    codes, ns = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("codes", np.uint8), ("ns", np.int64)))
    new = np.concatenate([[True], h[1:] != h[:-1]])
    keys, at = np.unique((np.repeat(np.cumsum(new) - 1, lengths) << 8) + codes, return_inverse=True)
    return h[new], shapes[new].astype(np.int64), np.bincount(keys >> 8, minlength=int(new.sum())), keys & 255, np.bincount(at, ns).astype(np.int64)


def in_larger_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in larger ones, as each costs much beside its rows."""
    held, n, size = [], 0, 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if held and (batch is None or n >= MERGED or size > 4 << 20):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0


def classes_by_exchange(words: DataFrame, grid: np.ndarray, shapes_at: int) -> DataFrame:
    """(h, n, cls) of the words of neighbours().

    A word's rows lie side by side in one partition and are added up as they pass, so that no group is ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(h, shapes, lengths, codes, ns) -> Iterator[pa.RecordBatch]:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for x in range(0, len(h), JUDGED):
                y = min(x + JUDGED, len(h))
                own = slice(ends[x], ends[y])
                n, cls = best_classes(grid, shapes_at, shapes[x:y], lengths[x:y], codes[own], ns[own], few)
                yield pa.RecordBatch.from_arrays([pa.array(h[x:y]), pa.array(n), pa.array(cls.astype(np.int32))], ["h", "n", "cls"])

        few = gains_of_few(cells_of(grid))
        last = None  # the word that may go on in the next rows, as a row
        for batch in in_larger_ones(batches):
            if last is not None:
                batch = pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
            h, shapes, lengths, codes, ns = merged(batch)
            cut = len(codes) - lengths[-1]
            row = [pa.array(h[-1:]), pa.array(shapes[-1:].astype(np.int32)), pa.array([codes[cut:].astype(np.uint8).tobytes()]), pa.array([ns[cut:].astype(np.int64).tobytes()])]
            last = pa.RecordBatch.from_arrays(row, ["h", "shape", "codes", "ns"])
            yield from judged(h[:-1], shapes[:-1], lengths[:-1], codes[:cut], ns[:cut])
        if last is not None:
            yield from judged(*merged(last))

    return in_tasks(words.repartition("h").sortWithinPartitions("h"), run, "h long, n long, cls int")


@dataclass
class ClassModel:
    hashes: np.ndarray  # of the head, sorted
    counts: np.ndarray
    classes: np.ndarray
    step: np.ndarray  # log10 of the transitions, class x class
    base: float  # log10 of the unigram denominator
    within: np.ndarray  # log10 of each class's emission denominator
    tokens: int
    ends: int  # how often the end occurred
    shapes_at: int

    @property
    def end(self) -> int:
        return self.shapes_at + SHAPES

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word whether it belongs to the head, its class there or else by its shape, and log10(count + 1), 0 beyond the head."""
        head, k = found_in(self.hashes, w.h)
        cls, logs = self.shapes_at + w.shapes, np.zeros(len(w.h))
        cls[head], logs[head] = self.classes[k[head]], np.log10(self.counts[k[head]] + 1)
        return head, cls, logs


def fit_classes(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of all rows of docs without its transitions, and the written table (h, n, cls) of all their words and the end."""
    counts = written(training_counts(docs), "words")
    top = counts.filter(F.col("shape") < SHAPES).orderBy(F.desc("n"), "h").limit(CLUSTERED).toArrow().to_pandas()
    top = top.sort_values(["n", "h"], ascending=[False, True], kind="stable")
    places = {int(h): k for k, h in enumerate(top["h"])}
    wide = len(places) + SHAPES + 1
    bigrams = np.zeros((wide, wide))
    got = class_bigrams(docs, places).toArrow().to_pandas()
    bigrams[got["a"], got["b"]] = got["n"]
    of = exchange(bigrams, len(places))
    shapes_at = int(of[len(places)])
    k = shapes_at + SHAPES + 1
    held = np.zeros((wide, k))
    held[np.arange(wide), of] = 1
    grid = held.T @ bigrams @ held

    def model(head, classes, base=0.0, within=np.zeros(k), tokens=0, ends=0) -> ClassModel:
        h = head["h"].to_numpy(np.int64)
        order = np.argsort(h)
        return ClassModel(h[order], head["n"].to_numpy(np.int64)[order], np.asarray(classes, np.int64)[order], np.zeros((k, k)), base, within, tokens, ends, shapes_at)

    first = model(top, of[: len(places)])
    ends = counts.filter(F.col("shape") == SHAPES).select("h", "n", F.lit(shapes_at + SHAPES).alias("cls"))
    common = docs.sparkSession.createDataFrame([(int(h), int(n), int(c)) for h, n, c in zip(top["h"], top["n"], of[: len(places)], strict=True)], "h long, n long, cls int")
    rarer = classes_by_exchange(neighbours(docs, first), grid, shapes_at)
    words = written(common.unionByName(ends).unionByName(rarer), "classes")
    dropped([counts])
    by_class = {r["cls"]: (r["v"], r["n"]) for r in words.groupBy("cls").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()}
    size, kinds = np.zeros(k), np.zeros(k)
    for c, (v, n) in by_class.items():
        if c < shapes_at + SHAPES:
            size[c], kinds[c] = n, v
    head = words.filter(F.col("cls") < shapes_at + SHAPES).orderBy(F.desc("n"), "h").limit(HEAD).toArrow().to_pandas()
    tokens, kinds_all = sum(n for _, n in by_class.values()), sum(v for v, _ in by_class.values())
    # One place more in each class is for words that never occurred; the end is alone in its class.
    return model(head, head["cls"], float(np.log10(tokens + kinds_all + 1)), np.log10(size + kinds + 1), tokens, by_class.get(shapes_at + SHAPES, (0, 0))[1]), words


def with_transitions(model: ClassModel, coded: DataFrame) -> ClassModel:
    """The model with the smoothed transitions between the classes of all rows of coded."""
    k = model.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for piece in slices(batch):
                cls, _ = sequences(piece, model.end)
                total += np.bincount(cls[:-1] * k + cls[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"])

    got = in_tasks(coded.select("seq", "found"), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    grid = np.zeros((k, k))
    grid[got["a"], got["b"]] = got["n"]
    share = (grid.sum(0) + 1) / (grid.sum() + k)
    return replace(model, step=np.log10((grid + DRAW * share) / (grid.sum(1, keepdims=True) + DRAW)))


def fit_class_lm(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of all rows of docs, and the written table (h, n, cls) of all their words' counts and classes."""
    model, words = fit_classes(docs)
    return with_transitions(model, class_sequences(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), model, words)), words


# ---- scoring

def class_sequences(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """Per row of docs, as a written table: its columns but the text, n_tokens, n_known, logs (of the counts), seq (a class a byte),
    and found, the classes (at, cls) of words beyond the head, which seq has in the class of their shape."""
    others = [c for c in docs.columns if c != "text"]

    def make():
        row = 0
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def run(batch: pa.RecordBatch) -> dict:
            nonlocal row
            w = Words.of(batch)
            head, cls, logs = model.known(w)
            n, starts = len(w.lengths), np.concatenate([[0], np.cumsum(w.lengths)])
            doc = np.repeat(np.arange(n), w.lengths)
            rare = np.flatnonzero(~head[w.at])
            rares = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))]).astype(np.int32))
            seq = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(cls[w.at].astype(np.uint8).tobytes())])
            own = {
                "_row": np.arange(part + row, part + row + n), "n_tokens": w.lengths + 1, "n_head": np.bincount(doc, head[w.at], n).astype(np.int64) + (model.ends > 0), "head_logs": np.bincount(doc, logs[w.at], n),
                "seq": seq, "at": pa.ListArray.from_arrays(rares, pa.array((rare - starts[doc[rare]]).astype(np.int32))), "h": pa.ListArray.from_arrays(rares, pa.array(w.h[w.at[rare]])),
            }
            row += n
            return {**{c: batch.column(c) for c in others}, **own}

        return run

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    scanned = written(rows_in_arrow(docs.select(*others, "text"), make, f"{kinds}, _row long, n_tokens long, n_head long, head_logs double, seq binary, at array<int>, h array<long>"), "scanned")
    rare = scanned.select("_row", F.explode(F.arrays_zip("at", "h")).alias("w")).select("_row", "w.at", "w.h")
    found = rare.join(words, "h").groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.log10(F.col("n") + 1)).alias("_logs"), F.collect_list(F.struct("at", "cls")).alias("found"))
    out = scanned.drop("at", "h").join(found, "_row", "left")
    coded = written(out.select(*others, "n_tokens", (F.col("n_head") + F.coalesce("_n", F.lit(0))).alias("n_known"), (F.col("head_logs") + F.coalesce("_logs", F.lit(0.0))).alias("logs"), "seq", "found"), "coded")
    dropped([scanned])
    return coded


def sequences(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all rows of class_sequences(), with an end before the first and after each, and the place of the end before each row."""
    seq, found = batch.column("seq"), batch.column("found")
    lengths = pc.binary_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    cls = np.frombuffer(b"".join(seq.to_pylist()), np.uint8).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    words, rows = found.flatten(), pc.list_parent_indices(found).to_numpy(zero_copy_only=False)
    cls[starts[rows] + words.field("at").to_numpy(zero_copy_only=False)] = words.field("cls").to_numpy(zero_copy_only=False)
    return laid(cls, lengths, end), starts + np.arange(len(lengths))


def scores(coded: DataFrame, model: ClassModel) -> DataFrame:
    """Per row of class_sequences(): doc_id, n_tokens, n_known, base_score, score."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    within = np.where(np.arange(model.end + 1) == model.end, 0.0, model.within)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            # The end has its class for itself: once there, it is certain.
            cls, starts = sequences(batch, model.end)
            own = np.add.reduceat(model.step[cls[:-1], cls[1:]] - within[cls[1:]], starts) if len(starts) else np.zeros(0)
            return {**{c: batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")}, "steps": own}

        return run

    out = rows_in_arrow(coded.select("doc_id", "n_tokens", "n_known", "logs", "seq", "found"), make, f"doc_id {kind}, n_tokens long, n_known long, logs double, steps double")
    base = F.col("logs") + F.lit(float(np.log10(model.ends + 1))) - F.col("n_tokens") * F.lit(model.base)
    return out.select("doc_id", "n_tokens", "n_known", base.alias("base_score"), (F.col("steps") + F.col("logs")).alias("score"))


def score_documents(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, base_score, score."""
    return scores(class_sequences(docs.select("doc_id", "text"), model, words), model)


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learns = fold_col("doc_id", 7) != 2
    with scratch() as keep:
        model, words = fit_classes(docs.filter(learns))
        coded = class_sequences(docs, model, words)
        model = with_transitions(model, coded.filter(learns))
        out = keep(scores(coded, model), "scores")
    return out.select("doc_id", (fold_col("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
