"""N-gram Jaccard join with adaptive multi-match prefixes (operator 5).

A document's set holds its distinct word shingles. All sets are ordered by one global order, rarer shingles
first. Of a set of n shingles, any partner must share at least a = ceil(n * threshold); so for any L two partners
share L or more of the first n - a + L shingles. Each set chooses its own L: a longer prefix costs more index
entries, but asks for L matches before a pair is verified; the choice minimises the cost that shingle
frequencies predict. Two sets are candidates when their prefixes share the lesser of their two L.

The order's frequencies come from a sketch of fixed size that counts the shingles of all documents; it
steers cost only, never results. Where sizes are known, a pair must share still more entries: matches_needed.

Equal sets form one class and go on as one. Prefix entries move once, packed by ranges of shingles; the task of a range
drops the shingles that one class alone has. Entries of shingles that are known to be frequent are dealt by class instead,
so that no range holds more than a bounded part of them. No step forms all pairs of a group. Two rounds pair every class
with the one pivot that it shares most prefix entries with; what hangs together through these pairs is a
family, and its most central class the root. Every class is compared with its root: that gives links, and its
difference from the root. Two classes of a family differ at least by what each alone has beside the root, and
by as much as the numbers of root shingles that they lack differ; classes are grouped by these numbers, and
only groups whose bound allows a link, and that aren't one component yet, are opened into pairs. Between
families the prefix entries decide: families that share enough of them are opened into classes, these into
pairs that share enough. All pairs left are verified on whole sets, so no link between components is lost,
while a group of near copies costs what it has members.

Cases: texts without words, null ones included, have no shingles and link with nothing; a text with fewer
words than a shingle is one shingle; very long texts are taken whole; repeated rows are copies of one
another; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import bit_field, dropped, free_name, give_back, in_tasks, membership, quoted, rows_in_arrow, scratch, texts, without, written
from sparkweave.operators.components import connected_components

#: The threshold in hundredths: an overlap of at least PERCENT * union / 100.
PERCENT, SHINGLE = 90, 3
#: Counters of the frequency sketch.
SKETCH = 1 << 18
#: Entries of a range of shingles, and those that a task packs at once; a shingle that more documents hold is frequent.
RANGE, PACKED, FREQUENT = 100_000, 200_000, 50_000
LONGEST = 8
PIVOT_ROUNDS = 2
#: Counters of which root shingles a class lacks.
LACKS = 32
MOST_WORDS = 150_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > MOST_WORDS:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mix(h * _B + w[k : k + n] + _C)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def linked(common: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n + m - common)


def matches_needed(n, m, ell_n, ell_m, percent: int):
    """A lower bound, as a column, of the prefix entries that two linked sets of n and m shingles share.

    Two prefixes end at two places of the order; what the one that ends first shares with the other set lies
    in the other's prefix. It misses n less the least common shingles at most, so the rest is shared."""
    short = lambda size, ell: ell - F.ceil(size * percent / 100)
    common = F.ceil((n + m) * percent / (100 + percent))
    return F.greatest(F.least(ell_n, ell_m), F.least(short(n, ell_n), short(m, ell_m)) + common)


def prefix(shingles: np.ndarray, frequency: np.ndarray | None, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The set's prefix in the global order, and how many matches it asks for."""
    n = len(shingles)
    df = np.ones(n, np.int64) if frequency is None else frequency[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((shingles, df))
    base = n - least_overlap(n, percent)
    most = min(LONGEST, n - base)
    lengths = base + np.arange(1, most + 1)
    others = np.cumsum(df[order[: lengths[-1]]] - 1)[lengths - 1]
    # Entries to index, entries to merge with, and candidates, each of which took L of these, to verify.
    cost = 2.0 * lengths + others + others / np.arange(1, most + 1) * (4 + n / 50)
    best = int(cost.argmin())
    return shingles[order[: lengths[best]]], best + 1


# ---- passes over the texts

def frequencies(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Per counter of the sketch, how many documents hold a shingle that falls there beyond what chance puts there; 1 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for t in texts(batch):
                np.add.at(total, (shingle_set(t, known, size) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    got = in_tasks(docs.select("text"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SKETCH, np.int64)
    total[got["at"].to_numpy()] = got["n"].to_numpy()
    usual = float(np.median(total))
    above = total - usual - 4 * np.sqrt(usual)
    # Powers of two, so that noise doesn't disturb the order.
    return np.where(above > 1, 2 ** np.ceil(np.log2(np.maximum(above, 1))), 1).astype(np.int64)


def members_of(docs: DataFrame, frequency: np.ndarray, percent: int, size: int, seed: int) -> DataFrame:
    """(doc_id, n, v, chk, ell, prefix) of every row: v and chk tell equal sets. Of equal sets in a task one has the prefix, as 8 bytes a shingle."""

    def make():
        known, seen = WordHashes(), set()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), **{k: [] for k in ("n", "v", "chk", "ell", "prefix")}}
            for t in texts(batch):
                s = shingle_set(t, known, size)
                raw = s.tobytes()
                p, ell = prefix(s, frequency, percent) if len(s) else (s, 0)
                key = xxhash.xxh3_64_intdigest(raw, seed), xxhash.xxh64_intdigest(raw, seed + 1)
                out["n"].append(len(s))
                out["v"].append(key[0] - (1 << 63))
                out["chk"].append(key[1] - (1 << 63))
                out["ell"].append(ell)
                out["prefix"].append(p.tobytes() if len(p) and key not in seen else None)
                seen.add(key)
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n long, v long, chk long, ell int, prefix binary")


#: A packed entry, column by column: the shingle, the class, its size, low and high part, and its L.
_PACKED = (np.uint64, np.int64, np.uint16, np.uint16, np.uint8)


def shared_entries(members: DataFrame, frequency: np.ndarray, percent: int) -> DataFrame:
    """(v, n, ell, size, token): the prefix entries, once each, of shingles that several classes have in their prefixes."""
    held = members.filter("prefix IS NOT NULL")
    ranges = max(1, -(-(held.agg(F.sum(F.length("prefix"))).first()[0] or 0) // (8 * RANGE)))
    frequent = frequency >= FREQUENT

    def packed(entries: list[np.ndarray]) -> pa.RecordBatch:
        token, v, n, ell = (np.concatenate(x) for x in zip(*entries, strict=True))
        # The high half of a hash tells its range; the sketch uses the lowest bits.
        at = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        if frequent.any():
            often = frequent[(token & np.uint64(SKETCH - 1)).astype(np.int64)]
            at[often] = ranges + (v[often].view(np.uint64) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        columns = [x[order] for x in (token, v, (n & 0xFFFF).astype(np.uint16), (n >> 16).astype(np.uint16), ell)]
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() + [len(at)]
        data = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["at", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, waiting = [], 0
        for batch in batches:
            sizes, ells, vs = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n", "ell", "v"))
            for k, raw in enumerate(batch.column("prefix")):
                token = np.frombuffer(raw.as_buffer(), np.uint64)
                entries.append((token, np.full(len(token), vs[k], np.int64), np.full(len(token), sizes[k], np.uint32), np.full(len(token), ells[k], np.uint8)))
                waiting += len(token)
                if waiting >= PACKED:
                    yield packed(entries)
                    entries, waiting = [], 0
        if entries:
            yield packed(entries)

    def unpack(group: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in _PACKED]
        for raw in group.column("data"):
            buffer, at = raw.as_buffer(), 0
            count = len(buffer) // sum(np.dtype(k).itemsize for k in _PACKED)
            for own, kind in zip(parts, _PACKED, strict=True):
                own.append(np.frombuffer(buffer, kind, count, at))
                at += count * np.dtype(kind).itemsize
        token, v, low, high, ell = map(np.concatenate, parts)
        order = np.lexsort((v, token))
        token, v = token[order], v[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        first = new | np.concatenate([[True], v[1:] != v[:-1]])
        keep = first
        if group.column("at")[0].as_py() < ranges:
            shingle = np.cumsum(new) - 1
            keep = first & (np.bincount(shingle, first)[shingle] > 1)
        at = order[keep]
        n = low[at].astype(np.int64) + (high[at].astype(np.int64) << 16)
        need = -(-n * percent // 100)
        give_back()
        return pa.table([pa.array(v[keep]), pa.array(n), pa.array(ell[at].astype(np.int32)), pa.array((n - need + ell[at]).astype(np.int32)), pa.array(token[keep].view(np.int64))], ["v", "n", "ell", "size", "token"])

    return in_tasks(held.select("v", "n", "ell", "prefix"), pack, "at int, data binary").groupBy("at").applyInArrow(unpack, "v long, n long, ell int, size int, token long")


def sets_of(docs: DataFrame, need: DataFrame, size: int, seed: int) -> DataFrame:
    """(v, s): the whole sets of the classes of need (v, rep), from the rows that stand for them, once each, as a written table."""
    by_id, by_class = bit_field(need.select("rep")), bit_field(need.select("v"), 1)

    def make():
        known, seen = WordHashes(), set()

        def run(batch: pa.RecordBatch) -> dict:
            some = batch.filter(pa.array(by_id.seems(batch.column("doc_id"))))
            found = [shingle_set(t, known, size).tobytes() for t in texts(some)]
            v = pa.array([xxhash.xxh3_64_intdigest(s, seed) - (1 << 63) for s in found], pa.int64())
            at = np.flatnonzero(by_class.seems(v)).tolist() if len(v) else []
            keys = list(zip(v.to_pylist(), some.column("doc_id").to_pylist(), strict=True))
            at = [k for k in at if keys[k] not in seen and not seen.add(keys[k])]
            return {"v": v.take(pa.array(at, pa.int64())), "rep": some.column("doc_id").take(pa.array(at, pa.int64())), "s": [found[k] for k in at]}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = need.select("v", F.col("rep").alias("_rep"))
    found = rows_in_arrow(docs.select("doc_id", "text"), make, f"v long, rep {kind}, s binary").join(held, "v")
    sets = written(found.filter(F.col("rep").eqNullSafe(F.col("_rep"))).select("v", "s"), "sets")
    # Rows that repeat an id and its text may lie in several tasks.
    return sets if sets.count() == need.count() else written(sets.dropDuplicates(["v"]), "sets")


# ---- links

def _with_sets(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, seed: int) -> DataFrame:
    """pairs (a, b, ...), a written table, with both whole sets, sa and sb."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    sets = sets_of(docs, written(classes.join(need, "v", "left_semi").select("v", "rep"), "need"), size, seed)
    return pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")


def _common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, size: int, seed: int) -> DataFrame:
    """The pairs (a, b) of classes that link, tested on whole sets."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(linked(int(_common(p, q).sum()), len(p), len(q), percent))
            return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return run

    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    return written(rows_in_arrow(_with_sets(pairs, docs, classes, size, seed), make, "a long, b long").distinct(), "links")


def against_roots(families: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, size: int, seed: int) -> DataFrame:
    """(v, f, n, lacks, links, novel, spread) of every class of a family but the root: how many of the root's shingles it
    lacks, whether it links with the root, which shingles it has beside it, and how what it lacks spreads over LACKS counters."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("v", "f", "n", "lacks", "links", "novel", "spread")}
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                on = _common(p, q)
                k = int(on.sum())
                spread = np.bincount((q[~_common(q, p)] >> np.uint64(40)).astype(np.int64) % LACKS, minlength=LACKS)
                for key, value in (("v", a), ("f", b), ("n", len(p)), ("lacks", len(q) - k), ("links", linked(k, len(p), len(q), percent)), ("novel", p[~on].view(np.int64)), ("spread", spread)):
                    out[key].append(value)
            return out

        return run

    pairs = written(families.filter("v <> f").select(F.col("v").alias("a"), F.col("f").alias("b")), "pairs")
    return written(rows_in_arrow(_with_sets(pairs, docs, classes, size, seed), make, "v long, f long, n long, lacks long, links boolean, novel array<long>, spread array<int>"), "differences")


def families_of(entries: DataFrame, percent: int) -> DataFrame:
    """(v, f): each class that shares much with a pivot, and the root of its family."""
    near = None
    for turn in range(PIVOT_ROUNDS):
        found = pivot_pairs(entries, turn, percent)
        near = found if near is None else near.unionByName(found)
    hung = connected_components(near)
    hung = hung.unionByName(hung.select(F.col("c").alias("v"), "c")).distinct()
    central = entries.groupBy("v").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))
    named = written(hung.join(central, "v"), "hung")
    roots = named.groupBy("c").agg(F.max_by("v", F.struct("share", (-F.col("v")).alias("w"))).alias("f"))
    return written(named.join(roots, "c").select("v", "f"), "families")


def family_pairs(differences: DataFrame, classes: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs within families, but across components, that the bound on their difference allows."""
    most = lambda n, m: F.floor((n + m) * (100 - percent) / (100 + percent))
    alone = differences.select("v", "f", F.explode("novel").alias("token")).groupBy("f", "token").agg(F.count(F.lit(1)).alias("_k"), F.min("v").alias("v")).filter("_k = 1")
    alone = alone.groupBy("v").agg(F.count(F.lit(1)).alias("alone"))
    roots = differences.select(F.col("f").alias("v"), "f").distinct().join(classes.select("v", "n"), "v").select("v", "f", "n", F.lit(0).cast("long").alias("lacks"), F.array_repeat(F.lit(0), LACKS).alias("spread"))
    rows = differences.select("v", "f", "n", "lacks", "spread").unionByName(roots).join(alone, "v", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    # A partner has n * 100 / percent shingles at most.
    rows = rows.filter(F.col("alone") <= most(F.col("n"), F.floor(F.col("n") * 100 / percent)))
    rows = rows.join(components, "v", "left").withColumn("c", F.coalesce("c", "v"))
    home = rows.filter("v = f").select("f", F.col("c").alias("home"))
    rows = written(rows.join(home, "f"), "rows")
    kinds = rows.groupBy("f", "n", "alone", "lacks").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max((F.col("c") != F.col("home")).cast("int")).alias("out"))
    kinds = written(kinds, "kinds")
    side = lambda i: kinds.select("f", *[F.col(x).alias(f"{x}{i}") for x in ("n", "alone", "lacks", "lo", "hi", "out")])
    # What lies in the root's component is linked already: one side lies outside; where both do, each pair once.
    near = side(1).filter("out1 = 1").join(side(2), "f").filter(
        ((F.col("out2") == 0) | (F.struct("n1", "alone1", "lacks1") <= F.struct(F.col("n2").alias("n1"), F.col("alone2").alias("alone1"), F.col("lacks2").alias("lacks1"))))
        & ((F.col("lo1") < F.col("hi1")) | (F.col("lo2") < F.col("hi2")) | (F.col("lo1") != F.col("lo2")))
        & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
        & (F.col("alone1") + F.col("alone2") + F.abs(F.col("lacks1") - F.col("lacks2")) <= most(F.col("n1"), F.col("n2")))
    )
    near = written(near.select("f", *[f"{x}{i}" for i in (1, 2) for x in ("n", "alone", "lacks")]), "near")
    own = lambda i: rows.select("f", *[F.col(x).alias(f"{x}{i}") for x in ("v", "c", "n", "alone", "lacks", "spread")])
    # The same bound counter by counter.
    apart = F.aggregate(F.zip_with("spread1", "spread2", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    both = near.join(own(1), ["f", "n1", "alone1", "lacks1"]).join(own(2), ["f", "n2", "alone2", "lacks2"])
    both = both.filter((F.col("c1") != F.col("c2")) & (F.col("alone1") + F.col("alone2") + apart <= most(F.col("n1"), F.col("n2"))))
    return both.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))


def pivot_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each class with the pivot that it shares most prefix entries with, where these are many."""
    rank = F.xxhash64("v", F.lit(turn))
    pivots = entries.groupBy("token").agg(F.min(F.struct(rank.alias("r"), "v", "n")).alias("p")).select("token", F.col("p.v").alias("b"), F.col("p.n").alias("m"))
    shared = entries.join(pivots, "token").filter((F.col("v") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    counted = shared.groupBy(F.col("v").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"), F.first("size").alias("size")).filter("4 * k >= size")
    return counted.groupBy("a").agg(F.max(F.struct("k", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def open_pairs(entries: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(a, b): all candidate pairs of classes that lie in different families."""
    near = 100 * F.least("hi1", "hi2") >= percent * F.greatest("lo1", "lo2")
    own = written(entries.join(families.withColumnRenamed("f", "c"), "v", "left").withColumn("c", F.coalesce("c", "v")), "entries")
    by_c = own.groupBy("token", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("ell").alias("ell"))
    several = written(by_c.groupBy("token").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("token"), "several")
    met = written(by_c.join(several, "token", "left_semi"), "meetings")
    one = met.select("token", F.col("c").alias("c1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("ell").alias("ell1"))
    two = met.select("token", F.col("c").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("ell").alias("ell2"))
    met_at = one.join(two, "token").filter(F.col("c1") < F.col("c2")).filter(near)
    pairs = met_at.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("ell1", "ell2")).alias("ell"), F.min(F.col("lo1") + F.col("lo2")).alias("lo"), F.max(F.greatest("hi1", "hi2")).alias("hi"))
    bound = F.greatest("ell", F.col("ell") - F.ceil(F.col("hi") * percent / 100) + F.ceil(F.col("lo") * percent / (100 + percent)))
    pairs = written(pairs.filter(F.col("k") >= bound).select("c1", "c2"), "family-pairs")
    # Only the entries at which two such families meet are opened.
    met_at = met_at.select("token", "c1", "c2").join(pairs, ["c1", "c2"], "left_semi")
    cols = lambda i: own.select("token", F.col("c").alias(f"c{i}"), *[F.col(x).alias(f"{x}{i}") for x in ("v", "n", "ell")])
    both = met_at.join(cols(1), ["token", "c1"]).join(cols(2), ["token", "c2"]).filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    both = both.groupBy(F.col("v1").alias("a"), F.col("v2").alias("b")).agg(F.count(F.lit(1)).alias("k"), *[F.first(x).alias(x) for x in ("n1", "n2", "ell1", "ell2")])
    return both.filter(F.col("k") >= matches_needed(*[F.col(x) for x in ("n1", "n2", "ell1", "ell2")], percent)).select("a", "b")


def link_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, as a written table."""
    with scratch() as keep:
        return keep(_link_components(docs, percent, size)[0].drop("v"), "components")


def _link_components(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, component_id, v, and the seed of v."""
    frequency = frequencies(docs, size)
    seed = 0
    while True:
        members = written(members_of(docs, frequency, percent, size, seed), "members")
        classes = members.groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("chk").alias("_least"), F.max("chk").alias("_most"))
        classes = written(classes, "classes")
        if classes.filter("_least <> _most").isEmpty():
            break
        seed += 2  # two sets with one key: other keys
    entries = written(shared_entries(members, frequency, percent), "entries")
    # The prefixes aren't read again.
    slim = written(members.drop("prefix", "chk", "ell"), "members")
    dropped([members])
    families = families_of(entries, percent)
    differences = against_roots(families, docs, classes, percent, size, seed)
    links = differences.filter("links").select(F.col("v").alias("a"), F.col("f").alias("b"))
    within = family_pairs(differences, classes, links.select(F.col("a").alias("v"), F.col("b").alias("c")), percent)
    more = verified(within.unionByName(open_pairs(entries, families, percent)), docs, classes, percent, size, seed)
    components = connected_components(links.unionByName(more))
    named = classes.select("v", "rep").join(components, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "c").select("v", "component_id")
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), "v").join(final, "v")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "v"), seed


def class_key(size: int, seed: int) -> Column:
    """The key v of each row's class, as a column."""

    @F.arrow_udf("long")
    def keyed(text: pa.Array) -> pa.Array:
        known = WordHashes()
        return pa.array([xxhash.xxh3_64_intdigest(shingle_set(t or "", known, size).tobytes(), seed) - (1 << 63) for t in text.to_pylist()], pa.int64())

    return keyed(F.col("text"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs with one row, that of the least id, of each group of linked documents; all columns stay.

    Rows that repeat an id and a set of shingles are one document; texts that differ under one id are judged each for itself;
    rows without an id stay, and so do those without a shingle, once for each id."""
    with scratch() as keep:
        found, seed = _link_components(docs.select("doc_id", "text"), percent, size)
        found = keep(found, "components")
    again = written(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("doc_id"), "again")
    kept = without(docs, found.filter("component_id <> doc_id").select("doc_id").unionByName(again))
    if again.isEmpty():
        return kept
    key, held = free_name(docs, "_class"), membership(docs, again)
    some = (docs.filter(held) if held is not None else docs.join(again, "doc_id", "left_semi").select(*map(quoted, docs.columns))).withColumn(key, class_key(size, seed))
    own = found.join(again, "doc_id", "left_semi").filter("component_id = doc_id").select("doc_id", F.col("v").alias(key))
    once = some.join(own, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(*map(quoted, docs.columns))
    return kept.unionByName(once)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows by all pairs that share a shingle, for small tables.
OP5_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(reach.c) AS component_id FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY 1, 2"""
