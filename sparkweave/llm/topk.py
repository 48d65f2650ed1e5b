"""Exact top-k search by a bit-sliced index (operator 6).

Rows are dealt into blocks of bounded size. Each block keeps its attributes as bit slices: attribute values,
quantised by QUANTUM, are written in binary, and slice b of an attribute is the bitmap of the rows that have
bit b set. A query's score is a sum of slices shifted by the set bits of its weights; a carry-save tree of
bitmap adders sums them without touching single rows. The top rows are then selected from the most
significant slice of the sum downward. Quantising moves a score by a known interval at most, so rows whose
score may lie on the right side of the boundary are found by one more comparison over the slices and
resolved exactly.

Query blocks meet row blocks in a grid, so that nothing that grows with the input is broadcast; every
pair of blocks sends on k rows per query at most, which are merged per query.

Cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors count as
padded by zeros; quantised components and scores beyond the range of a long count as its end; ties go to the smaller id; rows that repeat an id and vector count once; a
query's own id never is a result of it; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, SCALE, QUERY_EVERY = 5, 256, 50
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 1_024
#: Attribute values are floor-divided by 2 to this power before they are sliced.
QUANTUM_BITS = 2
MOST_SCORE = (1 << 63) - 1


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """Components times scale, rounded down, as longs; null where a component is null or not finite, or the vector is."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class BitSlices:
    """Bit slices of a block's attributes: slices[attribute, bit] is a bitmap over rows."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.rows, self.width = values.shape
        low = values >> QUANTUM_BITS
        self.base = low.min(axis=0) if self.rows else np.zeros(self.width, np.int64)
        low = low - self.base
        self.bits = max(1, int(low.max(initial=0)).bit_length())
        self.words = -(-self.rows // 64)
        packed = np.zeros((self.width, self.bits, self.words * 8), np.uint8)
        for b in range(self.bits):
            on = np.packbits(((low >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            packed[:, b, : on.shape[1]] = on
        self.slices = packed.view(np.uint64)
        self.all = np.zeros(self.words * 8, np.uint8)
        ones = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        self.all[: len(ones)] = ones
        self.all = self.all.view(np.uint64)

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of attributes times weights, all non-negative."""
        columns: list[list[np.ndarray]] = []
        for j in range(int(weights.max(initial=0)).bit_length()):
            on = np.flatnonzero((weights >> j) & 1)
            for b in range(self.bits):
                while len(columns) <= j + b:
                    columns.append([])
                if len(on):
                    columns[j + b].append(self.slices[on, b])
        out, k = [], 0
        while k < len(columns):
            stack = np.concatenate(columns[k]) if columns[k] else np.zeros((0, self.words), np.uint64)
            while len(stack) > 1:
                if k + 1 == len(columns):
                    columns.append([])
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    ab = a ^ b
                    columns[k + 1].append((a & b) | (ab & c))
                    stack = np.concatenate([ab ^ c, stack[3 * third :]])
                else:
                    a, b = stack[:1], stack[1:2]
                    columns[k + 1].append(a & b)
                    stack = a ^ b
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            k += 1
        return out

    def kth_largest(self, total: list[np.ndarray], k: int, among: np.ndarray) -> int:
        """The k-th largest value of the sum among some rows, selected from the most significant slice downward."""
        above, equal, value = 0, among, 0
        for b in range(len(total) - 1, -1, -1):
            here = equal & total[b]
            n = int(np.bitwise_count(here).sum())
            if above + n >= k:
                equal, value = here, value | (1 << b)
            else:
                above += n
                equal = equal & ~total[b]
        return value

    def at_least(self, total: list[np.ndarray], value: int, among: np.ndarray) -> np.ndarray:
        """Bitmap of the rows whose sum is at least value."""
        if value <= 0:
            return among
        if value >> len(total):
            return np.zeros(self.words, np.uint64)
        more, equal = np.zeros(self.words, np.uint64), among
        for b in range(len(total) - 1, -1, -1):
            if value >> b & 1:
                equal = equal & total[b]
            else:
                more |= equal & total[b]
                equal = equal & ~total[b]
        return more | equal

    def top(self, query: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """Places of all rows, among others, that may be in the exact top k; ties at the boundary included."""
        n = int(np.bitwise_count(others).sum())
        if n <= k:
            return self.places(others)
        # The score is the sum over positive weights less that over negative ones. Instead of subtracting,
        # the attributes under negative weights are complemented: (2^bits - 1 - u) has the slices inverted.
        slices, keep = self.slices, query < 0
        if keep.any():
            self.slices = slices.copy()
            self.slices[keep] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
        try:
            total = self.weighted_sum(np.abs(query))
        finally:
            self.slices = slices
        # What quantising left out of each attribute is from 0 to 2^QUANTUM_BITS - 1, times its weight.
        span = int(np.abs(query).sum()) * ((1 << QUANTUM_BITS) - 1)
        least = self.kth_largest(total, k, others)
        return self.places(self.at_least(total, least - -(-span >> QUANTUM_BITS) - 1, others))

    def places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def block_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of a block, exact: query_id, vec_id, score."""
    width = max([1, *map(len, queries["v"]), *map(len, rows["v"])])
    q, x = _matrix(queries["v"], width), _matrix(rows["v"], width)
    # Exact as long as scores stay below 2^62; larger ones take Python's integers.
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width >= 2.0**52:
        index, exact = None, (q.astype(object), x.astype(object))
    else:
        index, exact = BitSlices(x), (q, x)
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids, queries["query_id"], "left", order), np.searchsorted(ids, queries["query_id"], "right", order)
    got: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for i, query in enumerate(queries["query_id"]):
        own = order[low[i] : high[i]]
        if index is None:
            at = np.setdiff1d(np.arange(len(ids)), own)
        else:
            others = index.all
            if len(own):
                mask = np.zeros(index.words * 64, np.uint8)
                mask[own] = 1
                others = others & ~np.packbits(mask, bitorder="little").view(np.uint64)
            at = index.top(q[i], k, others)
        score = exact[1][at] @ exact[0][i]
        if index is None:
            score = np.clip(score, -MOST_SCORE, MOST_SCORE)
        best = sorted(zip((-score).tolist(), ids[at].tolist(), strict=True))[:k] if len(at) <= 64 else [(int(-score[j]), int(ids[at[j]])) for j in np.lexsort((ids[at], -score))[:k]]
        got["query_id"] += [query] * len(best)
        got["vec_id"] += [v for _, v in best]
        got["score"] += [-s for s, _ in best]
    return pd.DataFrame(got)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. rows: (vec_id, v array<long>); queries: (query_id, v)."""
    rows, queries = rows.distinct(), queries.distinct()
    n, m = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS_PER_BLOCK)), max(1, -(-m // QUERIES_PER_BLOCK))
    # By id and vector together: neither a common vector nor a common id fills a block, and repeated rows are one.
    a = rows.withColumn("_r", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    b = queries.withColumn("_q", F.pmod(F.xxhash64("query_id", "v"), F.lit(query_blocks)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        return block_top(own, others, k)

    best = b.groupBy("_q", "_r").cogroup(a.groupBy("_q", "_r")).applyInPandas(meet, "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select("vec_id", quantised(F.col("embedding")).alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    return top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id"))


OP6_SQL = f"""
WITH q AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
