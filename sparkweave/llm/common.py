"""What the corpus operators share: the shared folder, written tables, Arrow row streams, folds."""

from __future__ import annotations

import bisect
import contextlib
import ctypes
import gc
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sparkweave.storage import dropped, scratch, shared_dir, written

__all__ = [
    "BitField", "bit_field", "dropped", "fold", "fold_col", "free_name", "give_back", "in_tasks", "kept", "membership", "overlaps", "parts", "quoted", "rows_in_arrow", "scratch", "seeming", "shared_dir",
    "slices", "texts", "with_column", "without", "written",
]

def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow with small batches, as texts are long, and with memory given back after each task.

    A session that has the default rows of a batch gets fewer, and keeps them: the plan reads the setting when it runs, which
    is after this call; with the default an executor of 3,000 MB runs out of memory in the pipeline."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":  # the default
        conf.set(_BATCH, "1000")
    name = f"{run.__module__}.{run.__qualname__}"
    # Names that Spark would take for paths are plain ones on the way through the tasks.
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {c.lower() for c in (*df.columns, *kind.names)}
    plain = {c: next(p for k in itertools.count(at) if (p := f"column_{k}") not in taken) for at, c in enumerate(dict.fromkeys([*df.columns, *kind.names])) if not re.fullmatch(r"\w+", c)}

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _of_worker(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    if not plain:
        return df.mapInArrow(tidy, kind)
    through = StructType([StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in kind])
    return df.toDF(*[plain.get(c, c) for c in df.columns]).mapInArrow(tidy, through).toDF(*kind.names)


_KEPT: dict[tuple[str, ...], object] = {}
_LAST = [""]


def _of_worker(name: str) -> None:
    """A worker that turns to another operator forgets what it kept for the last one."""
    if _LAST[0] != name:
        _LAST[0] = name
        _KEPT.clear()


def kept(key: tuple[str, ...], make: Callable[[], object]) -> object:
    """What a worker's tasks of one operator share."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Freed memory goes back to the system; workers live on and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def rows_in_arrow(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]], schema: StructType | str
) -> DataFrame:
    """Each Arrow batch through the function that make() returns once per task; dicts of columns become batches.

    A returned dict names the columns of schema; None drops the batch."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for piece in slices(batch):
                out = f(piece)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)
                if out is not None:
                    yield out

    run.__module__, run.__qualname__ = make.__module__, make.__qualname__
    return in_tasks(df, run, kind)


# ---- sets of ids, told by cascades of bit fields

#: Bits of a field for each id in it, and bits of a field at most: what holds more ids only takes more levels.
BITS_PER_ID, MOST_BITS, MOST_LEVELS = 16, 1 << 28, 24


def hashes_of(values: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each value, null ones included."""
    if pa.types.is_integer(values.type):
        h = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))
    return np.array([xxhash.xxh3_64_intdigest(str(x).encode("utf-8", "surrogatepass"), seed) for x in values.to_pylist()], np.uint64)


class BitField:
    """A set of ids, in which others may seem to be: two bits for each id."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        self.words, self.seed = words, seed

    def places(self, values: pa.Array) -> np.ndarray:
        h, n = hashes_of(values, self.seed), np.uint64(64 * len(self.words))
        return np.stack([h % n, (h >> np.uint64(32)) % n]).astype(np.int64)

    def seems(self, values: pa.Array) -> np.ndarray:
        at = self.places(values)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)


def bit_field(ids: DataFrame, seed: int = 0, most_bits: int | None = None) -> BitField:
    """The field of the ids in the first column of a written table; its size follows their number, up to most_bits (MOST_BITS)."""
    bits = 1 << min(max(10, (BITS_PER_ID * ids.count()).bit_length()), (most_bits or MOST_BITS).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = BitField(np.zeros(bits // 64, np.uint64), seed)
        for batch in batches:
            at = field.places(batch.column(0)).ravel()
            np.bitwise_or.at(field.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(field.words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(field.words[at].view(np.int64))], ["at", "bits"])

    got = in_tasks(ids.select(ids.columns[0]), run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return BitField(words, seed)


def seeming(fields: list[BitField], col: Column) -> Column:
    """How many of the fields, from the first, a value seems to be in before it misses one; null values are in none."""

    @F.arrow_udf("int")
    def depth(values: pa.Array) -> pa.Array:
        deep, on = np.zeros(len(values), np.int32), np.asarray(values.is_valid())
        for field in fields:
            on = on & field.seems(values)
            deep += on
        return pa.array(deep)

    return depth(col)


def membership(docs: DataFrame, some: DataFrame, most_bits: int | None = None) -> Column | None:
    """Whether a row's doc_id is among some (doc_id), exactly, as a column of docs; None where it can't be told so.

    A field of the ids, a field of the others that seem to be in it, a field of the ids that seem to be among
    these, and so on until nobody is misjudged: ids alone meet in joins, never the other columns. Ids of fields that
    stay too full for MOST_LEVELS levels can't be told this way."""
    inside = written(some.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids")
    outside = written(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(inside, "doc_id", "left_anti"), "ids")
    tables, fields = [inside, outside], []
    while not inside.isEmpty() and len(fields) < MOST_LEVELS:
        fields.append(bit_field(inside, len(fields), most_bits))
        wrong = written(outside.filter(seeming(fields[-1:], F.col("doc_id")) == 1), "ids")
        tables.append(wrong)
        inside, outside = wrong, inside
    told = inside.isEmpty()
    dropped(tables)
    return (seeming(fields, F.col("doc_id")) % 2 == 1 if fields else F.lit(False)) if told else None


def without(docs: DataFrame, gone: DataFrame, most_bits: int | None = None) -> DataFrame:
    """docs but for the rows with an id among gone (doc_id); texts don't move, and a null id stays."""
    held = membership(docs, gone, most_bits)
    if held is not None:
        return docs.filter(~held)
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch of text shares a place with one of the spans, by a search in their order."""
    ordered = sorted(spans)
    starts, ends = [s for s, _ in ordered], list(itertools.accumulate((e for _, e in ordered), max))
    return lambda start, end: bool(k := bisect.bisect_left(starts, end)) and ends[k - 1] > start


def quoted(name: str) -> str:
    """A column's name as it stands, dots and signs included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes, so that a few long texts don't fill a worker's memory."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most_bytes / max(1, batch.nbytes)))) if n else 1
    for at in range(0, n, step):
        yield batch.slice(at, step)


def fold(doc_id: object, mod: int) -> int:
    """crc32 of the id as text, modulo mod; -1 for a null id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def fold_col(col: str, mod: int) -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(-1))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values)
