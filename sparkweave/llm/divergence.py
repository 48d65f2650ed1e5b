"""Audit of how sources diverge within a language, ranked by radix selection (operator 11).

Terms are counted once by language, source and term, with the number of documents that hold them; a language keeps those
in enough of its documents. A group (language, source) gives every kept term a smoothed share in billionths; the distance
of two groups adds up over all kept terms, also those that neither holds.

Sparse pairs: a term that a group lacks has the group's base share. So the sum of two groups starts from the base of both
for all terms, gets a correction for each term of one group against the base of the other (by the histogram of the
group's counts, as equal counts have equal shares), and one more for the terms that both hold. Only the last needs the
terms' rows, which meet on (language, term): a term meets itself once per pair of sources that hold it, as often as there are
results to add it to.

Radix selection: the values' bits are counted in histograms from the highest digit down until they give each group's k-th
value; among rows with that value the bytes of the items' UTF-8 are counted the same way until few are left. A
histogram has one row per group and digit, added up where the rows are, so no group is gathered or sorted.
Full ranks come from the same histograms: the rows of higher digits are counted, only those that share a digit are sorted.

Arithmetic is exact in 64 bits, up to 9e15 occurrences of terms in a language; more would raise an error.

Cases: null text, lang and source count as ''; groups without terms, or of a language that keeps none, have pairs of value 0
(base shares alone otherwise) and no terms; repeated rows count each as a document; terms of any length are taken whole; a language
with one source has no pairs; an empty table gives no rows; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import in_tasks, scratch, slices, texts, written

#: Fixed value: terms are runs of ASCII letters and of all that isn't ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for the bytes of UTF-8: A to Z in lower case, what ends a term as a blank, and all else as it is.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms that a task counts before it hands them on.
MOST_HELD = 400_000
LEAST_DOCS, TOP = 10, 10
#: Values are below 2 to the power of BITS and are looked at DIGIT bits at a time.
BITS, DIGIT = 30, 10
#: Rows of equal values that a group may have to be sorted; more are told apart by counts of bytes.
FEW = 1000
GROUP = ["lang", "source"]


# ---- terms

def terms(text: str) -> list[bytes]:
    """The terms of a text in order, A to Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, of docs (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                if n:
                    of = list(n)
                    same = lambda x, k=len(of): pa.array([x], pa.string()).take(pa.array(np.zeros(k, np.int32)))
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(of, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([held[x] for x in of], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        size = 0
        for batch in batches:
            for piece in slices(batch):
                for text, *key in zip(texts(piece), texts(piece, "lang"), texts(piece, "source"), strict=True):
                    found = terms(text)
                    n, held = groups.setdefault(tuple(key), (Counter(), Counter()))
                    size -= len(n)
                    n.update(found)
                    held.update(set(found))
                    size += len(n)
                    if size > MOST_HELD:
                        yield from handed_on()
                        size = 0
        yield from handed_on()

    counted = in_tasks(docs.select("text", *GROUP), run, "lang string, source string, term string, n long, docs long")
    # Placed by language and term at once, where all that follows wants the rows; tasks have added up most of it.
    return counted.repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang) of the terms that a language keeps."""
    over = "OVER (PARTITION BY lang, term)"  # at most one row per source
    return counts.selectExpr("lang", "source", "term", "n", f"sum(n) {over} AS n_lang", f"sum(docs) {over} AS _docs").filter(F.col("_docs") >= least).drop("_docs")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """The smoothed share of n occurrences among total ones of so many kinds of terms, in billionths and 1 more.

    The nine digits come three at a time, so that nothing exceeds 64 bits."""
    whole, rest, out = (total + 2 * kinds).cast("long"), (n + 2).cast("long"), F.expr("1L")
    for scale in (10**6, 10**3, 1):
        out = out + _div(rest * 1000, whole) * scale
        rest = (rest * 1000) % whole
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, kinds, all, base, lang_base): every group's occurrences of kept terms, and its language's kinds and occurrences."""
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP]).distinct()
    total = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    of = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(total, GROUP, "left").join(of, "lang", "left").select(*GROUP, zero("total"), zero("kinds"), zero("all"))
    return out.withColumn("base", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))))


# ---- pairs

def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): how far each other source of the language is, over all kept terms."""
    g = groups.select("lang", "source", "total", "kinds", "base")
    other = g.select("lang", F.col("source").alias("item"), F.col("base").alias("base_b"))
    pairs = g.join(other, "lang").filter("source <> item").select(*GROUP, "item", F.coalesce(F.col("kinds") * apart(F.col("base"), F.col("base_b")), F.lit(0)).alias("value"))
    # Terms of a group against the base of each other group, by the counts that occur in it.
    hist = kept.groupBy(*GROUP, "n").agg(F.count(F.lit(1)).alias("times")).join(g, GROUP).select(*GROUP, "times", "base", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    one = hist.join(other, "lang").filter("source <> item")
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (apart(F.col("p"), F.col("base_b")) - apart(F.col("base"), F.col("base_b")))).alias("value"))
    # Terms of both groups, once for the pair.
    shares = kept.join(g, GROUP).select("lang", "term", "source", "base", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    met = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("base").alias("base_b"), F.col("p").alias("q")), ["lang", "term"]).filter("source < item")
    p, q, a, b = map(F.col, ("p", "q", "base", "base_b"))
    both = met.groupBy("lang", "source", "item").agg(F.sum(apart(p, q) - apart(p, b) - apart(a, q) + apart(a, b)).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = pairs.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


# ---- terms that set a group apart

def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the kept terms that a group holds more of than its language."""
    known = kept.join(groups.select(*GROUP, "total", "kinds", "all"), GROUP)
    rated = known.select(*GROUP, F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("n_lang"), F.col("all"), F.col("kinds")).alias("q"))
    return rated.filter("p > q").select(*GROUP, "item", apart(F.col("p"), F.col("q")).alias("value"))


# ---- radix selection

def _digit(value: Column, low: int) -> Column:
    """The bits of a value from `low` up, of which DIGIT are new at each step down."""
    return F.shiftright(value, low)


def _boundary(hist: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, at, want) from a histogram (keys, at, n, want): where the want-th row of each group is, and how many rows of it are wanted there."""
    run = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY at {order} ROWS UNBOUNDED PRECEDING)"
    return hist.withColumn("_upto", F.expr(f"sum(n) {run}")).filter("_upto >= want AND _upto - n < want").select(*keys, "at", (F.col("want") - (F.col("_upto") - F.col("n"))).alias("want"))


def thresholds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, at, want): each group's k-th highest value (the least where there are fewer rows), and how many rows of that value the first k take."""
    bound = None
    for low in range(BITS - DIGIT, -1, -DIGIT):
        here = rows.select(*keys, _digit(F.col("value"), low).alias("at"))
        if bound is None:
            hist = here.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
            hist = hist.withColumn("_all", F.expr(f"sum(n) OVER (PARTITION BY {', '.join(keys)})")).withColumn("want", F.least("_all", F.lit(k))).drop("_all")
        else:
            above = bound.select(*keys, F.col("at").alias("_up"), "want")
            hist = here.join(above, keys).filter(F.shiftright("at", DIGIT) == F.col("_up")).groupBy(*keys, "at", "want").agg(F.count(F.lit(1)).alias("n"))
        bound = _boundary(hist, keys, "DESC")
    return bound


def _bytes(item: Column, place: int) -> Column:
    """The two bytes of an item from a place on, from 1, as one number; a place behind its end comes before every byte."""
    at = lambda k: F.coalesce(F.conv(F.hex(F.substring(item.cast("binary"), k, 1)), 16, 10).cast("int"), F.lit(-1)) + 1
    return at(place) * 257 + at(place + 1)


def first_of_ties(tied: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """(keys, item, value): of the rows tied (keys, item, value, want) the first want items of each group by their UTF-8 bytes.

    Bytes are counted in histograms until a group has few rows left, which are sorted."""
    taken, place, by = [], 1, ", ".join(keys)
    while True:
        tied = written(tied, "ties")
        crowded = tied.groupBy(*keys).agg((F.count(F.lit(1)) > F.greatest(F.max("want"), F.lit(few))).alias("_crowded"))
        told = tied.join(crowded, keys)
        rest = told.filter("NOT _crowded").withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY item)"))
        taken.append(rest.filter("_r <= want").select(*keys, "item", "value"))
        mine = told.filter("_crowded").select(*tied.columns, _bytes(F.col("item"), place).alias("at"))
        if mine.isEmpty():
            return functools.reduce(DataFrame.unionByName, taken)
        bound = _boundary(mine.groupBy(*keys, "at", "want").agg(F.count(F.lit(1)).alias("n")), keys, "ASC")
        placed = written(mine.join(bound.select(*keys, F.col("at").alias("_up"), F.col("want").alias("_rest")), keys), "ties")
        taken.append(placed.filter("at < _up").select(*keys, "item", "value"))
        tied = placed.filter("at = _up").select(*keys, "item", "value", F.col("_rest").alias("want"))
        place += 2


def top_k(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, item, value) with rank: each group's k highest values, ties by the items' UTF-8 bytes; at most FEW or k rows a group are sorted."""
    rows = written(rows, "values")
    bound = thresholds(rows, keys, k).select(*keys, F.col("at").alias("_least"), "want")
    near = written(rows.join(bound, keys).filter("value >= _least"), "near")
    tied = first_of_ties(near.filter("value = _least").select(*keys, "item", "value", "want"), keys)
    chosen = near.filter("value > _least").select(*keys, "item", "value").unionByName(tied)
    return chosen.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY value DESC, item)"))


def full_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, item, value) with rank: rows of higher digits are counted, rows that share a leading digit are sorted."""
    rows = written(rows, "values")
    low = BITS - DIGIT
    tops = rows.groupBy(*keys).agg(F.max("value").alias("_most"))
    # The digit begins at the group's own highest bit, so that values far below 2 ** BITS spread as well.
    scaled = rows.join(tops, keys).withColumn("at", F.expr(f"shiftright(value, greatest(0, cast(length(bin(_most)) AS int) - {BITS - low}))")).drop("_most")
    hist = scaled.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
    higher = hist.select(*keys, "at", F.expr(f"sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY at DESC ROWS UNBOUNDED PRECEDING) - n").alias("_higher"))
    within = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)}, at ORDER BY value DESC, item)")
    return scaled.join(higher, [*keys, "at"]).withColumn("rank", (F.col("_higher") + within).cast("int")).drop("at", "_higher")


def audit_sources(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a language's sources are from one another, and the terms that set each apart."""
    docs = docs.select("text", *GROUP)
    with scratch() as keep:
        kept = written(kept_counts(term_counts(docs), least), "kept")
        groups = written(groups_of(docs, kept), "groups")
        pairs = full_ranks(pair_values(kept, groups), GROUP).withColumn("part", F.lit("pair"))
        best = top_k(term_values(kept, groups), GROUP, top).withColumn("part", F.lit("term"))
        return keep(pairs.unionByName(best).select(*GROUP, "part", "item", "value", "rank"), "divergence")


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS kinds, sum(n) AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
s AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n,
  (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.kinds))::BIGINT AS p, (1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.kinds))::BIGINT AS q
  FROM gn JOIN v ON v.lang = gn.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
