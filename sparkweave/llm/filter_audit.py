"""Audit of how filters interact, by lattice-edge aggregation (operator 12).

Five filters can be applied in 120 orders, but what a step does depends only on which filters went before it. So
documents are counted once on the 80 edges (set of filters already applied, next filter) of the lattice of subsets,
and each order is a path of five edges through it: its steps are joined with the edges that they walk. Nothing is
computed per order from documents.

A document reaches the lattice as a mask of the filters that it fails. Rows are first added up by part, mask and labels,
which leaves 128 rows a part at most, and only these are spread over the edges.

Whether a text repeats one of a smaller doc_id (filter E) is told by the SHA-256 of the text and its smallest doc_id; the
rows then meet on (hash, doc_id), which no large group of copies makes uneven, and texts themselves never move.

Cases: a null text counts as empty, a null lang as the part ''; a row without a doc_id is no copy of another one and has
no labels, but its text may not be the first of any; rows that repeat a doc_id are judged each for itself, and equal ones of
the smallest doc_id are all first; a label holds if any row of `labels` with that doc_id says so; very long texts are
taken whole; an empty table has no parts and gives no rows; other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import scratch, written

LETTERS = "ABCDE"
#: What separates words, as the characters themselves and as a pattern.
BLANKS, BLANK_RUN = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}


def words(text: Column) -> Column:
    """The maximal runs of other characters than blanks, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, hash): the filters A to D that each row of docs (doc_id, text, lang) fails, as bits."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words(text).alias("words"))
    n, kinds = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    fails = {"A": n < LEAST_WORDS, "B": 100 * kinds < LEAST_DISTINCT * n, "C": 100 * capitals > MOST_CAPITALS * F.length("text").cast("long"), "D": F.col("text").rlike("[#$%&*|]")}
    mask = sum((F.when(c, F.lit(BIT[k])).otherwise(0) for k, c in fails.items()), F.lit(0))
    return cut.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, mask, hash) with the bit of E where a smaller doc_id has the same hash."""
    first = rows.filter("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("hash", "doc_id", F.lit(True).alias("_first"))
    known = rows.filter("doc_id IS NOT NULL").join(first, ["hash", "doc_id"], "left")
    return known.select("doc_id", "part", (F.col("mask") + F.when(F.col("_first"), 0).otherwise(BIT["E"])).alias("mask")).unionByName(rows.filter("doc_id IS NULL").select("doc_id", "part", "mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, as labels (doc_id, quality, toxic) have it."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    mine = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return mine.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def lattice_edges(kinds: DataFrame) -> DataFrame:
    """(part, before, letter, ...counts) of the 80 edges of each part, from kinds (part, mask, good, toxic, n).

    before holds the bits of the filters already applied."""
    spread = kinds.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("before")).select("*", F.explode(F.array(*map(F.lit, LETTERS))).alias("letter"))
    bit = F.element_at(F.create_map(*[F.lit(x) for pair in BIT.items() for x in pair]), F.col("letter"))
    spread = spread.withColumn("bit", bit).filter(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return spread.groupBy("part", "before", "letter").agg(
        count(alive & ~fails, "kept"), count(alive & fails, "removed"), count(~alive & fails, "redundant"), count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(alive & fails & F.col("good"), "good_lost"), count(alive & fails & F.col("toxic"), "toxic_lost"),
    )


def paths(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, letter): the 600 steps of all orders."""
    rows = [(order, k + 1, sum(BIT[x] for x in order[:k]), order[k]) for order in map("".join, permutations(LETTERS)) for k in range(len(LETTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, letter string")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step and the filter's shapley sum."""
    spark = docs.sparkSession
    with scratch() as keep:
        rows = written(failed(docs), "failed")
        kinds = with_labels(with_repeats(rows), labels).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
        edges = keep(lattice_edges(kinds), "lattice")
    steps = edges.join(F.broadcast(paths(spark)), ["before", "letter"])  # 600 rows
    # Each order meets a filter once, so the orders' sum is that over all steps with its letter.
    return steps.withColumn("shapley", F.expr("sum(removed) OVER (PARTITION BY part, letter)")).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit_filters(docs, labels)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(again, false) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
k AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, good, toxic, fails, n,
  coalesce(list_min(list_filter(list_transform(string_split(fails, ''), lambda c: CASE WHEN c <> '' THEN strpos(filter_order, c) END), lambda p: p IS NOT NULL)), 9) AS dies
  FROM k, o),
t AS (SELECT part, filter_order, i::INT AS step, substring(filter_order, i, 1) AS letter,
  sum(CASE WHEN dies > i THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN dies = i THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN dies < i AND contains(fails, substring(filter_order, i, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = substring(filter_order, i, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN dies = i AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN dies = i AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM s, range(1, 6) r(i) GROUP BY part, filter_order, i)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
"""
