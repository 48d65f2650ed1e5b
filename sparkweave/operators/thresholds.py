"""Quantile-by-rank thresholds of probabilities, and the three classes that they make.

A mergeable sketch of both sides of one half gives, in the job that counts them, a bracket around each threshold; a second
job counts the values within the brackets, and the rows beyond, which gives the exact ones. Where a bracket holds many
values, bounded histograms cut it further: value ranges are counted, the one with the rank is cut again,
and only when few distinct values are left do these come to the driver. No global sort is needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the probabilities from 0.5 up, and below, that count as sure.
SHARES = {"pc": (0.1, 0.5), "pf": (0.2, 0.5)}
BUCKETS, FEW = 4096, 10_000
#: Accuracy of the sketch: ranks are off by a share of one over it at most.
SKETCH = 10_000
PLASMID, CHROMOSOME, UNCLASSIFIED = "plasmid", "chromosome", "unclassified"


def kth_value(rows: DataFrame, col: str, k: int, lo: float, hi: float, descending: bool) -> float:
    """The k-th value, from 1, of a column with values from lo to hi."""
    while True:
        if not lo < hi:
            return lo
        width = (hi - lo) / BUCKETS
        at = F.least(F.greatest(F.floor((F.col(col) - lo) / width), F.lit(0)), F.lit(BUCKETS - 1))
        here = rows.filter((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(col).alias("kinds"), F.min(col).alias("lo"), F.max(col).alias("hi"))
        for r in sorted(here.collect(), key=lambda r: r["at"], reverse=descending):
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["kinds"] <= FEW:
            values = rows.filter((F.col(col) >= r["lo"]) & (F.col(col) <= r["hi"])).groupBy(col).agg(F.count(F.lit(1)).alias("n")).collect()
            for v in sorted(values, key=lambda v: v[col], reverse=descending):
                if k <= v["n"]:
                    return v[col]
                k -= v["n"]
        lo, hi = r["lo"], r["hi"]


def probability_thresholds(probs: DataFrame, classifier: str = "pc") -> tuple[float, float]:
    """(plasmid, chromosome) thresholds of probs (prob)."""
    if classifier not in SHARES:
        raise ValueError(f"the classifier is one of {', '.join(SHARES)}")
    p = F.col("prob")
    sides = {"high": (p >= 0.5, SHARES[classifier][0], True), "low": (p < 0.5, SHARES[classifier][1], False)}
    cols = []
    for name, (on, share, descending) in sides.items():
        at = 1 - share if descending else share
        near = F.array(*[F.lit(min(1.0, max(0.0, at + x))) for x in (-2 / SKETCH, 2 / SKETCH)])
        cols += [F.count_if(on).alias(f"{name}_all"), F.bround(F.count_if(on) * share, 0).cast("long").alias(f"{name}_k"), F.percentile_approx(F.when(on, p), near, SKETCH).alias(f"{name}_near"), F.min(F.when(on, p)).alias(f"{name}_min"), F.max(F.when(on, p)).alias(f"{name}_max")]
    known = probs.filter(p.isNotNull()).select("prob")
    got = known.agg(*cols).first()
    if not got["high_k"] or not got["low_k"]:
        raise ValueError("too few probabilities on one side of 0.5 for thresholds")
    values = {name: [] for name in sides}
    if all(got[f"{name}_all"] * 8 / SKETCH <= FEW for name in sides):
        # Rows in a bracket by value, rows beyond it by a value of their own.
        beyond = lambda name: F.when(p < got[f"{name}_near"][0], -math.inf).when(p > got[f"{name}_near"][1], math.inf)
        within = F.when(p >= 0.5, beyond("high")).otherwise(beyond("low"))
        for r in known.groupBy((p >= 0.5).alias("high"), F.coalesce(within, p).alias("value")).agg(F.count(F.lit(1)).alias("n")).collect():
            values["high" if r["high"] else "low"].append((r["value"], r["n"]))
    out = []
    for name, (on, _, descending) in sides.items():
        k = got[f"{name}_k"]
        for value, n in sorted(values[name], reverse=descending):
            if k <= n:
                break
            k -= n
        else:
            value = None
        # Beyond the bracket, or with too many values in it: by histograms.
        out.append(value if value is not None and math.isfinite(value) else kth_value(known.filter(on), "prob", got[f"{name}_k"], got[f"{name}_min"], got[f"{name}_max"], descending))
    return tuple(out)


def assigned_class(prob: Column, plasmid: float, chromosome: float) -> Column:
    """Above the plasmid threshold; up to the chromosome threshold; neither, or no probability."""
    return F.when(prob > plasmid, PLASMID).when(prob <= chromosome, CHROMOSOME).otherwise(UNCLASSIFIED)
