"""Confusion matrix and scores of predicted labels against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = ("cc", "cp", "cu", "pc", "pp", "pu")


def confusion(rows: DataFrame) -> DataFrame:
    """One row: counts by true (chromosome, else plasmid) and predicted label (chromosome, plasmid, else unclassified).

    rows: (truth, predicted); rows with unclassified truth don't count."""
    t, p = F.lower("truth"), F.lower("predicted")
    kept = rows.select(t.alias("t"), p.alias("p")).filter("t <> 'unclassified'")
    true = {"c": F.col("t") == "chromosome", "p": F.col("t") != "chromosome"}
    said = {"c": F.col("p") == "chromosome", "p": F.col("p") == "plasmid", "u": ~F.col("p").isin("chromosome", "plasmid")}
    return kept.agg(*[F.count_if(true[x[0]] & said[x[1]]).alias(x) for x in CELLS])


def scores(matrix: DataFrame) -> DataFrame:
    """Per-class and macro scores, in hundredths.

    Macro precision is over classified rows; macro recall is over all rows and counts the label unclassified
    as one more, with recall 0, once a row is predicted so. A score without meaning is null."""
    c = {x: F.col(x).cast("double") for x in CELLS}
    one = F.lit(1.0)
    share = lambda a, b: a / F.greatest(b, one)
    prec_c, prec_p = share(c["cc"], c["cc"] + c["pc"]), share(c["pp"], c["pp"] + c["cp"])
    rec_c, rec_p = share(c["cc"], c["cc"] + c["cp"] + c["cu"]), share(c["pp"], c["pc"] + c["pp"] + c["pu"])
    seen = lambda *x: F.when(sum((c[k] for k in x), F.lit(0.0)) > 0, 1).otherwise(0)
    named = seen("cc", "cp", "pc") + seen("pp", "pc", "cp")
    kinds = seen("cc", "cp", "cu", "pc") + seen("pp", "pc", "pu", "cp") + seen("cu", "pu")
    precision, recall = F.try_divide(prec_c + prec_p, named), F.try_divide(rec_c + rec_p, kinds)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    cols = {"chromosome_precision": prec_c, "chromosome_recall": rec_c, "plasmid_precision": prec_p, "plasmid_recall": rec_p, "macro_precision": precision, "macro_recall": recall, "f1": f1}
    return matrix.select(*[F.round(100 * x, 2).alias(k) for k, x in cols.items()])


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) with all three labels."""
    all_three = rows.sparkSession.range(1).select(F.explode(F.array(F.lit("plasmid"), F.lit("chromosome"), F.lit("unclassified"))).alias("label"))
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return all_three.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def report(matrix: dict, score: dict) -> str:
    """The text form of one row of each."""
    lines = ["true \\ predicted  chromosome  plasmid  unclassified"]
    for name, x in (("chromosome", "c"), ("plasmid", "p")):
        lines.append(f"{name:<17} {matrix[x + 'c']:>10}  {matrix[x + 'p']:>7}  {matrix[x + 'u']:>12}")
    return "\n".join(lines + [f"{k.replace('_', ' ')}: {'-' if v is None else f'{v:.2f}'}" for k, v in score.items()])
