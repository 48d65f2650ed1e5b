"""Correction by topology: unlabelled vertices take the label that the labelled ones they reach vote for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import distances as d

VOTES = 5


def reachable(vertices: DataFrame, state: DataFrame, least: int = 1000) -> DataFrame:
    """(vid, nbr, label, dist) for unlabelled vertices and the labelled ones that they reach.

    vertices: (vid, length, coverage, profile, label). Distances are rounded to nine digits, so that equal ones tie."""
    v = vertices.filter("label = 'unclassified'").select("vid", F.col("length").alias("v_length"), F.col("coverage").alias("v_cov"), F.col("profile").alias("v_profile"))
    n = vertices.filter("label <> 'unclassified'").select(F.col("vid").alias("nbr"), "label", "length", "coverage", "profile")
    met = state.filter("p > 0").select("vid", F.col("cls").alias("nbr"), (1 / F.col("p")).alias("topo")).join(v, "vid").join(n, "nbr")
    comp = F.when((F.col("v_length") >= least) & (F.col("length") >= least), d.composition(d.euclid(F.col("profile"), F.col("v_profile"))))
    return met.select("vid", "nbr", "label", F.round(d.total(F.col("topo"), comp, d.coverage(F.col("coverage"), F.col("v_cov"))), 9).alias("dist"))


def vote(near: DataFrame, votes: int = VOTES) -> DataFrame:
    """(vid, label): the one label that is reached, or the majority of the nearest; a tie is unclassified."""
    first = near.withColumn("_r", F.expr("row_number() OVER (PARTITION BY vid ORDER BY dist, nbr)"))
    agg = first.groupBy("vid").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.count_if((F.col("_r") <= votes) & (F.col("label") == "plasmid")).alias("p"), F.count_if((F.col("_r") <= votes) & (F.col("label") != "plasmid")).alias("c"),
    )
    most = F.when(F.col("p") > F.col("c"), "plasmid").when(F.col("c") > F.col("p"), "chromosome").otherwise("unclassified")
    return agg.select("vid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(most).alias("label"))


def corrected(vertices: DataFrame, votes: DataFrame) -> DataFrame:
    """vertices with label replaced where there is a vote."""
    new = votes.select("vid", F.col("label").alias("_new"))
    return vertices.join(new, "vid", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")
