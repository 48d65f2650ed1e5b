"""Writers of results, and tables for plots."""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The colours of the classes.
COLOURS = {"plasmid": "green", "chromosome": "orange", "unclassified": "white"}


def log_to(folder: str, path: str) -> None:
    """The library's log: from INFO on the console, from DEBUG in a file of the driver; folder is made where it is missing."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger("sparkweave")
    log.setLevel(logging.DEBUG)
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    for handler, level in ((logging.StreamHandler(sys.stderr), logging.INFO), (logging.FileHandler(path), logging.DEBUG)):
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s - %(message)s"))
        log.addHandler(handler)


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the graph's vertices, edges, labels, and vertices with and without a label (label 0, or unclassified)."""
    label = F.col("label").cast("string")
    known = ~label.isin("0", "unclassified")
    of = vertices.agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct(F.when(known, label)).alias("labels"), F.count_if(known).alias("labelled"), F.count_if(~known).alias("unlabelled"))
    return of.join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


def described(edges: DataFrame, vertices: DataFrame) -> str:
    return ", ".join(f"{k} {v}" for k, v in counts(vertices, edges).first().asDict().items())


def write_labels(vertices: DataFrame, path: str, one_file: bool = False) -> None:
    """Tab-separated contig and label of all vertices in order of their ids, over as many files as the order's ranges take.

    With one_file the parts are then joined, byte by byte and in their order, to path.txt by the driver's file system."""
    vertices.orderBy("vid").select("contig_id", "label").write.option("sep", "\t").csv(path)
    if one_file:
        jvm, conf = vertices.sparkSession._jvm, vertices.sparkSession._jsc.hadoopConfiguration()
        folder, whole = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".txt")
        store = folder.getFileSystem(conf)
        out = store.create(whole, True)
        for name in sorted(s.getPath().toString() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")):
            part = store.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()


def plot_nodes(vertices: DataFrame) -> DataFrame:
    colour = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in COLOURS.items()])
    return vertices.select("vid", "label", colour.alias("colour"))


def plot_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src < dst").select("src", "dst")
