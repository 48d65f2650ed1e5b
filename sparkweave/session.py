"""Sessions with the settings that the library wants, and the library's place for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[*]", name: str = "sparkweave", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf has further settings, dots as double underscores."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the library from where the driver has it, as on a shared or local disk.

    Elsewhere it is installed on the executors or sent by --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark
