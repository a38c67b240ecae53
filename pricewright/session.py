"""Session defaults shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, set as the checkpoint folder of the session too.

    Only a master in this very process may go without: it gets a temporary folder. Elsewhere other machines could not read
    what one of them writes there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        return current.get()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pricewright-")
    if not current.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def build_session(app: str = "pricewright", master: str | None = None, **extra: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; extra settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("PRICEWRIGHT_DRIVER_MEMORY", "8g"),
    }
    for key, value in (settings | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
