"""Where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL = "obspark.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session of local threads takes a temporary folder of
    its own; on a cluster that would be another one on each machine, so it is
    an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not place:
        place = spark.conf.get(LOCAL, None) or f"file://{tempfile.mkdtemp(prefix='obspark-')}"
        spark.conf.set(LOCAL, place)
    return place.rstrip("/")
