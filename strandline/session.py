"""Session defaults and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, app: str = "strandline") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller's session is used as it is."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; in local mode, where that is unset (tests), a folder of our own.

    Executors of a cluster can't read each other's temporary folders, so that there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local") or named is None and sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-ckpt-"))
    return sc.getCheckpointDir()
