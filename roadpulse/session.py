"""Session construction and shared-folder handling.

On a cluster the session is built by the caller; the library only reads its
settings.  ``build_session`` exists for tests, benchmarks and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) size under which AQE turns a shuffle join into a
    # broadcast join; lookups are joined without static hints so this
    # measured size is the check.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "roadpulse") -> SparkSession:
    """Local/test session with the settings the operators assume."""
    cpus = os.cpu_count() or 8
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  Only a local-mode session without one (tests) gets a
    fresh scratch folder; a cluster session without a shared folder is an
    error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    scratch = tempfile.mkdtemp(prefix="roadpulse-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"
