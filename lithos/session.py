"""Session helpers.

Cluster settings (shuffle partitions, checkpoint folder, memory) belong to whoever
starts the session; these helpers only fill in what is unset, which is what tests need.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lithos", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench; never used on a cluster."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("LITHOS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The folder the cluster names in ``spark.checkpoint.dir`` wins. Only a local-mode
    session without one gets a fresh scratch folder; a cluster without one is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir()
        master = sc.master
    else:
        if configured:
            return configured
        master = spark.conf.get("spark.master", "")
    if master.startswith("local"):
        folder = _LOCAL_SCRATCH.get(id(spark)) or tempfile.mkdtemp(prefix="lithos-ckpt-", dir="/tmp")
        _LOCAL_SCRATCH[id(spark)] = folder
        if sc is not None:
            sc.setCheckpointDir(folder)
            return sc.getCheckpointDir()
        return folder
    raise RuntimeError("spark.checkpoint.dir is not set; lithos needs a shared checkpoint folder on a cluster")


_LOCAL_SCRATCH: dict[int, str] = {}
