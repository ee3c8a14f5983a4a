"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces small shuffle
# partitions at run time; skew-join splitting is the safety net for hot keys that
# survive the partial aggregations the operators already do.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "sublens",
                  extra: dict | None = None) -> SparkSession:
    """A session with SESSION_CONF.  Master and number of shuffle partitions are set only when
    given, so a submitted job keeps the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}  # application id -> folder, of local sessions without a setting


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be a
    folder of one machine, so it is an error there.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_SCRATCH.get(context.applicationId)
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="sublens-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{os.urandom(6).hex()}")
    return path
