"""SparkSession helpers.

The library never creates a cluster-specific configuration on its own: it reads
whatever the session already has (``spark.checkpoint.dir`` in particular) and
only fills in defaults where a setting is unset, as happens in local tests.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. Applied only when a session is built here;
# an existing cluster session keeps its own values.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "creditlake",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:
        pass
    return spark


def app_key(spark: SparkSession) -> tuple:
    """Identity of the running application and session (for per-session reuse)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect sessions expose no SparkContext
        app = spark.conf.get("spark.app.id", "")
    return (app, id(spark))


def _set_context_checkpoint_dir(spark: SparkSession, path: str) -> None:
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # Spark Connect: the session conf is the only handle
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent on a local master (tests) is a scratch folder
    created and registered; on a cluster no other node would see it, so an unset
    folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        _set_context_checkpoint_dir(spark, configured)
        return configured
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="creditlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    _set_context_checkpoint_dir(spark, local)
    return local


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)
