"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library needs for correct results (UTC wall clock for the
# timestamp_ntz arithmetic) and for sane plans (AQE re-plans joins, coalesces
# small shuffle partitions and splits skewed join partitions at run time).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # of a key that a JSON object repeats, the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the JVM doesn't compile methods of more than 8,000 bytes: stages with one run as smaller ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "callroute", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; that setting is always used
    when present. Where it is unset, a local session gets a scratch folder and a
    cluster session is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="callroute-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    if "://" in base:
        import uuid

        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base)


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the
    shared checkpoint folder (never a local one). The frame is persisted first
    so the checkpoint job writes the computed rows instead of recomputing
    them; the cache is released once the files are written. The result keeps
    the partitioning of ``df``.
    """
    checkpoint_dir(df.sparkSession)
    df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out
