"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_base: str | None = None
_shipped: dict[str, bool] = {}


def build_session(app: str = "anamnesis", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python workers need not have it installed."""
    context = spark.sparkContext
    if _shipped.get(context.applicationId):
        return
    _shipped[context.applicationId] = True
    here = os.path.dirname(os.path.abspath(__file__))
    held = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(held, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(held)


def shared_base(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a private temporary one where none is set."""
    global _local_base
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, visible to all executors."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_base(spark)}/checkpoints")
