"""Session and shared-scratch helpers. Nothing here runs at import time."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: str | None = None


def get_session(app: str = "loomtable", master: str | None = None, **conf: str) -> SparkSession:
    """Return the running session, or start one with adaptive execution on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Methods above 8000 bytes are never compiled by the JVM, only interpreted; wide
        # text-cleaning projections then run faster as separate smaller methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else one of a local session only."""
    global _LOCAL_SCRATCH
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = os.path.join(tempfile.gettempdir(), f"loomtable-{uuid.uuid4().hex}")
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name below :func:`shared_root`."""
    return f"{shared_root(spark)}/loomtable-{label}-{uuid.uuid4().hex}"
