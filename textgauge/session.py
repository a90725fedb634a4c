"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL: dict[str, str] = {}


def build_session(app: str = "textgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; a cluster's own settings win unless given here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = _LOCAL.setdefault("dir", "") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
        _LOCAL["dir"] = named
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably in the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """df, computed once, and marked for broadcast if it has at most max_rows rows.

    For per-class, per-model or per-circuit tables whose join key is a busy one: broadcasting keeps
    the large side where it is. A larger table is joined like any other.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_FREEING = {"users": 0, "before": None}
_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Jobs run here remove their shuffle files when they end: for results that are collected, written or checkpointed, once.

    The setting is read when a DataFrame is made, so the last one of the job has to be made here too.
    Several threads may be here at a time: the last one out restores the setting.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _LOCK:
        if not _FREEING["users"]:
            _FREEING["before"] = spark.conf.get(name, None)
            spark.conf.set(name, "true")
        _FREEING["users"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _FREEING["users"] -= 1
            if not _FREEING["users"]:
                before = _FREEING["before"]
                spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
