"""The registry, the flagship query and pluggable health checks."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from textgauge.operators import cache, health
from textgauge.plans import registry

DATA = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    found = registry.registered()
    assert set(found) <= set(entry_module.queries())
    assert set(found) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_registry_without_optional_folders(fresh):
    """A copy without the optional folders registers everything else, with and without the pipeline's file."""
    home = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(f"{home}/textgauge", f"{fresh}/textgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", fresh)
    count = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    for name in (None, "corpus_pipeline.py"):
        if name and os.path.exists(f"{home}/{name}"):
            shutil.copy(f"{home}/{name}", fresh)
        out = subprocess.run([sys.executable, "-c", count], cwd=fresh, capture_output=True, text=True, check=True,
                             env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.splitlines()
        assert set(out[0].split()) == set(registry.registered())
        assert set(out[1].split()) == {n for n, (_, sql) in registry.registered().items() if sql}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and {"lang", "problem_class", "n", "avg_text_len"} <= set(df.columns)


def test_health_checks(spark):
    df = spark.range(3)

    def broken(_):
        raise RuntimeError("no answer")

    rows = health.run_checks(df, {
        "size": lambda d: d.limit(1).selectExpr("'healthy' AS status", "'ok' AS message"),
        "model": broken})
    got = {r["component"]: r["status"] for r in rows.collect()}
    assert got == {"size": "healthy", "model": "critical"}
    assert health.worst_status(rows, []).first()["overall_status"] == "critical"


def test_cache_ages(spark):
    rows = [("h", "2024-01-01 00:00:00", 60, "a"), ("h", "2024-01-01 00:00:30", 30, "b"),
            ("g", "2024-01-01 00:00:31", 30, "c")]
    log = spark.createDataFrame(rows, "input_hash string, ts string, ttl_seconds int, cls string"
                                ).withColumn("ts", F.col("ts").cast("timestamp"))
    asked = spark.createDataFrame([("h",), ("g",), ("z",)], "input_hash string")
    now = "2024-01-01 00:01:00"
    got = {r["input_hash"]: r["cls"] for r in cache.lookup(asked, log, now).collect()}
    # The newest entry of h is exactly as old as its time to live: expired, and it hides the older.
    assert got == {"h": None, "g": "c", "z": None}
    stale = {r["input_hash"]: r["cls"] for r in cache.lookup(asked, log, now, allow_stale=True
                                                             ).collect()}
    assert stale == {"h": "b", "g": "c", "z": None}
    assert cache.purge(log, now).count() == 3 and cache.purge(log, now, 0).count() == 0
