"""Small keyed state between micro-batches, as tables.

The batch operators spread a busy key over many tasks; per-key state functions would put it back
into one. So stateful jobs run the batch operator on each micro-batch in foreachBatch and carry a
small table (one or a few rows per key) from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..session import scratch


class StateTable:
    """A table with the state after each micro-batch, in two alternating places.

    Batch n reads what batch n - 1 wrote and overwrites the other place, so a batch that is run
    again after a failure sees the same state and writes the same result.
    """

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/{(batch - 1) % 2}")

    def after(self, df: DataFrame, batch: int) -> None:
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        df.select(*names).write.mode("overwrite").parquet(f"{self.path}/{batch % 2}")


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One folder per micro-batch: running a batch again replaces its rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_each(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
             trigger: dict | None = None) -> StreamingQuery:
    """Run step(micro-batch, batch id) on all available data (or by the given trigger)."""
    return stream.writeStream.foreachBatch(step).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def places(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """Fresh (checkpoint, state, output) paths in the shared folder."""
    base = scratch(spark, name)
    return f"{base}/checkpoint", f"{base}/state", f"{base}/out"
