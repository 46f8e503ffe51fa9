"""Snapshot sink of a stream (S7) and reading its snapshots back.

A micro-batch is written to ``dest/batch=<id>`` in overwrite mode: Spark gives a
batch that runs again the same id, which makes the sink idempotent. Keyed state
is Spark's own (the state store in the query's checkpoint); with
``mode='update'`` a snapshot holds the keys its batch changed, with
``'complete'`` all of them, with ``'append'`` new rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_snapshots(df: DataFrame, dest: str, checkpoint: str, mode: str = "update", trigger: dict | None = None,
                    name: str | None = None) -> StreamingQuery:
    """Start a query that writes every micro-batch of ``df`` to ``dest``. Keyed
    state lives in RocksDB on the executors and in the checkpoint, not on the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dest.rstrip('/')}/batch={batch_id}")

    w = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return w.trigger(**(trigger or {"availableNow": True})).start()


def snapshots(spark: SparkSession, dest: str, ddl: str) -> DataFrame:
    """All snapshots: rows of schema ``ddl`` and their ``batch``. None written: no rows."""
    schema = f"{ddl}, batch bigint"
    try:
        return spark.read.schema(schema).parquet(dest)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def latest(spark: SparkSession, dest: str, ddl: str, key: str) -> DataFrame:
    """The state after the last batch of an ``update`` stream: of every key the
    newest row (the maximum combines map-side)."""
    rows = snapshots(spark, dest, ddl)
    cols = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*(F.col(f"r.{c}") for c in cols))
