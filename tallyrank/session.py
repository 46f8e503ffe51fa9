"""Session helpers: a local session for tests and benches, the shared
checkpoint folder, and size-checked broadcasts.

Library functions never start a session; they take DataFrames. Only tests,
``bench.py`` and ``__spark_entry__`` call :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows we broadcast for a side whose row count we checked.
# At ~40 bytes per (key, value) row this stays far below the 8 GiB broadcast
# limit and within the default driver result size.
BROADCAST_MAX_ROWS = 2_000_000


def local_session(cpus: int | str = "*", partitions: int = 8, checkpoint_dir: str | None = None,
                  app: str = "tallyrank") -> SparkSession:
    """A local session configured as a cluster job would be (AQE on, UI off).

    ``checkpoint_dir`` is set only when given or when the session has none,
    which is the test / bench situation; on a cluster the job owner sets
    ``spark.checkpoint.dir`` to a shared folder.
    """
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Only a local-mode session without one gets a fresh temporary folder; a
    cluster session without one is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        d = tempfile.mkdtemp(prefix="tallyrank-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    root = root.rstrip("/")
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable checkpoint).

    The checkpointed relation keeps its output partitioning, so a table
    hash-partitioned by a key stays co-partitioned for later joins.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_bucketed(df: DataFrame, key: str, buckets: int, name: str = "vec") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder,
    bucketed and sorted by ``key`` into ``buckets`` buckets.

    Unlike ``checkpoint()`` under AQE, the bucketed scan reports
    ``HashPartitioning(key, buckets)``, so a join on ``key`` with a table laid
    out the same way needs no shuffle. ``df`` should already be partitioned
    by ``key`` into ``buckets`` partitions (one file per bucket then). The
    catalog entry is dropped at once: the returned plan holds the table's
    layout, and the files stay like checkpoint files."""
    spark = df.sparkSession
    table = f"tallyrank_{name}_{uuid.uuid4().hex[:12]}"
    (df.write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    out = spark.table(table)
    out.schema      # resolved here, while the catalog still knows it
    spark.sql(f"DROP TABLE {table}")
    return out


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when its counted row count ``rows`` is at most
    ``max_rows``; otherwise ``df`` unchanged, so the join that uses it falls
    back to a shuffle join. Count ``df`` after materialising it, so the bound
    holds for the rows the join will see."""
    return F.broadcast(df) if rows <= max_rows else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` only when it has fewer partitions than the cluster
    has cores (a small or single-row-group input); a large input, which
    already has one split per block, is returned unchanged with no shuffle."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
