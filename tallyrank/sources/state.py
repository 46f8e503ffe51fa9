"""Result sinks and graph state tables.

State is a folder of Parquet tables (``edges``, ``ranks``, ``deltas``) in the
shared file system, bucketed and sorted by ``src`` or ``node``, with their bucket
count in ``layout``: a reload has the buckets, so point reads (``rank_at``,
``neighbors`` with ``few``) open only those of the nodes asked for and joins on
the key need no shuffle. A bucket that holds a hot source is written by as many
tasks as its size asks for (``rebalance``). ``export_jdbc`` copies the
same tables to a database with Spark's JDBC writer (one connection per
partition, ``truncate`` keeps the table definition).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pagerank import to_wide, zero_deltas

STATE_BUCKETS = 64


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write a result (O25): ``parquet`` (default), ``csv``, ``json``, ``orc`` or
    ``text`` (one string column)."""
    df.write.mode(mode).format(fmt).options(**options).save(path)


def _save_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """The rows of a bucket meet in few tasks first (the bucket of Spark's own layout
    is this hash), so a task writes files of few buckets."""
    table = f"tallyrank_state_{uuid.uuid4().hex[:12]}"
    b = f"bucket_{table}"
    (df.withColumn(b, F.pmod(F.hash(key), F.lit(buckets))).hint("rebalance", F.col(b)).drop(b)
     .write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table))
    df.sparkSession.sql(f"DROP TABLE {table}")      # the files stay


def _load_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    table = f"tallyrank_state_{uuid.uuid4().hex[:12]}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    out.schema      # resolved here, while the catalog still knows it
    spark.sql(f"DROP TABLE {table}")
    return out


def save_graph_state(path: str, edges: DataFrame, history: DataFrame, deltas: DataFrame | None = None,
                     buckets: int = STATE_BUCKETS) -> None:
    """Write ``edges (src, dst)``, ``ranks (node, hist)`` and ``deltas (node, delta)``
    (zero deltas when not given) under ``path`` (O20), in ``buckets`` buckets."""
    _save_bucketed(edges.select("src", "dst").distinct(), f"{path}/edges", "src", buckets)
    _save_bucketed(history.select("node", "hist"), f"{path}/ranks", "node", buckets)
    d = deltas if deltas is not None else zero_deltas(history)
    _save_bucketed(d.select("node", "delta"), f"{path}/deltas", "node", buckets)
    edges.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def load_graph_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, ranks, deltas)`` written by :func:`save_graph_state`."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    return (_load_bucketed(spark, f"{path}/edges", "src", buckets), _load_bucketed(spark, f"{path}/ranks", "node", buckets),
            _load_bucketed(spark, f"{path}/deltas", "node", buckets))


def export_jdbc(url: str, edges: DataFrame, history: DataFrame, iters: int, deltas: DataFrame | None = None,
                properties: dict | None = None, mode: str = "overwrite") -> None:
    """Copy the state to the reference's three tables: ``links (node, neighbor)``
    (one row per edge rather than a space-joined list), ``ranks (node, i0..)``
    and ``deltas (node, i0..)``. Credentials come in ``properties``."""
    props = dict(properties or {})
    props.setdefault("truncate", "true")
    edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor")).write.jdbc(url, "links", mode, props)
    to_wide(history, iters).write.jdbc(url, "ranks", mode, props)
    d = deltas if deltas is not None else zero_deltas(history)
    to_wide(d, iters, "delta").write.jdbc(url, "deltas", mode, props)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=dict(properties or {}))
