"""Versioned state tables for ``foreachBatch`` pipelines.

Batch ``b`` reads version ``b - 1`` (or the initial state for the first
batch) and writes ``<root>/v=<b>`` in overwrite mode. A batch that Spark
re-runs after a failure reads the same input version and rewrites the same
output, so the result does not depend on retries; the streaming checkpoint
records which batches are done. A version counts once its commit marker is
there, which is written after all its tables.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _marks(root: str) -> str:
    return f"{root.rstrip('/')}-commits"


def commit_version(spark: SparkSession, root: str, v: int, tables: tuple[str, ...] = ("",)) -> None:
    """Mark version ``v`` as complete, after all its ``tables`` are written: one
    small file beside the state, and no reader takes a version without it."""
    (spark.createDataFrame([(v, t) for t in tables], "version bigint, name string").coalesce(1)
     .write.mode("overwrite").parquet(f"{_marks(root)}/batch={v}"))


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the file system Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def begin_version(spark: SparkSession, root: str, v: int) -> None:
    """Take back the mark of version ``v`` before a batch that runs again rewrites
    it, so that a run which stops in between leaves no half of it marked."""
    _delete(spark, f"{_marks(root)}/batch={v}")


def retire(spark: SparkSession, root: str, keep: int | None, snapshot: str | None = None) -> None:
    """Delete all but the newest ``keep`` versions (None keeps all; at least two
    stay, since a batch that runs again reads the one before it). With
    ``snapshot`` versions build on the last one that has this table: those from
    the newest such one at or before the oldest kept version stay too. A
    version's mark goes before its files."""
    if keep is None:
        return
    done = committed_tables(spark, root)
    vs = sorted({v for v, _ in done})
    first = vs[-max(2, keep):][0]
    if snapshot:
        first = max((v for v, t in done if t == snapshot and v <= first), default=vs[0])
    for v in (x for x in vs if x < first):
        begin_version(spark, root, v)
        for table in {t for x, t in done if x == v}:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(root, v, table or None)}")
        _delete(spark, version_path(root, v))


def committed_tables(spark: SparkSession, root: str) -> set[tuple[int, str]]:
    """``(version, table)`` for every committed table under ``root``; table
    ``""`` for a version written as one table."""
    try:
        marks = spark.read.schema("version bigint, name string").parquet(_marks(root)).collect()  # a row per table
    except AnalysisException as e:  # nothing committed yet
        if "PATH_NOT_FOUND" in str(e):
            return set()
        raise
    return {(int(m["version"]), m["name"]) for m in marks}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root``."""
    return sorted({v for v, _ in committed_tables(spark, root)})


def version_path(root: str, v: int) -> str:
    return f"{root.rstrip('/')}/v={v}"


def read_version(spark: SparkSession, root: str, v: int, table: str | None = None) -> DataFrame:
    p = version_path(root, v)
    return spark.read.parquet(f"{p}/{table}" if table else p)


def latest(spark: SparkSession, root: str, table: str | None = None) -> DataFrame | None:
    vs = versions(spark, root)
    return read_version(spark, root, vs[-1], table) if vs else None


def write_version(df: DataFrame, root: str, v: int, table: str | None = None) -> None:
    p = version_path(root, v)
    df.write.mode("overwrite").parquet(f"{p}/{table}" if table else p)


# Bucketed versions: a version written bucketed by its key reads back with
# HashPartitioning(key, buckets), so merging a batch into it shuffles only
# the batch. The bucket count is fixed for the life of a state folder, like
# ``spark.sql.shuffle.partitions`` for a streaming checkpoint.

def _table_name(root: str, v: int, table: str | None) -> str:
    h = hashlib.sha1(f"{version_path(root, v)}/{table or ''}".encode()).hexdigest()[:16]
    return f"tallyrank_state_{h}"


def write_version_bucketed(df: DataFrame, root: str, v: int, key: str, buckets: int,
                           table: str | None = None) -> None:
    """Write a bucketed version; the catalog forgets the version before the
    previous one, whose files stay."""
    p = version_path(root, v)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {_table_name(root, v - 2, table)}")
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", f"{p}/{table}" if table else p).saveAsTable(_table_name(root, v, table)))


def read_version_bucketed(spark: SparkSession, root: str, v: int, key: str, buckets: int, ddl: str,
                          table: str | None = None) -> DataFrame:
    """A bucketed version; registered again (with its bucket spec) when the
    catalog does not know it, e.g. after a restart."""
    name = _table_name(root, v, table)
    if not spark.catalog.tableExists(name):
        p = version_path(root, v)
        loc = f"{p}/{table}" if table else p
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {buckets} BUCKETS LOCATION '{loc}'")
    return spark.table(name)


class VersionTracker:
    """The newest committed version, known without listing the commits while
    consecutive batches are folded; only the first batch after a start lists
    them. Hand one tracker to several runs over the same state to carry it, and
    the prepared links of a graph stream, from run to run; ``close`` it then."""

    def __init__(self, root: str):
        self.root = root
        self.last: int | None = None
        self.links = None       # of version ``last``

    def before(self, spark: SparkSession, batch_id: int) -> int | None:
        """Newest committed version below ``batch_id`` (None if there is none)."""
        if self.last is not None and self.last == batch_id - 1:
            return self.last
        older = [v for v in versions(spark, self.root) if v < batch_id]
        return older[-1] if older else None

    def commit(self, spark: SparkSession, batch_id: int, tables: tuple[str, ...] = ("",)) -> None:
        commit_version(spark, self.root, batch_id, tables)
        self.last = batch_id

    def keep_links(self, links) -> None:
        """Hold ``links``; tables persisted for others are released."""
        if self.links is not None and (links is None or links.cold is not self.links.cold):
            self.links.unpersist()
        self.links = links

    def close(self) -> None:
        self.keep_links(None)
        self.last = None


def read_once(fold):
    """A ``foreachBatch`` function that may use its batch several times while the
    source is read (and its rows are counted) once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            fold(held, batch_id)
        finally:
            held.unpersist()
    return run


def keep_rejects(bad: DataFrame, state_dir: str, batch_id: int, strict: bool) -> None:
    """Write a batch's malformed lines (``line, reason``) beside the state, before
    the state itself; with ``strict`` any such line fails the batch."""
    path = f"{state_dir.rstrip('/')}-rejects/batch={batch_id}"
    bad.write.mode("overwrite").parquet(path)
    if strict:
        first = bad.sparkSession.read.schema("line string, reason string").parquet(path).first()
        if first is not None:
            raise ValueError(f"malformed line in batch {batch_id}: {first['reason']}: {first['line']!r}")


def rejects(spark: SparkSession, state_dir: str) -> DataFrame:
    """``(line, reason, batch)`` of all malformed lines a stream has met."""
    return (spark.read.schema("line string, reason string, batch bigint")
            .parquet(f"{state_dir.rstrip('/')}-rejects"))
