"""Streaming sources (S1), replaying a table batch by batch through a file
stream (O23's output), the progress table (S9, S11) and the idle stop (S10)."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import scratch_path


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, fmt: str = "text",
                 schema=None) -> DataFrame:
    """A file stream of lines (``value``) or of Parquet rows, oldest file first;
    a micro-batch takes all new files, or ``files_per_batch`` of them. Any other streaming DataFrame
    (Kafka, socket) with the same columns works with the operators too."""
    r = spark.readStream.format(fmt)
    if files_per_batch is not None:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def write_slices(df: DataFrame, path: str, batch_col: str = "batch", value_col: str = "value") -> None:
    """Write ``df`` once, split into slices by ``batch_col``: every task writes
    its rows of every slice, so a slice of any share of the rows has many
    writers, and a slice is read back without the others."""
    (df.select(F.col(batch_col).alias("batch"), F.col(value_col).alias("value"))
     .write.partitionBy("batch").parquet(path))


def replay(spark: SparkSession, slices: str, landing: str,
           start: Callable[[DataFrame], StreamingQuery]) -> StreamingQuery | None:
    """Send the slices under ``slices`` in order to the folder ``landing`` and let
    the stream fold each before the next is sent, so a slice is one micro-batch
    of as many files as it has writers, whatever the file times are.

    ``start`` starts the query, on the ``availableNow`` trigger and always with
    the same checkpoint, over the stream it is given. Lines of one slice have
    no order among them: what must follow another line comes in a later slice
    or carries a sequence number. Returns the last query (None without slices).
    The driver holds the list of slices, one number each."""
    table = spark.read.schema("value string, batch bigint").parquet(slices)
    query = None
    for b in sorted(r["batch"] for r in table.select("batch").distinct().collect()):
        table.filter(F.col("batch") == b).select("value").write.text(f"{landing}/slice-{b:08d}")
        query = start(stream_lines(spark, f"{landing}/slice-*"))
        query.awaitTermination()
    return query


PROGRESS = "id string, run_id string, batch_id long, num_input_rows long, duration_ms long, timestamp string"


class ProgressLog(StreamingQueryListener):
    """Every trigger of every query, idle ones included, for as long as it is
    attached: Spark itself keeps only a query's last hundred. The log is a
    table in the shared folder; the driver holds at most ``every`` triggers."""

    def __init__(self, spark: SparkSession, path: str | None = None, every: int = 100):
        self.spark, self.path, self.every = spark, path or scratch_path(spark, "progress"), every
        self.held: list[tuple] = []
        self.lock, self.ended = threading.Lock(), {}
        self._write()
        spark.streams.addListener(self)

    def _end(self, run_id: str) -> threading.Event:
        return self.ended.setdefault(run_id, threading.Event())

    def _write(self) -> None:
        rows, self.held = self.held, []
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def _add(self, *row) -> None:
        with self.lock:
            self.held.append(row)
            if len(self.held) >= self.every:
                self._write()

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(str(p.id), str(p.runId), int(p.batchId), int(p.numInputRows),
                  int(p.durationMs.get("triggerExecution", 0)), p.timestamp)

    def onQueryIdle(self, event) -> None:
        self._add(str(event.id), str(event.runId), None, 0, 0, event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query: StreamingQuery, wait_s: float = 60.0) -> DataFrame:
        """The query's rows, those of its earlier runs included; once it has ended, only after its last event has arrived."""
        if not query.isActive and not self._end(str(query.runId)).wait(wait_s):
            raise TimeoutError("the end of the query was not reported")
        with self.lock:
            if self.held:
                self._write()
        return self.spark.read.schema(PROGRESS).parquet(self.path).filter(F.col("id") == str(query.id))

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def progress_table(spark: SparkSession, query: StreamingQuery, log: ProgressLog | None = None) -> DataFrame:
    """One row per trigger: ``batch_id, num_input_rows, duration_ms, timestamp``
    (rows per batch and per-batch time; ``batch_id`` is null for an idle trigger).
    Without a ``log`` attached before the start only a query whose triggers
    Spark still holds all can be shown; a longer one is an error."""
    if log is not None:
        return log.of(query).select("batch_id", "num_input_rows", "duration_ms", "timestamp")
    recent = query.recentProgress
    kept = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(recent) >= kept - 1:  # the buffer is cut as it fills
        raise RuntimeError(f"Spark keeps the last {kept} triggers only; attach a ProgressLog before the start")
    rows = [(int(p["batchId"]), int(p["numInputRows"]), int(p["durationMs"].get("triggerExecution", 0)),
             p["timestamp"]) for p in recent]
    return spark.createDataFrame(rows, "batch_id long, num_input_rows long, duration_ms long, timestamp string")


class _IdleStop(StreamingQueryListener):
    """Sets ``done`` after ``empty`` triggers without data in a row, once data has
    arrived, or when the query ends. Spark reports an idle query every
    ``spark.sql.streaming.noDataProgressEventInterval`` ms (as set when it started)."""

    def __init__(self, query: StreamingQuery, empty: int):
        self.run, self.empty, self.idle, self.done = str(query.runId), empty, 0, threading.Event()
        self.data = False

    def _trigger(self, rows: int) -> None:
        self.data = self.data or rows > 0
        self.idle = 0 if rows else self.idle + 1
        if self.data and self.idle >= self.empty:
            self.done.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run:
            self._trigger(int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == self.run:
            self._trigger(0)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.done.set()


def run_to_idle(query: StreamingQuery, empty_batches: int = 2, timeout_s: float | None = None) -> None:
    """Stop ``query`` on its ``empty_batches``-th idle event in a row after data has
    arrived (a query on ``availableNow`` simply runs to its end). With
    ``timeout_s``, a query that is not idle by then goes on and a TimeoutError
    is raised."""
    streams = SparkSession.active().streams
    stop = _IdleStop(query, empty_batches)
    streams.addListener(stop)
    try:
        # Events before the listener was attached are in the query's own record.
        stop.data = stop.data or any(p["numInputRows"] > 0 for p in query.recentProgress)
        if query.isActive and not stop.done.wait(timeout_s):
            raise TimeoutError(f"the query was not idle after {timeout_s} s; it goes on")
    finally:
        streams.removeListener(stop)
    query.stop()
