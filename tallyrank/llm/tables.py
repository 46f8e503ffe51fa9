"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: White space that separates words; every other character is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, cols: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``) as Spark spells it."""
    return checkpoint_root(spark).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def conf_held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds for what is run here."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a write made here once the write has ended."""
    with conf_held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; smaller on disk than
    ``cut``, and the shuffle files of the way to it go."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(df.sparkSession):
        df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes what was ``written`` under names that begin with ``folder/``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_names(keep: tuple[str, ...], own: tuple[str, ...]) -> dict[str, str]:
    """The output name of every kept column: its own, with ``kept_`` before it as often
    as a column of the operator, or another, has that name."""
    names, taken = {}, {*own, *keep}
    for c in keep:
        name = c
        while name in own or (name != c and name in taken):
            name = f"kept_{name}"
        names[c] = name
        taken.add(name)
    return names


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                rows: int = 0) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to one (or none).
    With ``rows`` the batches are cut into slices of so many rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows or max(1, b.num_rows)):
                out = fn(b.slice(i, rows or b.num_rows))
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


class Shipped:
    """An object of bounded size broadcast to all tasks, with its class, by value."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent, self.opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"sent": self.sent, "opened": None}

    def get(self):
        if self.opened is None:
            self.opened = cloudpickle.loads(self.sent.value)
        return self.opened


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """A row's own key: rows with the same id and the same text are one
    document, rows that differ in either (or are null there) are different."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def prefix_sums(values: Column, step: int = 256, merge=lambda a, x: a + x) -> Column:
    """Running sums of an array of ints: item i is the sum of items 0 to i
    (or, with ``merge``, another associative fold that starts from 0).

    Built-in higher-order functions keep no state between items, so sums are
    taken over blocks of ``step``: the totals of earlier blocks plus the items
    of the own block, which costs ``n * step / 2`` additions, not ``n * n / 2``.
    ``values`` must be a column, not an expression worth computing once only.
    """
    n_blocks = F.ceil(F.size(values) / F.lit(step)).cast("int")

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), merge)

    def blocks(each) -> Column:
        ids = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(ids, each)

    def own(b: Column) -> Column:
        return F.slice(values, b * step + 1, F.lit(step))

    def let(value: Column, use) -> Column:
        """``use`` of a value computed once."""
        return F.transform(F.array(value), use)[0]

    return F.flatten(let(blocks(lambda b: fold(own(b))), lambda totals: blocks(
        lambda b: let(F.struct(fold(F.slice(totals, F.lit(1), b)).alias("before"), own(b).alias("own")),
                      lambda x: F.transform(x["own"], lambda _, i: merge(
                          x["before"], fold(F.slice(x["own"], F.lit(1), i + 1))))))))
