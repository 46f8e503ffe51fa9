"""Ordered prefixes and slices (O22, O23) without a single-task window.

A running sum over a total order is computed in distributed steps:

1. ``repartitionByRange`` on all order columns (Spark samples them, so rows
   sharing a first-column value are split by the next columns), sorted
   inside each partition, each row tagged with its partition ``p`` and its
   position inside it (the low bits of ``monotonically_increasing_id``);
2. the tagged rows are checkpointed, which fixes the ranges, and summed by a
   window per range (``p`` is its key, so ranges are spread over the tasks);
3. range totals (one row per range) become offsets, broadcast back.

Callers hand in the order key and the value only: whatever else ``df`` holds is
written and shuffled with them. ``take_chars`` does so itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java_length
from ..session import cut_lineage, shuffle_partitions

_LOW33 = (1 << 33) - 1


def running_sum(df: DataFrame, order_cols: Sequence[str], value: str | None = None,
                buckets: int | None = None) -> DataFrame:
    """Add ``idx`` (0-based position in the order) and ``cum`` (inclusive
    running sum of ``value``; of 1 per row when ``value`` is None)."""
    spark = df.sparkSession
    nb = buckets or shuffle_partitions(spark)
    v = F.col(value).cast("long") if value else F.lit(1).cast("long")
    r = (df.withColumn("__v", v).repartitionByRange(nb, *order_cols).sortWithinPartitions(*order_cols)
         .withColumn("__p", F.spark_partition_id())
         .withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    r = cut_lineage(r)
    w = Window.partitionBy("__p").orderBy("__i")
    r = r.withColumn("__lcum", F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tot = r.groupBy("__p").agg(F.sum("__v").alias("__t"), F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__ot"),
                     F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__oc"))
    return (r.join(F.broadcast(off), "__p")
            .withColumn("cum", F.col("__ot") + F.col("__lcum"))
            .withColumn("idx", F.col("__oc") + F.col("__i"))
            .drop("__p", "__i", "__v", "__lcum", "__ot", "__oc"))


def up_to(df: DataFrame, order_cols: Sequence[str], last: Sequence) -> Column:
    """Rows at or before the key ``last`` in the order of ``order_cols`` (nulls first)."""
    kinds = dict(df.dtypes)
    cond = None
    for c, v in reversed(list(zip(order_cols, last))):
        value = F.lit(v).cast(kinds[c])
        before = F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < value)
        upto = F.col(c).isNull() if v is None else F.col(c).isNull() | (F.col(c) <= value)
        # The first column's own bound stands apart, where a scan can use it.
        cond = upto if cond is None else upto & (before | cond)
    return cond


def take_chars(df: DataFrame, order_cols: Sequence[str], size: int, text_col: str = "text",
               length_col: str | None = None) -> DataFrame:
    """Rows in order until the running character count (``String.length``
    of ``text_col``, or ``length_col``) reaches ``size``: the row that crosses
    it is kept, and the first row always is (O22). Adds ``chars``, ``cum_chars``.

    A first pass sums key and length alone and finds the last key needed. That
    one key becomes a literal filter, which the scan uses to skip row groups, and
    only the rows up to it are summed again with all their columns."""
    ln = F.col(length_col) if length_col else java_length(F.col(text_col))

    def prefix(rows: DataFrame) -> DataFrame:
        r = running_sum(rows, order_cols, "chars")
        return r.filter((F.col("idx") == 0) | (F.col("cum") - F.col("chars") < F.lit(size)))

    sized, key = df.withColumn("chars", ln), F.struct(*order_cols)
    last = prefix(sized.select(*order_cols, "chars")).agg(F.max(key).alias("last")).first()["last"]    # one key
    near = sized if last is None else sized.filter(up_to(df, order_cols, last))
    return prefix(near).withColumnRenamed("cum", "cum_chars").drop("idx")


def slice_batches(df: DataFrame, order_cols: Sequence[str], rows_per_batch: int,
                  n_batches: int | None = None, empty_runs: int = 0) -> DataFrame:
    """Tag rows with the micro-batch that sends them (O23): ``empty_runs``
    empty batches first, then ``rows_per_batch`` rows per batch in order;
    ``n_batches`` keeps only the first that many data batches."""
    r = running_sum(df, order_cols)
    r = r.withColumn("batch", (F.lit(empty_runs) + F.floor(F.col("idx") / F.lit(rows_per_batch))).cast("int"))
    if n_batches is not None:
        r = r.filter(F.col("batch") < F.lit(empty_runs + n_batches))
    return r.drop("cum", "idx")
