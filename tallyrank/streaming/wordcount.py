"""Streaming word counts (S2, S3, S4) on Spark's own keyed state.

The operators map a stream to a stream, a streaming aggregate in ``update`` mode:
its sums live in the state store, a batch touches the keys of its own lines, and
what a batch changed goes to the sink (``sinks.write_snapshots``). A batch that
runs again, a restart and the partitioning of the state are Spark's.

An initial state (S4) is a second input of the same aggregate: the table is
written once and read as a stream, so the first batch takes it in with the first
lines and a restart does not take it in again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP, java_split
from ..operators.text import page_word_count, signed_tokens
from ..session import scratch_path
from ..sources.lines import parse_revisions

COUNTS = "word string, n bigint"
PAGES = "page string, seq bigint, counts map<string,bigint>"


def seeded(rows: DataFrame, initial: DataFrame | None, path: str | None = None) -> DataFrame:
    """The stream ``rows`` with the table ``initial`` (same columns) before it.
    The table is written to ``path`` if nothing is there yet: a run that goes on
    from a checkpoint gives the path of the first run."""
    if initial is None:
        return rows
    spark = rows.sparkSession
    path = path or scratch_path(spark, "initial")
    initial.select(*rows.columns).write.mode("ignore").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path).unionByName(rows)


def _strict(lines: DataFrame, good: Column, strict: bool) -> DataFrame:
    """With ``strict`` a line that does not parse fails the batch."""
    if not strict:
        return lines
    wrong = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("string")
    return lines.withColumn("value", F.when(good, F.col("value")).otherwise(wrong))


def _fields() -> Column:
    return java_split(F.col("value"), FIELD_SEP)


def stream_word_count(lines: DataFrame, initial: DataFrame | None = None, initial_path: str | None = None,
                      strict: bool = False) -> DataFrame:
    """Corpus counts ``(word, n)`` over a stream of revision lines (S3):
    ``page<US>new`` adds the words of ``new``; ``page<US>new<US>old`` also takes
    those of ``old`` away. ``initial`` is ``(word, n)``. Words at 0 stay. Lines
    without a page are left out here (``stream_rejects``), or fail if ``strict``."""
    lines = _strict(lines.select("value"), F.size(_fields()) >= 2, strict)
    words = signed_tokens(parse_revisions(lines, seq=F.lit(0)), keep=()).select("word", F.col("w").alias("n"))
    return seeded(words, initial, initial_path).groupBy("word").agg(F.sum("n").alias("n"))


def _seq() -> Column:
    return F.get(_fields(), 2).try_cast("bigint")


def stream_page_word_count(lines: DataFrame, initial: DataFrame | None = None, initial_path: str | None = None,
                           strict: bool = False) -> DataFrame:
    """Latest counts ``(page, seq, counts)`` per page over a stream of
    ``page<US>text<US>seq`` lines (S2): of a page the line with the greatest ``seq``
    counts, in whatever order lines and files come (of equal ones the text with
    the greater hash). ``initial`` is ``(page, counts)``; any line comes after it."""
    good = (F.size(_fields()) >= 3) & _seq().isNotNull()
    lines = _strict(lines.select("value"), good, strict)
    rows = lines.filter(good).select(F.get(_fields(), 0).alias("page"), F.get(_fields(), 1).alias("text"), _seq().alias("seq"))
    rows = page_word_count(rows.withColumn("tie", F.xxhash64("text")), keep=("seq", "tie")).select("page", "seq", "tie", "counts")
    if initial is not None:
        initial = initial.select("page", F.lit(None).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("tie"), "counts")
    last = F.max_by(F.struct("seq", "counts"), F.struct("seq", "tie")).alias("last")
    return seeded(rows, initial, initial_path).groupBy("page").agg(last).select("page", "last.seq", "last.counts")


def stream_rejects(lines: DataFrame, pages: bool = False) -> DataFrame:
    """The lines ``(line, reason)`` that ``stream_word_count``, or with ``pages``
    ``stream_page_word_count``, leaves out."""
    short = F.size(_fields()) < (3 if pages else 2)
    reason = F.when(short, F.lit(f"fewer than {3 if pages else 2} fields"))
    if pages:
        reason = reason.when(_seq().isNull(), F.lit("the sequence is no number"))
    return lines.select(F.col("value").alias("line"), reason.alias("reason")).filter("reason IS NOT NULL")
