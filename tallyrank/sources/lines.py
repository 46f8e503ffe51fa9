"""Text-line sources and parsers (O1, O2, O7, O8 and the changelog formats).

Each parser returns the parsed rows; ``with_rejects=True`` also returns the
lines that do not parse, with a reason, instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP, TAB_SEP, WS_SEP, java_split


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """One row per line, column ``value`` (O1). ``partitions`` only ever raises
    the partition count (like a minimum-partitions hint)."""
    df = spark.read.text(path)
    if partitions and partitions > df.rdd.getNumPartitions():
        df = df.repartition(partitions)
    return df


def line_seq(df: DataFrame) -> Column:
    """An increasing key in file order: file time, file name, then the row's
    position inside its split. Exact when each file is read as one split, as
    with the per-batch slice files of a file stream."""
    return F.struct(F.col("_metadata.file_modification_time").alias("t"),
                    F.col("_metadata.file_name").alias("f"),
                    F.monotonically_increasing_id().alias("i"))


def _split_result(ok: DataFrame, bad: DataFrame, with_rejects: bool):
    return (ok, bad) if with_rejects else ok


def parse_pages(lines: DataFrame, col: str = "value", with_rejects: bool = False):
    """``page<US>text`` lines to ``(page, text)`` (O2); extra fields ignored.

    A line has two fields if a separator is left once those at its end are gone,
    so the filter, which Catalyst copies below the split, need not split it."""
    f = lines.withColumn("__f", java_split(F.col(col), FIELD_SEP))
    ok = (lines.filter(F.contains(F.rtrim(F.col(col), F.lit(FIELD_SEP)), F.lit(FIELD_SEP)))
          .select(java_split(F.col(col), FIELD_SEP).alias("__f"))
          .select(F.col("__f")[0].alias("page"), F.col("__f")[1].alias("text")))
    bad = f.filter(F.size("__f") < 2).select(F.col(col).alias("line"), F.lit("fewer than 2 fields").alias("reason"))
    return _split_result(ok, bad, with_rejects)


def corpus_text(lines: DataFrame, col: str = "value") -> DataFrame:
    """Text of a corpus line by the initial-load field rule: a two-field line
    gives field 1, any other field count gives field 0 (the page key for a
    three-field line). A line of separators only has no field 0 and is dropped."""
    f = java_split(F.col(col), FIELD_SEP)
    return (lines.select(f.alias("__f"))
            .filter(F.size("__f") >= 1)
            .select(F.when(F.size("__f") == 2, F.col("__f")[1]).otherwise(F.col("__f")[0]).alias("text")))


def parse_revisions(lines: DataFrame, col: str = "value", seq: Column | None = None,
                    with_rejects: bool = False):
    """``page<US>new`` (insert) or ``page<US>new<US>old`` (update) lines to
    ``(seq, page, new_text, old_text)``; four or more fields count as an update
    on fields 1 and 2, one field is rejected."""
    seq = seq if seq is not None else line_seq(lines)
    f = lines.select(seq.alias("seq"), F.col(col).alias("__line"), java_split(F.col(col), FIELD_SEP).alias("__f"))
    ok = (f.filter(F.size("__f") >= 2)
          .select("seq", F.col("__f")[0].alias("page"), F.col("__f")[1].alias("new_text"),
                  F.when(F.size("__f") >= 3, F.col("__f")[2]).alias("old_text")))
    bad = f.filter(F.size("__f") < 2).select(F.col("__line").alias("line"),
                                              F.lit("fewer than 2 fields").alias("reason"))
    return _split_result(ok, bad, with_rejects)


def parse_edges(lines: DataFrame, sep: str = TAB_SEP, ids: str = "string", col: str = "value",
                with_rejects: bool = False):
    """Edge lines to ``(src, dst)`` (O7 tab / O8 white space). ``ids='bigint'``
    casts both ids; lines that are short or do not cast are rejects."""
    f = lines.select(F.col(col).alias("__line"), java_split(F.col(col), sep).alias("__f"))
    src, dst = F.get(F.col("__f"), 0), F.get(F.col("__f"), 1)
    if ids != "string":
        src, dst = src.try_cast(ids), dst.try_cast(ids)
    f = f.select("__line", src.alias("src"), dst.alias("dst"), F.size("__f").alias("__n"))
    good = (F.col("__n") >= 2) & F.col("src").isNotNull() & F.col("dst").isNotNull()
    ok = f.filter(good).select("src", "dst")
    bad = f.filter(~good).select(F.col("__line").alias("line"),
                                 F.when(F.col("__n") < 2, F.lit("fewer than 2 fields"))
                                 .otherwise(F.lit(f"id is not {ids}")).alias("reason"))
    return _split_result(ok, bad, with_rejects)


def parse_edge_updates(lines: DataFrame, col: str = "value", seq: Column | None = None,
                       with_rejects: bool = False):
    """``op from to [number]`` lines (op 1 = add, -1 = delete) to ``(seq, op, src, dst)``.

    Numbered lines are ordered by their number; lines without one come after
    all of them, in the order of ``seq`` (file order by default). Every line is
    either parsed or a reject."""
    seq = seq if seq is not None else line_seq(lines)
    f = lines.select(seq.alias("__seq"), F.col(col).alias("line"), java_split(F.col(col), WS_SEP).alias("__f"))
    numbered, number = F.size("__f") >= 4, F.get(F.col("__f"), 3).try_cast("bigint")
    f = f.select("line", numbered.alias("__numbered"),
                 F.struct((~numbered).alias("late"), number.alias("number"), F.when(~numbered, F.col("__seq")).alias("at")).alias("seq"),
                 F.get(F.col("__f"), 0).try_cast("int").alias("op"),
                 F.get(F.col("__f"), 1).try_cast("bigint").alias("src"),
                 F.get(F.col("__f"), 2).try_cast("bigint").alias("dst"))
    shaped = F.coalesce(F.col("op").isin(1, -1), F.lit(False)) & F.col("src").isNotNull() & F.col("dst").isNotNull()
    wrong = (F.when(~F.coalesce(shaped, F.lit(False)), F.lit("not 'op from to' with op 1 or -1"))
             .when(F.coalesce("__numbered", F.lit(False)) & F.col("seq.number").isNull(), F.lit("the sequence is no number")))
    f = f.withColumn("reason", wrong)
    return _split_result(f.filter("reason IS NULL").select("seq", "op", "src", "dst"),
                         f.filter("reason IS NOT NULL").select("line", "reason"), with_rejects)
