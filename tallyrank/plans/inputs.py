"""Inputs the registered queries derive from the driver's tables.

Every input covers its whole source table; nothing is sampled or capped.

* pages: ``documents`` with page = doc_id.
* revisions: ``conversations``; page = conv_id, seq = turn, new = text,
  old = the previous turn's text (null for turn 0, an insert).
* graph C: distinct ``o_custkey -> l_suppkey`` over orders join lineitem.
* graph P: distinct ``l_suppkey -> l_partkey`` over lineitem.
* graph B: distinct adjacent word pairs of documents.text (newline -> space).
* changelog U: graph C split by order date. Lines of orders before
  ``CUTOFF`` build the base graph; every later line is a change in order
  (date, order, line number): a returned line (flag 'R') deletes its
  customer -> supplier edge, any other line adds it; ties on (date, order,
  line) resolve with the add last. ``BATCH_STARTS`` cut the
  changes into the stream's micro-batches by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import adjacent_pairs, tokens
from ..session import spread

# Fixed parameters of the derived change log.
CUTOFF = "2001-06-01"
BATCH_STARTS = ("2001-06-01", "2001-07-01", "2001-08-01")


# Tables whose rows carry long texts: per-row work dominates, so a scan with
# fewer splits than cores is spread before tokenising.
TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return spread(df) if name in TEXT_TABLES else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ("doc_id", "text")).select(F.col("doc_id").alias("page"), "text")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, page, new_text, old_text)``; one partitioned window over each
    conversation's turns (a conversation is small: its own turns)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (table(spark, sf_dir, "conversations", ("conv_id", "turn", "text"))
            .select(F.col("turn").alias("seq"), F.col("conv_id").alias("page"),
                    F.col("text").alias("new_text"), F.lag("text").over(w).alias("old_text")))


def graph_c_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a customer -> supplier edge event."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"),
                    "o_orderdate", "o_orderkey", "l_linenumber", "l_returnflag"))


# Graphs are returned as edge multisets: every consumer deduplicates once
# (``graph.dedupe``, whose partial aggregate drops repeats map-side).

def graph_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_c_lines(spark, sf_dir).select("src", "dst")


def graph_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def graph_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Columns of their own: each text is cleaned and split once.
    return (table(spark, sf_dir, "documents", ("text",))
            .select(F.translate("text", "\n", " ").alias("line")).select(tokens("line").alias("words"))
            .select(F.inline_outer(adjacent_pairs("words"))).filter(F.col("src").isNotNull()))


def base_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (graph_c_lines(spark, sf_dir).filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp"))
            .select("src", "dst"))


def edge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, batch, op, src, dst)`` for every order line on or after the cutoff."""
    lines = graph_c_lines(spark, sf_dir).filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp"))
    op = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    batch = F.lit(0)
    for i, start in enumerate(BATCH_STARTS[1:], start=1):
        batch = F.when(F.col("o_orderdate") >= F.lit(start).cast("timestamp"), F.lit(i)).otherwise(batch)
    # The tables hold repeated (order, line number) pairs, so ``op`` ends the
    # key: on a tie the add sorts last and wins.
    return lines.select(
        F.struct("o_orderdate", "o_orderkey", "l_linenumber", op.alias("op")).alias("seq"),
        batch.alias("batch"), op.alias("op"), "src", "dst")
