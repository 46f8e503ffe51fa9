"""Word-count operators, batch form.

Tallies inside one row need no shuffle (``with_row_counts``); tallies across
rows are one ``groupBy`` whose partial aggregate combines map-side, so a word
that holds a third of all tokens still leaves each task as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, with_row_counts
from ..sources.lines import corpus_text


def page_word_count(pages: DataFrame, page_col: str = "page", text_col: str = "text",
                    keep: Sequence[str] = ()) -> DataFrame:
    """Per line: ``(page, counts map<string,bigint>)`` (O3). Lines with equal
    page keys stay separate rows; a line without tokens gets an empty map."""
    df = pages.select(*keep, F.col(page_col).alias("page"), tokens(F.col(text_col)).alias("__tok"))
    df = with_row_counts(df, "__tok", "__cnt")
    return df.select(*keep, "page", F.map_from_entries("__cnt").alias("counts"))


def page_word_count_long(pages: DataFrame, page_col: str = "page", text_col: str = "text",
                         keep: Sequence[str] = ()) -> DataFrame:
    """Per line and word: ``(page, word, n)``; no shuffle."""
    df = pages.select(*keep, F.col(page_col).alias("page"), tokens(F.col(text_col)).alias("__tok"))
    df = with_row_counts(df, "__tok", "__cnt")
    # explode_outer: a plain explode makes Catalyst infer a ``size(__cnt) > 0``
    # filter below the projections, re-evaluating the tally per element.
    return (df.select(*keep, "page", F.explode_outer("__cnt").alias("__c"))
            .filter(F.col("__c").isNotNull())
            .select(*keep, "page", F.col("__c.word").alias("word"), F.col("__c.n").alias("n")))


def word_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus counts ``(word, n)`` over a text column."""
    return (df.select(F.explode(tokens(F.col(text_col))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def word_count_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Corpus counts over raw page lines by the initial-load field rule."""
    return word_count(corpus_text(lines, col), "text")


def signed_tokens(revisions: DataFrame, keep: Sequence[str] = ("seq", "page")) -> DataFrame:
    """Changelog to weights (O5): each word of ``new_text`` gives +1, each word
    of ``old_text`` (null for an insert) gives -1. Output ``(*keep, word, w)``."""
    plus = F.transform(tokens("new_text"), lambda x: F.struct(x.alias("word"), F.lit(1).alias("w")))
    minus = F.transform(F.coalesce(tokens("old_text"), F.array().cast("array<string>")),
                        lambda x: F.struct(x.alias("word"), F.lit(-1).alias("w")))
    return (revisions.select(*keep, F.explode(F.concat(plus, minus)).alias("__t"))
            .select(*keep, F.col("__t.word").alias("word"), F.col("__t.w").cast("long").alias("w")))


def merge_word_counts(state: DataFrame, delta: DataFrame) -> DataFrame:
    """``state (word, n)`` plus an aggregated ``delta (word, w)``, as a full
    outer join: with ``state`` bucketed by word only ``delta`` is shuffled,
    and every word of either side stays (0 included)."""
    return (state.join(delta, "word", "full")
            .select("word", (F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("w"), F.lit(0))).cast("long").alias("n")))


def apply_word_delta(base: DataFrame, signed: DataFrame, drop_zero: bool = False) -> DataFrame:
    """State plus the sum of weights per word (O6). Words are never removed
    unless ``drop_zero``: a count can reach 0 (or below) and stays."""
    merged = (base.select("word", F.col("n").cast("long").alias("n"))
              .unionByName(signed.select("word", F.col("w").cast("long").alias("n")))
              .groupBy("word").agg(F.sum("n").alias("n")))
    return merged.filter(F.col("n") != 0) if drop_zero else merged
