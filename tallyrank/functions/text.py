"""Column expressions for the JVM ``String.split`` contract and word tallies.

All of these are built-in Spark expressions (no Python UDF), so they run
inside the executors' JVM and, where Spark allows, inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Field separator of page lines: the unit separator, code point 31.
FIELD_SEP = "\u001f"
# Word separator: one U+0020 space; tab and newline stay inside words.
WORD_SEP = " "
# Edge-file separators: tab for string ids, any white space for integer ids.
TAB_SEP = "\t"
WS_SEP = r"\s+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_split(c: str | Column, regex: str) -> Column:
    """``String.split(regex)`` with limit 0: trailing empty fields dropped,
    ``""`` gives ``[""]`` and a non-empty string of separators only gives ``[]``.
    """
    s = _col(c)
    if regex in (WORD_SEP, FIELD_SEP, TAB_SEP):     # one plain character: no pattern runs over the text
        stripped = F.rtrim(s, F.lit(regex))
    else:
        stripped = F.regexp_replace(s, f"(?:{regex})+\\z", "")
    return (F.when(s == "", F.array(F.lit("")))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, regex)))


def tokens(c: str | Column) -> Column:
    """Words of a text exactly as ``text.split(" ")`` gives them."""
    return java_split(c, WORD_SEP)


def java_length(c: str | Column) -> Column:
    """``String.length()``: UTF-16 code units (a supplementary character counts 2)."""
    s = _col(c)
    return (F.length(s) + F.length(F.regexp_replace(s, "[^\\x{10000}-\\x{10FFFF}]", ""))).cast("long")


def with_row_counts(df: DataFrame, tokens_col: str | Column, out: str = "counts") -> DataFrame:
    """Add ``out: array<struct<word string, n bigint>>`` with the count of each
    distinct token of the row, computed inside the row (no shuffle).

    Sort the tokens, find where runs of equal words start, and take run
    lengths: O(n log n) per row, all JVM-side.
    """
    s, starts = "__tr_sorted", "__tr_starts"
    df = df.withColumn(s, F.sort_array(_col(tokens_col)))
    n = F.size(F.col(s))
    run_starts = F.filter(F.sequence(F.lit(0), n - 1),
                          lambda i: (i == 0) | (F.get(F.col(s), i) != F.get(F.col(s), i - 1)))
    df = df.withColumn(starts, F.when(n == 0, F.array().cast("array<int>")).otherwise(run_starts))
    counts = F.transform(
        F.col(starts),
        lambda p, j: F.struct(
            F.get(F.col(s), p).alias("word"),
            (F.coalesce(F.get(F.col(starts), j + 1), n) - p).cast("long").alias("n")))
    return df.withColumn(out, counts).drop(s, starts)


def adjacent_pairs(tokens_col: str | Column) -> Column:
    """``array<struct<src, dst>>`` of each token and the one after it.

    Give a column: of an expression each of the four uses below is evaluated
    on its own. ``arrays_zip`` of two slices is compiled, a lambda is not."""
    t = _col(tokens_col)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    return F.arrays_zip(F.slice(t, 1, m).alias("src"), F.slice(t, 2, m).alias("dst"))
