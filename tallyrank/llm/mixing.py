"""Mixing sources to target weights over a time-varying curriculum.

Sizes are word counts. Sources, ranked by code point with null last, weigh
``weights`` in turn and share all words of the table; a target stops at
``cap`` times its source's size and the excess is reshared by weight until
none is above. That fixed point is found in closed form: with sources in
order of cap * size / weight, the capped ones are a prefix, and the rest
share what is left at one level.

Within a source documents form a stream in the order of a hash of their id;
the stream is read round after round until the target is met, so only the last
document read is cut, and none is read more than ``cap`` times. Every weight
class has a schedule, a piecewise linear rate over training time [0, 1]. Its
integral, scaled to the target, is the source's cumulative demand; inverting
it at the stream offset where a document starts gives the time it is due, and
the demand of all sources together at that time is its training position.

Running sums over a source are split by ranges of the hash: sums per range,
an offset per range, and a window inside each range only, so a source with
any share of all rows is spread over many tasks. Rows alike in id, source and
text are one row with a multiplicity until they get their positions.

Nulls: a null text has size 0, a null source is a source (ranked last), a null
id is an id. Documents of size 0, and those the mix does not reach, keep one
row with nothing taken and no position. Only built-in expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, cut

WEIGHTS = (5, 2, 1)
#: For each weight class the knots (time, rate): heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (0.7, 1.0), (1.0, 0.25)),
             ((0.0, 1.0), (1.0, 1.0)),
             ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)))
#: Rows of one hash range, on average.
RANGE_ROWS = 4_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``(source, source_size, class, target)`` from ``sizes (source, size, n)``;
    one row per source from here on, so its windows hold sources, not documents."""
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("class", (rank - 1) % len(weights))
    s = s.withColumns({"weight": F.get(F.array(*(F.lit(w) for w in weights)), F.col("class")),
                       "most": F.col("source_size") * cap, "total": F.sum("source_size").over(everything)})
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))))
    free = F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))
    # The first source that is not capped sets the level of all that are not.
    s = s.withColumn("level", F.first(free, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "class", F.least(
        F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def row_key(doc_id: str, source: str, text: str) -> Column:
    """The same for rows alike in id, source and text, nulls included."""
    cols = [F.col(c).cast("string") for c in (doc_id, source, text)]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start time, end time, rate there, slope, integral before), the whole integral scaled to 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, g0), (t1, g1) in zip(knots, knots[1:]):
        out.append((t0, t1, g0 / area, (g1 - g0) / area / (t1 - t0), done))
        done += (t1 - t0) * (g0 + g1) / 2 / area
    return out


def demand(t: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Share of a schedule's integral up to time ``t``."""
    total = F.lit(0.0)
    for t0, t1, g, slope, _ in _segments(knots):
        d = F.greatest(F.least(t, F.lit(t1)) - t0, F.lit(0.0))
        total = total + d * g + d * d * slope / 2
    return total


def due(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which ``share`` (0 to 1) of a schedule's integral is reached."""
    segments = _segments(knots)
    out = None
    for t0, t1, g, slope, before in reversed(segments):
        c = F.greatest(share - before, F.lit(0.0))
        # The root of slope/2 d^2 + g d = c that is stable for a slope of 0.
        root = F.sqrt(F.greatest(F.lit(g * g) + 2 * slope * c, F.lit(0.0)))
        d = F.when(c > 0, 2 * c / (g + root)).otherwise(F.lit(0.0))
        here = F.least(t0 + d, F.lit(t1))
        out = here if out is None else F.when(share >= last, out).otherwise(here)
        last = before
    return out


def curriculum(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
               weights: tuple[int, ...] = WEIGHTS, cap: int = 3, schedules=SCHEDULES,
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """Occurrences of documents in the mix, range-sorted by position: ``(doc_id,
    source, key, copy, size, source_size, target, epoch, start, taken, due, position)``.

    ``key`` tells rows with other texts apart, ``copy`` numbers rows alike in
    everything; ``start`` is the offset in the source's stream. A document not
    taken has one row with epoch 0, taken 0 and null position."""
    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
        .cast("long").alias("h"),
        row_key(doc_id, source, text).alias("key"))
    sizes = cut(words.groupBy("source", "h", "doc_id", "size", "key").agg(F.count(F.lit(1)).alias("n")))
    n_ranges = 1 << max(0, math.ceil(math.log2(max(1, sizes.count() / range_rows))))
    sizes = sizes.withColumn("range", F.floor(F.col("h") / F.lit((1 << 60) // n_ranges)))

    plan = cut(targets(sizes, weights, cap)).withColumnRenamed("source", "s")
    sums = sizes.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("sum"))
    before = sums.select(
        F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("sum").over(
            Window.partitionBy("source").orderBy("range")) - F.col("sum")).alias("before"))
    same = F.col("source").eqNullSafe(F.col("s"))
    stream = (sizes.join(before, same & (F.col("range") == F.col("r"))).drop("s", "r")
              .withColumn("first", F.col("before") + F.sum(F.col("size") * F.col("n")).over(
                  Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", "key"))
                  - F.col("size") * F.col("n"))
              .join(plan, same).drop("s"))
    stream = stream.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    at = F.col("first") + F.col("copy") * F.col("size")
    goal = F.floor("target")
    rounds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: F.struct(
        e.alias("epoch"), (e * F.col("source_size") + at).alias("start"),
        F.least(F.greatest(goal - (e * F.col("source_size") + at), F.lit(0)), F.col("size")).cast("long").alias("taken"))),
        lambda r: (r["taken"] > 0) | (r["epoch"] == 0))
    taken = stream.withColumn("r", F.explode(rounds)).select(
        "doc_id", "source", "key", "copy", "size", "source_size", "target", "class", "r.epoch", "r.start", "r.taken")
    # Demand per class of all sources together, on every row by way of the source's row.
    share = F.when((F.col("taken") > 0), F.least(F.col("start") / F.col("target"), F.lit(1.0)))
    when = None
    for i, knots in enumerate(schedules):
        mine = due(share, knots)
        when = mine if when is None else F.when(F.col("class") % len(schedules) == i, mine).otherwise(when)
    totals = plan.groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("class") % len(schedules) == i, F.col("target"))), F.lit(0.0))
                                  .alias(f"class_{i}") for i in range(len(schedules))))
    positions = sum((F.col(f"class_{i}") * demand(F.col("due"), k) for i, k in enumerate(schedules)), F.lit(0.0))
    read = F.col("taken") > 0
    placed = (taken.withColumn("due", F.when(read, when)).join(F.broadcast(totals))  # one row
              .withColumn("position", F.when(read, positions)).drop("class", *(f"class_{i}" for i in range(len(schedules)))))
    return placed.repartitionByRange("position", "doc_id", "key", "copy", "epoch").sortWithinPartitions(
        "position", "doc_id", "key", "copy", "epoch")


def in_order(docs: DataFrame, mix: DataFrame, doc_id: str = "doc_id", source: str = "source",
             text: str = "text") -> DataFrame:
    """The documents as training reads them: a row per occurrence with all
    columns of ``docs``, ``epoch``, ``taken`` (words of this reading) and
    ``position``, sorted by position over range partitions. Rows alike in id,
    source and text are one text read once per copy (other columns that differ
    between them come from any one). Columns of ``docs`` named ``epoch``, ``taken``
    or ``position`` are replaced."""
    used = mix.filter("taken > 0").select(*(F.col(c).alias(f"__{c}") for c in (
        "key", "doc_id", "source", "epoch", "taken", "position")))
    once = docs.withColumn("__row", row_key(doc_id, source, text)).dropDuplicates(["__row", doc_id, source])
    own = [c for c in docs.columns if c not in ("epoch", "taken", "position")]
    same = F.col(doc_id).eqNullSafe(F.col("__doc_id")) & F.col(source).eqNullSafe(F.col("__source"))
    rows = once.join(used, (F.col("__row") == F.col("__key")) & same).select(
        *own, *(F.col(f"__{c}").alias(c) for c in ("epoch", "taken", "position")))
    return rows.repartitionByRange("position", doc_id, "epoch").sortWithinPartitions("position", doc_id, "epoch")
