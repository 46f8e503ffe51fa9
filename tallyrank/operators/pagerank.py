"""PageRank with a fixed number of iterations (O11), its per-iteration
history (O12), point reads (O18) and zero deltas (O21).

Ranks are not normalised: ``r_0 = 1`` for every node and
``r_k[v] = (1 - d) + d * sum(r_{k-1}[u] / outdeg(u))`` over the edges ``u -> v``.
A node without incoming edges gets ``1 - d``; a node without outgoing edges
receives rank and passes none on.

Each iteration costs one shuffle: the contributions' partial aggregate.
The rank vector stays hash-partitioned by node, the same layout as the
prepared links, so no edge moves. Every ``checkpoint_every``-th vector is
written to the shared checkpoint folder as a table bucketed by node: the plan
of the next iterations starts from that flat table, a lost executor recomputes
at most that many iterations, and the scan keeps the node layout, so the vector
is not shuffled either (``checkpoint()`` under AQE forgets the layout). An
iteration whose plan uses the previous vector twice (history carried along,
survivors, hot sources, overlay) caches it between those tables, else the plan
would double per iteration; what a lost executor had cached is computed again
from the last table.

Text nodes get numbers for the iterations and their names back at the end
(``graph.number_nodes``).

A call that prepares its own links writes its result too and releases the
links; with ``links`` given they stay the caller's and the result is lazy.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage_bucketed
from .graph import Links, number_nodes, prepare_links, rows_of

CHECKPOINT_EVERY = 4


class _Stepper:
    """Materialise an iteration's vector every ``every`` iterations as a table
    bucketed by node (same layout as the links, so the next join moves nothing).
    With ``twice`` the next iteration reads the vector two times: those between
    are cached, and computed again from the last table if an executor is lost."""

    def __init__(self, links: Links, checkpoint_every: int | None, twice: bool = False):
        self.links = links
        self.every = checkpoint_every
        self.twice = twice
        self.cached: list[DataFrame] = []

    def __call__(self, df: DataFrame, k: int) -> DataFrame:
        if self.every and k % self.every == 0:
            return self.keep(df)
        if self.twice:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached.append(df)
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        return cut_lineage_bucketed(df, "node", self.links.partitions, "rank")


def _links(edges: DataFrame | None, links: Links | None) -> Links:
    return links if links is not None else prepare_links(edges)


def _finish(result: DataFrame, step: _Stepper, own: bool) -> DataFrame:
    if not own:
        step.links.held = (*step.links.held, *step.cached)      # released with the links
        return result
    result = step.keep(result)
    for df in step.cached:
        df.unpersist()
    step.links.unpersist()
    return result


def _named(result: DataFrame, names: DataFrame) -> DataFrame:
    """``result`` with names for numbers (both lie bucketed by number; null stays null)."""
    return result.join(names, "node", "left").select(F.col("name").alias("node"), *[c for c in result.columns if c != "node"])


def pagerank(edges: DataFrame | None = None, iters: int = 5, damping: float = 0.85,
             links: Links | None = None, checkpoint_every: int | None = CHECKPOINT_EVERY) -> DataFrame:
    """``(node, rank)`` after ``iters`` iterations for every node with an edge;
    ``iters = 0`` gives each source with rank 1.0."""
    if links is None and (numbered := number_nodes(edges)) is not None:
        return _named(pagerank(numbered[0], iters, damping, checkpoint_every=checkpoint_every), numbered[1])
    L = _links(edges, links)
    step = _Stepper(L, checkpoint_every, twice=L.reuses_input)
    if iters == 0:
        return _finish(L.source_nodes().select("node", F.lit(1.0).alias("rank")), step, links is None)
    ranks = L.nodes.select("node", F.lit(1.0).alias("rank"))
    for k in range(1, iters + 1):
        s = L.spread(ranks, ["rank"]).withColumnRenamed("rank", "s")
        ranks = (L.nodes.join(s, "node", "left")
                 .select("node", (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("rank")))
        if k < iters:
            ranks = step(ranks, k)
    return _finish(ranks, step, links is None)


def pagerank_history(edges: DataFrame | None = None, iters: int = 5, damping: float = 0.85,
                     keep: str = "survivors", links: Links | None = None,
                     checkpoint_every: int | None = CHECKPOINT_EVERY) -> DataFrame:
    """``(node, hist array<double>)`` with ``hist[k-1] = r_k`` for k = 1..iters.

    ``keep='survivors'`` is the reference's history: start from the sources
    and keep, at each iteration, only nodes that are still present and
    received a contribution (an inner join). ``keep='all'`` keeps every node
    with an edge; it is the linear history that ``pagerank_delta`` updates."""
    if keep not in ("survivors", "all"):
        raise ValueError("keep must be 'survivors' or 'all'")
    if links is None and (numbered := number_nodes(edges)) is not None:
        return _named(pagerank_history(numbered[0], iters, damping, keep, checkpoint_every=checkpoint_every), numbered[1])
    L = _links(edges, links)
    start = L.source_nodes() if keep == "survivors" else L.nodes
    ranks = start.select("node", F.lit(1.0).alias("rank"), F.array().cast("array<double>").alias("hist"))
    step = _Stepper(L, checkpoint_every, twice=True)
    how = "inner" if keep == "survivors" else "left"
    for k in range(1, iters + 1):
        s = L.spread(ranks, ["rank"]).withColumnRenamed("rank", "s")
        new = F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        ranks = (ranks.drop("rank").join(s, "node", how)
                 .select("node", new.alias("rank"), F.concat("hist", F.array(new)).alias("hist")))
        if k < iters:
            ranks = step(ranks, k)
    return _finish(ranks.select("node", "hist"), step, links is None)


def to_wide(history: DataFrame, iters: int, col: str = "hist", prefix: str = "i") -> DataFrame:
    """``node, i0 .. i{iters-1}`` (the reference's ``ranks`` / ``deltas`` tables)."""
    return history.select("node", *[F.get(F.col(col), i).alias(f"{prefix}{i}") for i in range(iters)])


def rank_at(history: DataFrame, nodes: DataFrame, it: int, col: str = "hist", few: int = 0) -> DataFrame:
    """Value of iteration column ``i{it}`` for each node of ``nodes`` (O18);
    nodes without a history row are absent. ``few`` as in ``graph.rows_of``, for a
    history saved in buckets."""
    return rows_of(history, "node", nodes, few).select("node", F.get(F.col(col), it).alias("rank"))


def zero_deltas(history: DataFrame, col: str = "hist") -> DataFrame:
    """Zero delta per node and iteration, the shape of the history."""
    return history.select("node", F.transform(F.col(col), lambda x: F.lit(0.0)).alias("delta"))
