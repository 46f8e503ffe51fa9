"""Exact incremental PageRank (O15, O16, O19): update a rank history after an
edge changelog without recomputing it.

With ``r_0 = 1`` for every node, ``r_k = (1-d) + d * M^T r_{k-1}``, old edges
E, new edges E' and T the sources whose out-edge set changed::

    delta_0 = 0
    delta_k[v] = d * ( sum_{u in T, (u,v) in E'} r_{k-1}[u] / outdeg'(u)
                     - sum_{u in T, (u,v) in E } r_{k-1}[u] / outdeg(u)
                     + sum_{(u,v) in E'}       delta_{k-1}[u] / outdeg'(u) )

so ``history(E) + delta == history(E')``. A node missing from a graph counts
as isolated (``r_k = 1 - d`` for k >= 1). The first two sums are the seed:
one join of T's old and new out-edges with T's old ranks, all iterations at
once. The third sum is the propagation; it reuses the old prepared links
for every source outside T (same edges, same weights) and T's new
out-edges for sources in T, so no part of the edge table is rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_ROWS, broadcast_if_small, cut_lineage, cut_lineage_bucketed
from .graph import Links, join_by_source, net_updates, prepare_links


@dataclass
class DeltaResult:
    edges: DataFrame      # E' as (src, dst)
    changed: DataFrame    # T as (node)
    delta: DataFrame      # (node, delta array<double>), nodes reached; others are 0
    nodes_old: DataFrame  # nodes of E
    nodes_new: DataFrame  # nodes of E'
    links: Links          # prepared links of E' (old base + overlay)
    iters: int
    damping: float

    def history(self, history_old: DataFrame) -> DataFrame:
        """New ``(node, hist)`` for every node of E' (``keep='all'``)."""
        iso = _isolated(self.iters, self.damping)
        zero = F.array_repeat(F.lit(0.0), self.iters)
        return (self.nodes_new.join(history_old, "node", "left").join(self.delta, "node", "left")
                .select("node", F.zip_with(F.coalesce("hist", iso), F.coalesce("delta", zero),
                                           lambda a, b: a + b).alias("hist")))

    def full_delta(self) -> DataFrame:
        """Delta for every node of the old or the new graph (zeros included)."""
        zero = F.array_repeat(F.lit(0.0), self.iters)
        # A join, not union + distinct: Spark 4.1 plans a union of a cached
        # and a bucketed table, both hash-partitioned by node, as partitioned
        # and then skips the shuffle the distinct needs (duplicates survive).
        nodes = self.nodes_old.join(self.nodes_new, "node", "full").select("node")
        return nodes.join(self.delta, "node", "left").select("node", F.coalesce("delta", zero).alias("delta"))


def _isolated(iters: int, damping: float):
    return F.array_repeat(F.lit(1.0 - damping), iters)


def _endpoints(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("node"))
            .unionByName(edges.select(F.col("dst").alias("node"))).distinct())


def pagerank_delta(edges_old: DataFrame | None, updates: DataFrame, history_old: DataFrame,
                   iters: int = 5, damping: float = 0.85, links_old: Links | None = None,
                   max_broadcast: int = BROADCAST_MAX_ROWS, split_above: int | None = None) -> DeltaResult:
    """Delta of the ``keep='all'`` history after applying ``updates``
    ``(seq, op, src, dst)`` to ``edges_old``; ``history_old`` is ``(node, hist)``
    with ``hist[k-1] = r_k`` of the old graph.

    Every lookup of changed pairs scans the edge table with a broadcast of
    the net change log (row count checked), so no edge is shuffled. With more than
    ``max_broadcast`` changed sources their rows meet the edges by ``join_by_source``,
    which deals no source of more than ``split_above`` edges (default: the links'
    bound) to one task. The small
    intermediates are checkpointed: the plans that follow start from flat
    tables, and a lost executor does not recompute the change log. The
    result carries the new graph's links (``DeltaResult.links``): the old
    base plus an overlay for the changed sources, ready for the next batch."""
    L = links_old if links_old is not None else prepare_links(edges_old)
    e_old = L.edges()
    net = cut_lineage(net_updates(updates))
    n_net = net.count()
    pairs = broadcast_if_small(net.select("src", "dst"), n_net)

    def meet(edges: DataFrame, values: DataFrame, n_values: int, small: DataFrame) -> DataFrame:
        """``small``: the same join for values that can be broadcast."""
        if n_values <= max_broadcast:
            return small
        return join_by_source(edges, values, n_values, split_above or L.split_above, max_broadcast)

    adds = net.filter(F.col("op") == 1).select("src", "dst")
    # One scan of E: the out-edges of every source the change log names.
    named = net.select("src").distinct()
    near = cut_lineage(meet(e_old, named, n_net, e_old.join(broadcast_if_small(named, n_net), "src", "left_semi")))
    present = near.join(pairs, ["src", "dst"], "left_semi")                       # changed pairs in E
    removed = present.join(net.filter(F.col("op") == -1).select("src", "dst"), ["src", "dst"], "left_semi")
    added = adds.join(present, ["src", "dst"], "left_anti")

    changed = cut_lineage(removed.select(F.col("src").alias("node"))
                          .unionByName(added.select(F.col("src").alias("node"))).distinct())
    n_changed = changed.count()
    t_src = broadcast_if_small(changed.select(F.col("node").alias("src")), n_changed)

    old_t = meet(near, t_src, n_changed, near.join(t_src, "src", "left_semi"))
    adds_t = meet(adds, t_src, n_changed, adds.join(t_src, "src", "left_semi"))
    new_t = old_t.join(pairs, ["src", "dst"], "left_anti").unionByName(adds_t)
    w_old = old_t.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    w_new = new_t.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    new_t_w = cut_lineage(meet(new_t, w_new, n_changed, new_t.join(w_new, "src")).select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("w")))
    signed = (meet(old_t, w_old, n_changed, old_t.join(w_old, "src")).select("src", "dst", (F.lit(-1.0) / F.col("deg")).alias("sw"))
              .unionByName(new_t_w.select("src", "dst", F.col("w").alias("sw"))))

    # Nodes of E': old nodes minus those left without an edge, plus new ones. Ends of
    # added pairs have an edge; only other ends of removed pairs can leave: the
    # edges of these, met by one scan, tell (counted; none: no scan).
    linked = _endpoints(adds).filter(F.col("node").isNotNull())
    loose = cut_lineage(_endpoints(removed).join(linked, "node", "left_anti"))
    n_loose = loose.count()
    if n_loose:
        ends = e_old.select("src", "dst", F.explode(F.array("src", "dst")).alias("node"))
        still = (ends.join(broadcast_if_small(loose, n_loose), "node", "left_semi")
                 .join(pairs, ["src", "dst"], "left_anti").select("node").distinct())
        left = cut_lineage(loose.join(still, "node", "left_anti"))
        old_nodes = L.nodes.join(broadcast_if_small(left, n_loose), "node", "left_anti")
    else:
        old_nodes = L.nodes
    fresh = linked.join(L.nodes, "node", "left_anti")
    nodes_new = old_nodes.unionByName(fresh)
    nodes_new = cut_lineage_bucketed(nodes_new, "node", L.partitions, "nodes")
    cnt = (old_t.select(F.lit(-1).alias("c")).unionByName(new_t_w.select(F.lit(1).alias("c")))
           .agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("new"),
                F.sum(F.when(F.col("c") < 0, 1).otherwise(0)).alias("old")).first())   # one job, two counts
    n_new_t_w, n_old_t = int(cnt["new"] or 0), int(cnt["old"] or 0)
    n_edges_new = L.n_edges - n_old_t + n_new_t_w
    L_new = L.with_overlay(changed, new_t_w, nodes_new, n_edges_new,
                           n_changed=n_changed, n_new_edges=n_new_t_w)

    # Old r_0 .. r_{K-1} of each changed source (r_0 = 1; isolated if new).
    # The history is met by a broadcast of T, so it is read where it lies.
    iso = _isolated(iters, damping)
    known = history_old.join(broadcast_if_small(changed, n_changed), "node", "left_semi")
    r_t = (changed.join(known, "node", "left")
           .select("node", F.concat(F.array(F.lit(1.0)), F.slice(F.coalesce("hist", iso), 1, iters - 1)).alias("r"))
           if iters > 1 else changed.select("node", F.array(F.lit(1.0)).alias("r")))
    seed = cut_lineage(
        meet(signed, r_t.withColumnRenamed("node", "src"), n_changed,
             signed.join(broadcast_if_small(r_t, n_changed), signed.src == r_t.node))
        .groupBy(F.col("dst").alias("node"))
        .agg(*[F.sum(F.get(F.col("r"), j) * F.col("sw")).alias(f"s{j}") for j in range(iters)]))

    d = F.lit(damping)
    cur = seed.select("node", (d * F.col("s0")).alias("x"))      # seed is already a flat table
    per_iter = [cur.select("node", F.lit(0).alias("k"), "x")]
    for k in range(1, iters):
        sp = L_new.spread(cur, ["x"]).withColumnRenamed("x", "p")
        cur = cut_lineage(seed.select("node", F.col(f"s{k}").alias("s")).join(sp, "node", "full")
                          .select("node", (d * (F.coalesce("s", F.lit(0.0)) + F.coalesce("p", F.lit(0.0)))).alias("x")))
        per_iter.append(cur.select("node", F.lit(k).alias("k"), "x"))

    allk = per_iter[0]
    for p in per_iter[1:]:
        allk = allk.unionByName(p)
    delta = (allk.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"))
             .select("node", F.transform(F.sequence(F.lit(0), F.lit(iters - 1)),
                                         lambda j: F.coalesce(F.col("m")[j], F.lit(0.0))).alias("delta")))
    return DeltaResult(L_new.edges(), changed, delta, L.nodes, nodes_new, L_new, iters, damping)
