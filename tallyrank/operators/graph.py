"""Edge-list operators (O9, O10, O13, O14, O17) and the prepared link table
that the rank iterations join against.

Layout of the prepared links (``prepare_links``):

* ``cold``: edges of sources with out-degree <= ``split_above``, with weight
  ``w = 1 / outdeg(src)``, hash-partitioned by ``src`` into ``P`` partitions and
  sorted by ``src`` inside each. A rank vector hash-partitioned by node joins
  it without moving any edge.
* ``hot``: edges of sources above the bound (one source may hold a third of
  all edges). They are spread round-robin, and the rank of each hot source
  reaches them by a broadcast of at most ``n_hot`` rows. With the default
  bound ``max(2000, E / (4 P))`` there are at most ``4 P`` hot sources.
* ``nodes``: every node with an edge, hash-partitioned by ``node`` like ``cold``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import BROADCAST_MAX_ROWS, broadcast_if_small, cut_lineage, cut_lineage_bucketed, shuffle_partitions

MIN_SPLIT = 2000


def dedupe(edges: DataFrame) -> DataFrame:
    """Edges as a set (self-loops kept). The partial aggregate drops repeats
    map-side, so a pair repeated a billion times costs one row per task."""
    return edges.select("src", "dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Deduplicated adjacency (O9), kept flat as ``(src, dst)`` rows.

    A list per node would put a hot node's whole neighbour list in one row;
    ``adjacency_text`` builds that form only for export."""
    return dedupe(edges)


def adjacency_text(edges: DataFrame) -> DataFrame:
    """``(node, neighbors)`` with neighbours space-joined, as the reference's
    ``links`` table stores them. Each row holds one node's whole list, so use
    it for export of graphs without huge out-degrees only."""
    return (dedupe(edges).groupBy(F.col("src").alias("node"))
            .agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("dst")),
                                              lambda x: x.cast("string"))).alias("neighbors")))


def out_degree(edges: DataFrame) -> DataFrame:
    """``(node, outdeg)`` over deduplicated edges."""
    return dedupe(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdeg"))


def number_nodes(edges: DataFrame, partitions: int | None = None,
                 number: Callable[[str], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame] | None:
    """``(edges, names)`` with numbers for the names of text nodes: iterations then
    shuffle, sort and compare 8 bytes a node. A name's number is its 64-bit hash, so
    no edge is joined; ``names (node, name)``, bucketed by number, has each name
    once. None if nodes are no text, or if two names share a number (checked over
    all names), when the caller goes on with the names. Null stays null."""
    if any(edges.schema[c].dataType != StringType() for c in ("src", "dst")):
        return None
    p = partitions or shuffle_partitions(edges.sparkSession)

    def no(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), number(c))
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    names = cut_lineage_bucketed(names.select(no("name").alias("node"), "name").repartition(p, "node"), "node", p, "names")
    if names.groupBy("node").count().filter(F.col("count") > 1).limit(1).collect():
        return None
    return edges.select(no("src").alias("src"), no("dst").alias("dst")), names


def no_incoming(edges: DataFrame) -> DataFrame:
    """Sources that no edge points to (O10): ``(node)``."""
    e = edges.select("src", "dst")
    return (e.select(F.col("src").alias("node")).distinct()
            .join(e.select(F.col("dst").alias("node")), "node", "left_anti"))


def rows_of(table: DataFrame, key: str, nodes: DataFrame, few: int = 0) -> DataFrame:
    """Rows of ``table`` whose ``key`` is in ``nodes.node``.

    At most ``few`` nodes become literals of a filter, so that a scan of a table
    bucketed by ``key`` opens only their buckets (and of these only the row groups
    that can hold them); more nodes meet the table in a semi-join."""
    wanted = nodes.select(F.col("node").alias(key)).filter(F.col(key).isNotNull()).distinct()
    if few:
        found = [r[0] for r in wanted.limit(few + 1).collect()]     # few + 1 keys at most
        if len(found) <= few:
            return table.filter(F.col(key).isin(found))
    return table.join(wanted, key, "left_semi")


def neighbors(edges: DataFrame, nodes: DataFrame, few: int = 0) -> DataFrame:
    """Out-neighbours of a set of nodes (O13): ``(src, dst)`` for ``src`` in
    ``nodes.node``; an unknown node has none. ``few`` as in :func:`rows_of`, for
    edges saved in buckets."""
    return dedupe(rows_of(edges.select("src", "dst"), "src", nodes, few))


def join_by_source(edges: DataFrame, values: DataFrame, n_values: int, split_above: int,
                   max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``edges`` inner-joined on ``src`` with ``values``, which has a row for each
    source (``n_values`` counted or bounded by a count).

    Up to ``max_broadcast`` values are broadcast. Beyond that the sources with more
    than ``split_above`` edges (at most E / split_above of them) get theirs by
    broadcast, so their edges stay where they are, and only the others are
    shuffled by source: no task is dealt a hot source's edges."""
    if n_values <= max_broadcast:
        return edges.join(F.broadcast(values), "src")
    many = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
                       .filter(F.col("n") > split_above).select("src"))
    n_many = many.count()
    hot = broadcast_if_small(many, n_many)
    hot_values = broadcast_if_small(values.join(hot, "src", "left_semi"), n_many)
    return (edges.join(hot_values, "src")
            .unionByName(edges.join(hot, "src", "left_anti").join(values.hint("shuffle_merge"), "src")))


def frontier(edges: DataFrame, nodes: DataFrame, hops: int = 1) -> DataFrame:
    """Distinct nodes reached from ``nodes`` in exactly ``hops`` steps."""
    e = edges.select("src", "dst")
    cur = nodes.select("node").distinct()
    for _ in range(hops):
        cur = (e.join(cur.select(F.col("node").alias("src")), "src", "left_semi")
               .select(F.col("dst").alias("node")).distinct())
    return cur


def net_updates(updates: DataFrame) -> DataFrame:
    """Last op per edge by ``seq`` (``max_by`` combines map-side): ``(src, dst, op)``."""
    return updates.groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))


def apply_edge_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Edge set after a changelog (O14): per ``(src, dst)`` the last op wins;
    1 adds (no duplicate), -1 removes. Equal to applying the ops one by one."""
    net = net_updates(updates)
    kept = dedupe(edges).join(net.select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.unionByName(net.filter(F.col("op") == 1).select("src", "dst"))


@dataclass
class Links:
    cold: DataFrame
    hot: DataFrame | None
    hot_nodes: DataFrame | None
    n_hot: int
    nodes: DataFrame
    sources: DataFrame | None   # None once overlaid: see ``source_nodes``
    partitions: int
    n_edges: int
    split_above: int
    held: tuple[DataFrame, ...] = ()    # everything persisted by ``prepare_links``
    # Overlay: sources changed since preparation and their current weighted
    # out-edges. They replace those sources' rows of ``cold`` / ``hot``, so a
    # change log updates the links in O(changes) without moving the base.
    over_src: DataFrame | None = None
    over_edges: DataFrame | None = None
    n_over: int = 0
    n_over_edges: int = 0
    pairs: DataFrame | None = None      # the deduplicated edges as prepared, null ends too; None once overlaid

    def unpersist(self) -> None:
        for df in self.held:
            df.unpersist()

    def source_nodes(self) -> DataFrame:
        """Nodes with an out-edge. Overlaid links read them from the edges (the
        explicit exchange keeps ``distinct`` right over a union of tables that
        are already partitioned)."""
        if self.sources is not None:
            return self.sources
        return self.edges().select(F.col("src").alias("node")).repartition(self.partitions, "node").distinct()

    @property
    def reuses_input(self) -> bool:
        """True when ``spread`` reads its input more than once (hot part or
        overlay), so an iterative caller should checkpoint every step."""
        return self.n_hot > 0 or self.over_src is not None

    def _over_b(self) -> DataFrame:
        return broadcast_if_small(self.over_src, self.n_over)

    def edges(self) -> DataFrame:
        """The current deduplicated edge set ``(src, dst)`` (no shuffle)."""
        e = self.cold.select("src", "dst")
        e = e if self.hot is None else e.unionByName(self.hot.select("src", "dst"))
        if self.over_src is None:
            return e
        return (e.join(self._over_b().withColumnRenamed("node", "src"), "src", "left_anti")
                .unionByName(self.over_edges.select("src", "dst")))

    def spread(self, vals: DataFrame, cols: list[str]) -> DataFrame:
        """``sum(x * w)`` per ``dst`` over the out-edges of each node of
        ``vals(node, *cols)``: ``(node, *cols)`` of the targets.

        The cold part joins without moving edges; the hot part broadcasts the
        values of at most ``n_hot`` hot sources; overlay sources (at most
        ``n_over`` values, broadcast) meet their current edges. The partial
        aggregate before the shuffle leaves one row per target per task."""
        v = vals.select("node", *cols)
        times_w = [(F.col(c) * F.col("w")).alias(c) for c in cols]
        parts = []
        if self.over_src is not None:
            ob = self._over_b()
            vo = broadcast_if_small(v.join(ob, "node", "left_semi"), self.n_over)
            parts.append(self.over_edges.join(vo, self.over_edges.src == vo.node).select(F.col("dst"), *times_w))
            v = v.join(ob, "node", "left_anti")
        parts.append(v.join(self.cold, v.node == self.cold.src).select(F.col("dst"), *times_w))
        if self.n_hot:
            hv = broadcast_if_small(v.join(F.broadcast(self.hot_nodes), "node", "left_semi"), self.n_hot)
            parts.append(self.hot.join(hv, self.hot.src == hv.node).select(F.col("dst"), *times_w))
        u = parts[0]
        for q in parts[1:]:
            u = u.unionByName(q)
        return u.groupBy(F.col("dst").alias("node")).agg(*[F.sum(c).alias(c) for c in cols])

    def with_overlay(self, changed: DataFrame, new_edges: DataFrame, nodes: DataFrame, n_edges: int,
                     n_changed: int, n_new_edges: int) -> "Links":
        """Links after the sources ``changed (node)`` got the out-edges
        ``new_edges (src, dst, w)`` (both materialised, with their row counts);
        ``nodes`` is the new node set."""
        from dataclasses import replace

        from ..session import cut_lineage
        if self.over_src is None:
            return replace(self, over_src=changed, over_edges=new_edges, n_over=n_changed,
                           n_over_edges=n_new_edges, nodes=nodes, sources=None, n_edges=n_edges, pairs=None)
        cb = broadcast_if_small(changed, n_changed)
        osrc = cut_lineage(self.over_src.unionByName(changed).distinct())
        oedges = cut_lineage(self.over_edges.join(cb.withColumnRenamed("node", "src"), "src", "left_anti")
                             .unionByName(new_edges))
        return replace(self, over_src=osrc, over_edges=oedges, n_over=osrc.count(),
                       n_over_edges=oedges.count(), nodes=nodes, sources=None, n_edges=n_edges)


def prepare_links(edges: DataFrame, split_above: int | None = None, partitions: int | None = None,
                  level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Links:
    """Deduplicate, weight and lay out edges for rank iterations (see module doc)."""
    spark = edges.sparkSession
    p = partitions or shuffle_partitions(spark)
    e = dedupe(edges).persist(level)
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg")).persist(level)      # a row per source, read four times
    st = deg.agg(F.sum("outdeg").alias("e"), F.max("outdeg").alias("m")).first()
    n_edges, max_deg = int(st["e"] or 0), int(st["m"] or 0)
    t = split_above or max(MIN_SPLIT, math.ceil(n_edges / (4 * p)))

    hot = hot_nodes = None
    n_hot = 0
    held = [e, deg]
    if max_deg > t:
        hot_deg = deg.filter(F.col("outdeg") > t).persist(level)
        n_hot = hot_deg.count()
        hd = broadcast_if_small(hot_deg, n_hot)
        hot = (e.join(hd, "src").select("src", "dst", (F.lit(1.0) / F.col("outdeg")).alias("w"))
               .repartition(p).persist(level))
        held += [hot_deg, hot]
        hot_nodes = hot_deg.select(F.col("src").alias("node"))
        cold_e = e.join(broadcast_if_small(hot_deg.select("src"), n_hot), "src", "left_anti")
        cold_deg = deg.filter(F.col("outdeg") <= t)
    else:
        cold_e, cold_deg = e, deg

    cold = (cold_e.repartition(p, "src").join(cold_deg.repartition(p, "src"), "src")
            .select("src", "dst", (F.lit(1.0) / F.col("outdeg")).alias("w"))
            .sortWithinPartitions("src").persist(level))
    nodes = (deg.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
             .distinct().repartition(p, "node").persist(level))
    sources = deg.select(F.col("src").alias("node")).repartition(p, "node").persist(level)
    # The tables fill on first use; the deduplicated edges stay cached until
    # then (``Links.unpersist`` releases everything).
    return Links(cold, hot, hot_nodes, n_hot, nodes, sources, p, n_edges, t, held=(*held, cold, nodes, sources), pairs=e)
