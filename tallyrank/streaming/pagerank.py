"""Streaming incremental PageRank.

Each micro-batch of ``op src dst [seq]`` lines is netted by ``seq`` and
applied to the graph state with the exact delta rule (``pagerank_delta``).
Version ``v=<batch>`` holds ``changes (src, dst, op)`` (the batch's net edge
changes, small), ``ranks (node, hist)`` bucketed by node and the batch's
``deltas``; ``edges`` snapshots are written only at ``v=-1`` (built from a
static edge table) and when the links are compacted. The edge set of any
version is its last snapshot plus the later change tables, so no batch
rewrites the edge table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import pagerank_delta
from ..operators.graph import net_updates, prepare_links
from ..operators.pagerank import pagerank_history
from ..sources.lines import parse_edge_updates
from . import state as S

INITIAL = -1
# Re-prepare the links once the overlay holds this share of all edges, and at
# the latest after so many batches, which bounds what a restart replays.
COMPACT_ABOVE = 0.2
COMPACT_EVERY = 50


RANKS_DDL = "node bigint, hist array<double>"


def init_graph_state(edges: DataFrame, state_dir: str, iters: int = 5, damping: float = 0.85,
                     track: S.VersionTracker | None = None) -> None:
    """Write version -1: the edge set and its ``keep='all'`` history. With ``track``
    the links prepared for it carry over to the runs that share it."""
    links = prepare_links(edges)
    hist = pagerank_history(links=links, iters=iters, damping=damping, keep="all")
    S.write_version(links.pairs, state_dir, INITIAL, "edges")
    S.write_version_bucketed(hist, state_dir, INITIAL, "node", links.partitions, "ranks")
    if track is not None:
        track.commit(edges.sparkSession, INITIAL, ("edges", "ranks"))
        track.keep_links(links)
        return
    S.commit_version(edges.sparkSession, state_dir, INITIAL, ("edges", "ranks"))
    links.unpersist()


def edges_at(spark, state_dir: str, v: int) -> DataFrame:
    """Edge set of version ``v``: the newest snapshot at or before it plus the
    change tables after the snapshot (last change per edge wins)."""
    done = S.committed_tables(spark, state_dir)
    vs = sorted({x for x, _ in done if x <= v})
    snap = max(x for x, t in done if t == "edges" and x <= v)
    later = [x for x in vs if x > snap]
    base = S.read_version(spark, state_dir, snap, "edges")
    if not later:
        return base
    ch = None
    for x in later:
        c = S.read_version(spark, state_dir, x, "changes").select(F.lit(x).alias("seq"), "op", "src", "dst")
        ch = c if ch is None else ch.unionByName(c)
    from ..operators.graph import apply_edge_updates
    return apply_edge_updates(base, ch)


def ranks_at(spark, state_dir: str, v: int, buckets: int) -> DataFrame:
    return S.read_version_bucketed(spark, state_dir, v, "node", buckets, RANKS_DDL, "ranks")


def stream_pagerank(lines: DataFrame, state_dir: str, checkpoint: str, iters: int = 5, damping: float = 0.85,
                    trigger: dict | None = None, name: str | None = None,
                    compact_above: float = COMPACT_ABOVE, compact_every: int = COMPACT_EVERY, strict: bool = False,
                    track: S.VersionTracker | None = None, keep: int | None = None) -> StreamingQuery:
    """Keep the graph's rank history current under a stream of edge updates.

    Within one run, or the runs that share ``track``, the prepared links carry over from batch to batch: each
    batch adds its changed sources to the links' overlay, an O(changes)
    step. The links are prepared again only when the run starts (from the
    last committed version), when the overlay holds more than
    ``compact_above`` of all edges, and at every ``compact_every``-th batch. Malformed lines go to ``state.rejects``;
    ``strict`` makes them an error. ``keep`` versions stay, and those an edge set
    among them builds on (all, if None)."""
    tagged = lines.select("value", F.col("_metadata.file_modification_time").alias("__t"))
    track = track or S.VersionTracker(state_dir)

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrival = F.struct("__t", F.monotonically_increasing_id().alias("i"))
        batch, bad = parse_edge_updates(batch, seq=arrival, with_rejects=True)
        S.keep_rejects(bad, state_dir, batch_id, strict)
        prev = track.before(spark, batch_id)
        if prev is None:
            raise RuntimeError(f"no graph state under {state_dir}; call init_graph_state first")
        if track.links is None or track.last != prev:
            track.keep_links(prepare_links(edges_at(spark, state_dir, prev)))
        links = track.links
        hist = ranks_at(spark, state_dir, prev, links.partitions)
        S.begin_version(spark, state_dir, batch_id)
        S.write_version(net_updates(batch), state_dir, batch_id, "changes")
        net = S.read_version(spark, state_dir, batch_id, "changes").select(F.lit(0).alias("seq"), "op", "src", "dst")
        res = pagerank_delta(None, net, hist, iters, damping, links_old=links)
        S.write_version_bucketed(res.history(hist), state_dir, batch_id, "node", links.partitions, "ranks")
        S.write_version(res.delta, state_dir, batch_id, "deltas")
        nxt, tables = res.links, ("changes", "ranks", "deltas")
        if (nxt.n_over_edges > compact_above * max(nxt.n_edges, 1)) or (batch_id + 1) % compact_every == 0:
            S.write_version(nxt.edges(), state_dir, batch_id, "edges")      # snapshot
            nxt, tables = prepare_links(S.read_version(spark, state_dir, batch_id, "edges")), (*tables, "edges")
        track.commit(spark, batch_id, tables)
        track.keep_links(nxt)
        S.retire(spark, state_dir, keep, "edges")

    w = tagged.writeStream.foreachBatch(S.read_once(fold)).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return w.trigger(**(trigger or {"availableNow": True})).start()
