"""history(old) + delta == history(new) on random graphs and change logs."""

import random

import pytest

from pyspark.sql import functions as F

from tallyrank.operators import pagerank as PR
from tallyrank.operators.delta import pagerank_delta
from tallyrank.operators.graph import join_by_source


def hist_map(df, col="hist"):
    return {r.node: [round(x, 9) for x in r[col]] for r in df.collect()}


def test_hot_source_is_not_one_task(spark):
    """One source with half of all edges: no task holds more than twice the median."""
    edges = spark.range(16_000).repartition(8).select(
        F.when(F.col("id") < 8_000, F.lit(0)).otherwise(F.col("id") % 400 + 1).alias("src"), F.col("id").alias("dst"))
    values = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = join_by_source(edges, values, 401, split_above=1000, max_broadcast=0)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in edges.join(values, "src").collect())
        assert join_by_source(edges.limit(0), values, 401, 1000, 0).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {}), (3, {}), (1, {"max_broadcast": 0, "split_above": 3}),
                                       (2, {"max_broadcast": 0, "split_above": 100})])
def test_delta_equals_recompute(spark, seed, how):
    rnd = random.Random(seed)
    n = 12
    old = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(30)}
    ups, cur = [], set(old)
    for i in range(12):
        if cur and rnd.random() < 0.4:
            s, d = rnd.choice(sorted(cur))
            ups.append((i, -1, s, d))
            cur.discard((s, d))
        else:
            s, d = rnd.randrange(n + 3), rnd.randrange(n + 3)   # nodes may appear
            ups.append((i, 1, s, d))
            cur.add((s, d))
    e_old = spark.createDataFrame(sorted(old), "src long, dst long")
    e_new = spark.createDataFrame(sorted(cur) or [(0, 0)], "src long, dst long")
    upd = spark.createDataFrame(ups, "seq long, op int, src long, dst long")
    h_old = PR.pagerank_history(e_old, iters=4, keep="all")
    res = pagerank_delta(e_old, upd, h_old, iters=4, **how)
    assert sorted(tuple(r) for r in res.edges.collect()) == sorted(cur)
    want = hist_map(PR.pagerank_history(e_new, iters=4, keep="all"))
    assert hist_map(res.history(h_old)) == want
    fd = res.full_delta()                    # every node of either graph, once
    assert fd.count() == fd.select("node").distinct().count()


def test_chained_batches_reuse_overlaid_links(spark):
    """Three change batches applied through the links each delta returns."""
    rnd = random.Random(7)
    n = 10
    cur = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(25)}
    e = spark.createDataFrame(sorted(cur), "src long, dst long")
    hist = PR.pagerank_history(e, iters=3, keep="all")
    links, seq = None, 0
    for _ in range(3):
        ups = []
        for _ in range(6):
            if cur and rnd.random() < 0.5:
                s, d = rnd.choice(sorted(cur))
                ups.append((seq, -1, s, d))
                cur.discard((s, d))
            else:
                s, d = rnd.randrange(n + 2), rnd.randrange(n + 2)
                ups.append((seq, 1, s, d))
                cur.add((s, d))
            seq += 1
        upd = spark.createDataFrame(ups, "seq long, op int, src long, dst long")
        res = pagerank_delta(e if links is None else None, upd, hist, iters=3, links_old=links)
        hist, links = res.history(hist).checkpoint(), res.links
        assert sorted(tuple(r) for r in links.edges().collect()) == sorted(cur)
        fresh = spark.createDataFrame(sorted(cur), "src long, dst long")
        assert hist_map(hist) == hist_map(PR.pagerank_history(fresh, iters=3, keep="all"))
    # a full run on the overlaid links equals one on a fresh preparation
    want = {r.node: round(r.rank, 9) for r in PR.pagerank(fresh, iters=4).collect()}
    assert {r.node: round(r.rank, 9) for r in PR.pagerank(links=links, iters=4).collect()} == want


@pytest.mark.parametrize("ups, nodes, reads", [
    ([(1, 1, 1, 9), (2, -1, 7, 8)], [1, 2, 3, 4, 9], False),             # nothing leaves
    ([(1, -1, 3, 4), (2, -1, 1, 2), (3, 1, 4, 1)], [1, 2, 3, 4], True),   # 4 is added again, 2 keeps an edge, as does 3
    ([(1, -1, 3, 4), (2, 1, 5, 5)], [1, 2, 3, 5], True)])                # 4 leaves
def test_nodes_of_the_new_graph(spark, ups, nodes, reads, monkeypatch):
    """Only ends of removed pairs are looked for among the edges; without any the edges are not read."""
    from tallyrank.operators import delta
    seen, explode = [], F.explode
    monkeypatch.setattr(delta.F, "explode", lambda c: seen.append(c) or explode(c))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long")
    log = spark.createDataFrame(ups, "seq int, op int, src long, dst long")
    hist = PR.pagerank_history(edges, iters=2, keep="all")
    res = pagerank_delta(edges, log, hist, iters=2)
    assert sorted(r.node for r in res.nodes_new.collect()) == nodes
    assert bool(seen) == reads
