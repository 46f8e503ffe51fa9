"""Edge operators and PageRank on hand-worked graphs."""

import pytest

from tallyrank.operators import graph as G
from tallyrank.operators import pagerank as PR

EDGES = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5), (1, 2)]


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def ranks(df):
    return {r.node: round(r.rank, 9) for r in df.collect()}


def test_degree_anti_neighbors_frontier(spark):
    e = edges_df(spark, EDGES)
    assert {r.node: r.outdeg for r in G.out_degree(e).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    assert [r.node for r in G.no_incoming(e).collect()] == [4]
    nodes = spark.createDataFrame([(1,), (9,)], "node long")
    assert sorted(tuple(r) for r in G.neighbors(e, nodes).collect()) == [(1, 2), (1, 3)]
    assert sorted(r.node for r in G.frontier(e, nodes, 2).collect()) == [1, 3, 5]
    assert G.adjacency(e).count() == 6
    assert {r.node: r.neighbors for r in G.adjacency_text(e).collect()}[1] == "2 3"


def test_pagerank_one_iteration(spark):
    got = ranks(PR.pagerank(edges_df(spark, EDGES), iters=1))
    assert got == {1: 0.575, 2: 0.575, 3: 2.275, 4: 0.15, 5: 0.575}


def test_pagerank_zero_iterations_gives_sources(spark):
    assert ranks(PR.pagerank(edges_df(spark, EDGES), iters=0)) == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_history_survivors_after_one_iteration(spark):
    h = PR.pagerank_history(edges_df(spark, EDGES), iters=1, keep="survivors")
    assert sorted(r.node for r in h.collect()) == [1, 2, 3]


def test_self_loop_and_dangling(spark):
    e = edges_df(spark, [(7, 7)])
    # a self-loop keeps its rank: r = 0.15 + 0.85 r, starting at 1
    assert ranks(PR.pagerank(e, iters=3)) == {7: 1.0}
    e2 = edges_df(spark, [(1, 2)])
    assert ranks(PR.pagerank(e2, iters=2)) == {1: 0.15, 2: round(0.15 + 0.85 * 0.15, 9)}


@pytest.mark.parametrize("split_above", [1, 2])
def test_hot_source_split_matches_plain(spark, split_above):
    rows = [(0, i) for i in range(1, 40)] + [(i, (i * 7) % 40) for i in range(1, 40)] + [(5, 0), (6, 0)]
    e = edges_df(spark, rows)
    plain = PR.pagerank(e, iters=4)
    links = G.prepare_links(e, split_above=split_above)
    assert links.n_hot > 0
    split = PR.pagerank(links=links, iters=4)
    assert ranks(plain) == ranks(split)
    h1 = PR.pagerank_history(e, iters=3, keep="all").collect()
    h2 = PR.pagerank_history(links=links, iters=3, keep="all").collect()
    assert {r.node: [round(x, 9) for x in r.hist] for r in h1} == {r.node: [round(x, 9) for x in r.hist] for r in h2}


def test_checkpoint_cadence_does_not_change_ranks(spark):
    e = edges_df(spark, EDGES)
    assert ranks(PR.pagerank(e, iters=6, checkpoint_every=1)) == ranks(PR.pagerank(e, iters=6, checkpoint_every=None))


def test_apply_edge_updates_cases(spark):
    e = edges_df(spark, [(1, 2), (1, 3), (2, 3)])
    ups = spark.createDataFrame(
        [(1, -1, 2, 3),          # delete of a node's last edge
         (2, 1, 1, 2),           # add of an existing edge
         (3, 1, 3, 4), (4, -1, 3, 4),   # add then delete in one batch: absent
         (5, 1, 1, 9)],          # edge to a new node
        "seq long, op int, src long, dst long")
    got = sorted(tuple(r) for r in G.apply_edge_updates(e, ups).collect())
    assert got == [(1, 2), (1, 3), (1, 9)]


def test_rank_at_and_zero_deltas(spark):
    e = edges_df(spark, EDGES)
    h = PR.pagerank_history(e, iters=2, keep="all")
    at = {r.node: round(r.rank, 9) for r in PR.rank_at(h, spark.createDataFrame([(3,), (8,)], "node long"), 0).collect()}
    assert at == {3: 2.275}
    z = PR.zero_deltas(h).collect()
    assert all(r.delta == [0.0, 0.0] for r in z)
    assert PR.to_wide(h, 2).columns == ["node", "i0", "i1"]


def test_written_vectors_leave_no_catalog_entry_and_no_cache(spark):
    import tallyrank.operators.delta as D
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    e = edges_df(spark, EDGES + [(5, 1), (2, 4)])
    tables, before = len(spark.catalog.listTables()), cached()
    links = G.prepare_links(e)
    lazy = ranks(PR.pagerank(links=links, iters=6, checkpoint_every=None))
    links.unpersist()
    assert ranks(PR.pagerank(e, iters=6, checkpoint_every=1)) == lazy
    h = PR.pagerank_history(e, iters=3, keep="all")
    assert (len(spark.catalog.listTables()), cached()) == (tables, before)
    ups = spark.createDataFrame([(0, -1, 3, 5), (1, 1, 6, 1)], "seq long, op int, src long, dst long")
    res = D.pagerank_delta(e, ups, h, iters=3)
    new = G.apply_edge_updates(e, ups)
    want = {r.node: [round(x, 9) for x in r.hist] for r in PR.pagerank_history(new, iters=3, keep="all").collect()}
    assert {r.node: [round(x, 9) for x in r.hist] for r in res.history(h).collect()} == want


TEXT = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e"), ("a", "b"), ("e", ""), (None, "a")]


def test_text_nodes_are_numbered_and_get_their_names_back(spark):
    number = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "": 6, None: None}
    text = spark.createDataFrame(TEXT, "src string, dst string")
    plain = edges_df(spark, [(number[s], number[d]) for s, d in TEXT])
    assert G.number_nodes(plain) is None
    edges, names = G.number_nodes(text)
    assert edges.schema["src"].dataType.simpleString() == "bigint" and names.count() == 6
    for run in (PR.pagerank, PR.pagerank_history, lambda e: PR.pagerank_history(e, keep="all"), lambda e: PR.pagerank(e, iters=0)):
        flat = lambda df, of: {of(r[0]): [round(x, 9) for x in (r[1] if isinstance(r[1], list) else [r[1]])] for r in df.collect()}
        assert flat(run(text), number.get) == flat(run(plain), lambda x: x)


def test_names_that_share_a_number_stay_names(spark):
    from pyspark.sql import functions as F
    text = spark.createDataFrame(TEXT, "src string, dst string")
    assert G.number_nodes(text, number=lambda c: F.length(c).cast("long")) is None


def test_degrees_are_counted_once(spark):
    links = G.prepare_links(edges_df(spark, EDGES))
    deg = [d for d in links.held if d.columns == ["src", "outdeg"]]
    assert len(deg) == 1 and deg[0].storageLevel.useMemory
    assert sorted(r.node for r in links.nodes.collect()) == [1, 2, 3, 4, 5]
    links.unpersist()
