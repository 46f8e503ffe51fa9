"""Ordered prefixes, batch slicing, state tables and JDBC export."""

from pyspark.sql import functions as F

from tallyrank.operators import pagerank as PR
from tallyrank.operators.ordered import running_sum, slice_batches, take_chars, up_to
from tallyrank.sources.state import export_jdbc, load_graph_state, read_jdbc, save, save_graph_state


def test_take_chars(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([3, 4, 5, 6])], "id long, text string")
    keep = lambda size: [r.id for r in take_chars(df, ["id"], size).orderBy("id").collect()]
    assert keep(7) == [0, 1]          # 3 + 4 reaches 7: the crossing line is kept, no more
    assert keep(8) == [0, 1, 2]
    assert keep(0) == [0]             # at least one line
    assert keep(100) == [0, 1, 2, 3]


def test_take_chars_by_several_columns_with_nulls(spark):
    rows = [(None, 2, "ab"), (1, None, "c"), (1, 5, "dd"), (1, 5, "ee"), (2, 0, "f"), (2, 1, "ggg")]
    df = spark.createDataFrame(rows, "a int, b int, text string")
    for size in range(0, 14):
        got = sorted((r.text for r in take_chars(df, ["a", "b"], size).collect()))
        want, total = [], 0
        for a, b, t in rows:
            if not want or total < size:
                want.append(t)
            total += len(t)
        # rows of one key have no order among them
        assert len(got) == len(want) and {t[0] for t in got} ^ {t[0] for t in want} <= {"d", "e"}
    assert take_chars(df.limit(0), ["a"], 5).count() == 0


def test_take_chars_filters_the_scan_by_the_last_key(spark, tmp):
    path = tmp("docs")
    spark.range(0, 1000).select("id", F.lit("x" * 10).alias("text")).write.parquet(path)
    out = take_chars(spark.read.parquet(path), ["id"], 95)
    assert out.count() == 10
    near = spark.read.parquet(path).filter(up_to(spark.read.parquet(path), ["id"], [9]))
    assert "LessThanOrEqual(id,9)" in near._jdf.queryExecution().executedPlan().toString() and near.count() == 10


def test_running_sum_many_buckets(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v"))
    r = running_sum(df, ["k"], "v", buckets=13).orderBy("k").collect()
    assert [x.idx for x in r] == list(range(1000))
    assert [x.cum for x in r] == [2 * (i + 1) for i in range(1000)]


def test_slice_batches(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id long")
    got = [(r.id, r.batch) for r in slice_batches(df, ["id"], 3, empty_runs=1).orderBy("id").collect()]
    assert got == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3)]
    assert slice_batches(df, ["id"], 3, n_batches=2).count() == 6


def test_graph_state_roundtrip_and_jdbc(spark, tmp):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    h = PR.pagerank_history(e, iters=5, keep="all")
    path = tmp("state")
    save_graph_state(path, e, h)
    e2, h2, d2 = load_graph_state(spark, path)
    assert sorted(tuple(r) for r in e2.collect()) == [(1, 2), (2, 1), (2, 3)]
    assert {r.node: r.hist for r in h2.collect()} == {r.node: r.hist for r in h.collect()}
    assert all(x == 0.0 for r in d2.collect() for x in r.delta)
    # an in-process database, visible to this JVM only (local mode)
    url = "jdbc:derby:memory:tallyrank_test;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    export_jdbc(url, e, h, 5, properties=props)
    assert read_jdbc(spark, url, "links", props).count() == 3
    assert read_jdbc(spark, url, "ranks", props).columns == ["node", "i0", "i1", "i2", "i3", "i4"]
    out = tmp("csv")
    save(PR.to_wide(h, 5), out, "csv", header="true")
    assert spark.read.option("header", "true").csv(out).count() == 3


def test_point_reads_of_saved_state_open_their_buckets_only(spark, tmp):
    import contextlib
    import io

    from tallyrank.operators import graph as G
    e = spark.range(500).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst"))
    h = PR.pagerank_history(e, iters=3, keep="all")
    path = tmp("buckets")
    for _ in range(2):                                            # the second call replaces the first's files
        save_graph_state(path, e, h, buckets=16)
    edges, ranks, _ = load_graph_state(spark, path)
    assert (edges.count(), ranks.count()) == (500, 500)
    nodes = spark.createDataFrame([(3,), (7,), (7,), (None,), (9999,)], "node long")
    want = sorted((r.node, r.hist[1]) for r in h.collect() if r.node in (3, 7))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")    # explain names the buckets
    try:
        for few in (0, 3, 1000):
            at = PR.rank_at(ranks, nodes, 1, few=few)
            assert sorted(tuple(r) for r in at.collect()) == want
            near = G.neighbors(edges, nodes, few=few)
            assert near.count() == 20 and near.filter("src not in (3, 7)").count() == 0
            for df in (at, near):
                plan = io.StringIO()
                with contextlib.redirect_stdout(plan):
                    df.explain("formatted")
                picked = int(plan.getvalue().split("SelectedBucketsCount: ")[1].split(" ")[0])
                assert picked <= 3 if few else picked == 16
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_running_sum_hot_first_column_is_split(spark):
    """A first column holding one value for most rows: the range partitioner
    splits it by the next column, and the sums stay exact."""
    n = 3000
    df = spark.range(0, n).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("a"),
                                  F.col("id").alias("b"), F.lit(1).alias("v"))
    r = running_sum(df, ["a", "b"], "v", buckets=6)
    rows = r.orderBy("a", "b").collect()
    assert [x.idx for x in rows] == list(range(n))
    assert [x.cum for x in rows] == list(range(1, n + 1))
    sizes = running_sum(df, ["a", "b"], "v", buckets=6).groupBy(F.spark_partition_id()).count().collect()
    assert max(s[1] for s in sizes) < n      # the hot value is not one task
