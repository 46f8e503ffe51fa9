"""Streaming results equal batch recompute, survive restarts and retries."""

import os

import pytest
from pyspark.sql import functions as F

from tallyrank.functions.text import FIELD_SEP
from tallyrank.operators import pagerank as PR
from tallyrank.operators.text import word_count
from tallyrank.streaming import pagerank as SP
from tallyrank.streaming import state as S
from tallyrank.streaming.sinks import latest, snapshots, write_snapshots
from tallyrank.streaming.sources import ProgressLog, progress_table, replay, run_to_idle, stream_lines, write_slices
from tallyrank.streaming.wordcount import COUNTS, PAGES, stream_page_word_count, stream_rejects, stream_word_count

US = FIELD_SEP


def run(spark, tmp, rows, start, landing=None):
    """Replay ``(batch, value)`` rows; ``start`` takes the stream."""
    src = tmp("slices")
    write_slices(spark.createDataFrame(rows, "batch int, value string"), src)
    return replay(spark, src, landing or tmp("landing"), start)


def counts(df):
    return {r.word: r.n for r in df.collect()}


class Feed:
    """A folder of line files, a stream over them and where its query keeps its things."""

    def __init__(self, spark, tmp, transform):
        self.spark, self.transform, self.n = spark, transform, 0
        self.lines, self.dest, self.checkpoint = tmp("lines"), tmp("snapshots"), tmp("checkpoint")

    def run(self, *batches, mode="update"):
        """Write each batch of lines as one file and run the query to its end."""
        for lines in batches:
            df = self.spark.createDataFrame([(x,) for x in lines], "value string")
            df.coalesce(1).write.text(f"{self.lines}/file-{self.n:04d}")
            self.n += 1
        query = write_snapshots(self.transform(stream_lines(self.spark, f"{self.lines}/file-*", 1)), self.dest, self.checkpoint, mode)
        query.awaitTermination()
        return query


def test_stream_word_count_equals_batch_and_restarts(spark, tmp):
    feed, log = Feed(spark, tmp, stream_word_count), ProgressLog(spark, every=1)
    feed.run(["p" + US + "a b", "q" + US + "b c"])
    q = feed.run(["p" + US + "a a" + US + "a b"], ["q" + US + "d" + US + "b c"])     # from the checkpoint
    got = counts(latest(spark, feed.dest, COUNTS, "word"))
    want = counts(word_count(spark.createDataFrame([("a a",), ("d",)], "text string")))
    assert {w: n for w, n in got.items() if n} == want
    assert got["b"] == 0 and got["c"] == 0          # zero counts stay
    seen = sorted((r.batch_id, r.num_input_rows) for r in progress_table(spark, q, log).collect() if r.num_input_rows)
    assert len(log.held) == 0
    log.close()
    assert seen == [(0, 2), (1, 1), (2, 1)]
    # every snapshot holds the words its batch changed
    rows = {(r.batch, r.word, r.n) for r in snapshots(spark, feed.dest, COUNTS).collect()}
    assert rows == {(0, "a", 1), (0, "b", 2), (0, "c", 1), (1, "a", 2), (1, "b", 1), (2, "d", 1), (2, "b", 0), (2, "c", 0)}


def test_counts_are_kept_by_spark_in_rocksdb(spark, tmp):
    feed = Feed(spark, tmp, stream_word_count)
    q = feed.run(["p" + US + "a b"])
    state = q.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 2 and any(k.startswith("rocksdb") for k in state["customMetrics"])


@pytest.mark.parametrize("files", [None, 1])
def test_counts_do_not_depend_on_the_slicing(spark, tmp, files):
    rows = [(f"p{i}" + US + f"w{i % 3} x",) for i in range(40)]
    src, dest = tmp("files"), tmp("snapshots")
    spark.createDataFrame(rows, "value string").repartition(4).write.text(src)
    write_snapshots(stream_word_count(stream_lines(spark, src, files)), dest, tmp("ck")).awaitTermination()
    assert snapshots(spark, dest, COUNTS).select("batch").distinct().count() == (4 if files else 1)
    assert counts(latest(spark, dest, COUNTS, "word")) == {"w0": 14, "w1": 13, "w2": 13, "x": 40}


def test_snapshots_of_the_whole_state_and_a_rerun(spark, tmp):
    feed = Feed(spark, tmp, stream_word_count)
    feed.run(["p" + US + "a b"], ["p" + US + "c" + US + "a b"], mode="complete")
    first = {0: {"a": 1, "b": 1}, 1: {"a": 0, "b": 0, "c": 1}}
    rows = snapshots(spark, feed.dest, COUNTS)
    for _ in range(2):
        assert {b: counts(rows.filter(F.col("batch") == b)) for b in (0, 1)} == first
        # a new checkpoint runs both batch ids again over the same snapshots
        feed.checkpoint = tmp("again")
        feed.run(mode="complete")
        rows = snapshots(spark, feed.dest, COUNTS)
    assert snapshots(spark, tmp("nothing"), COUNTS).count() == 0


@pytest.mark.parametrize("split", [1, 2])
def test_initial_state_is_taken_in_once(spark, tmp, split):
    initial, seed = spark.createDataFrame([("a", 5), ("z", 1)], COUNTS), tmp("seed")
    feed = Feed(spark, tmp, lambda s: stream_word_count(s, initial, seed))
    batches = [["p" + US + "a b"], ["q" + US + "a" + US + "z"], ["r" + US + "b"]]
    feed.run(*batches[:split])
    feed.run(*batches[split:])
    assert counts(latest(spark, feed.dest, COUNTS, "word")) == {"a": 7, "b": 2, "z": 0}


def test_last_text_of_a_page_by_sequence_whatever_the_order(spark, tmp):
    lines = [["p" + US + "old" + US + "1", "q" + US + "x" + US + "7"], ["p" + US + "c c" + US + "3"], ["p" + US + "late" + US + "2", "r" + US + US + "1"]]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        feed = Feed(spark, tmp, stream_page_word_count)
        feed.run(*(lines[i] for i in order))
        got = {r.page: (r.seq, dict(r.counts)) for r in latest(spark, feed.dest, PAGES, "page").collect()}
        assert got == {"p": (3, {"c": 2}), "q": (7, {"x": 1}), "r": (1, {"": 1})}


def test_pages_of_the_initial_state_stay_until_a_line_comes(spark, tmp):
    from tallyrank.operators.text import page_word_count
    init = page_word_count(spark.createDataFrame([("p", "old old"), ("r", "keep")], "page string, text string"))
    feed = Feed(spark, tmp, lambda s: stream_page_word_count(s, init))
    feed.run(["p" + US + "new" + US + "-4"])
    got = {r.page: dict(r.counts) for r in latest(spark, feed.dest, PAGES, "page").collect()}
    assert got == {"p": {"new": 1}, "r": {"keep": 1}}


def test_malformed_lines_are_set_aside_or_fail(spark, tmp):
    batches = [["p" + US + "a b", "no field"], ["q" + US + "c"]]
    feed = Feed(spark, tmp, stream_word_count)
    feed.run(*batches)
    assert counts(latest(spark, feed.dest, COUNTS, "word")) == {"a": 1, "b": 1, "c": 1}
    feed.transform, feed.dest, feed.checkpoint = stream_rejects, tmp("rejects"), tmp("ck")
    feed.run(mode="append")
    ddl = "line string, reason string"
    assert [tuple(r) for r in snapshots(spark, feed.dest, ddl).collect()] == [("no field", "fewer than 2 fields", 0)]
    feed.transform, feed.dest, feed.checkpoint = (lambda s: stream_word_count(s, strict=True)), tmp("strict"), tmp("ck")
    with pytest.raises(Exception, match="malformed line"):
        feed.run()


def test_pages_without_a_sequence_are_rejects(spark, tmp):
    batches = [["p" + US + "a" + US + "1", "p" + US + "b", "p" + US + "c" + US + "x"]]
    feed = Feed(spark, tmp, stream_page_word_count)
    feed.run(*batches)
    assert [dict(r.counts) for r in latest(spark, feed.dest, PAGES, "page").collect()] == [{"a": 1}]
    feed.transform, feed.dest, feed.checkpoint = (lambda s: stream_rejects(s, pages=True)), tmp("rejects"), tmp("ck")
    feed.run(mode="append")
    got = {(r.line, r.reason) for r in snapshots(spark, feed.dest, "line string, reason string").collect()}
    assert got == {("p" + US + "b", "fewer than 3 fields"), ("p" + US + "c" + US + "x", "the sequence is no number")}


def test_a_version_without_its_marker_is_not_read(spark, tmp):
    """A crash between the tables of a version leaves no commit marker."""
    state, ck = tmp("state"), tmp("ck")
    base = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    SP.init_graph_state(base, state, iters=2)
    S.write_version(base.withColumn("op", F.lit(-1)), state, 0, "changes")
    assert S.versions(spark, state) == [-1]
    run(spark, tmp, [(0, "1 2 3 1")], lambda s: SP.stream_pagerank(s, state, ck, iters=2))
    assert S.versions(spark, state) == [-1, 0]
    assert sorted(tuple(r) for r in SP.edges_at(spark, state, 0).collect()) == [(1, 2), (2, 1), (2, 3)]


def test_stream_pagerank_retention_keeps_the_snapshot(spark, tmp):
    state, ck = tmp("state"), tmp("ck")
    base = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    SP.init_graph_state(base, state, iters=2)
    rows = [(i, f"1 2 {10 + i} {i}") for i in range(5)]
    run(spark, tmp, rows, lambda s: SP.stream_pagerank(s, state, ck, iters=2, keep=2, compact_above=2.0,
                                                       compact_every=3))
    assert S.versions(spark, state) == [2, 3, 4]        # 2 holds the snapshot that 3 and 4 build on
    want = {(1, 2), (2, 1)} | {(2, 10 + i) for i in range(5)}
    assert {tuple(r) for r in SP.edges_at(spark, state, 4).collect()} == want


def final_history(spark, edges, iters):
    final = spark.createDataFrame(edges, "src long, dst long")
    return {r.node: [round(x, 9) for x in r.hist] for r in PR.pagerank_history(final, iters, keep="all").collect()}


@pytest.mark.parametrize("every", [2, 50])
def test_stream_pagerank_equals_recompute(spark, tmp, every):
    base = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    state, ck = tmp("state"), tmp("ck")
    SP.init_graph_state(base, state, iters=3)
    rows = [(0, "1 1 3 1"), (0, "-1 2 3 2"), (1, "1 4 1 3"), (1, "-1 3 4 4"), (1, "1 3 4 5"), (2, "1 4 2 6")]
    track = S.VersionTracker(state)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    run(spark, tmp, rows, lambda s: SP.stream_pagerank(s, state, ck, iters=3, compact_above=10.0,
                                                       compact_every=every, track=track))
    track.close()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    final = [(1, 2), (1, 3), (3, 1), (3, 4), (4, 1), (4, 2)]
    got = {r.node: [round(x, 9) for x in r.hist] for r in S.latest(spark, state, "ranks").collect()}
    assert got == final_history(spark, final, 3)
    assert ((1, "edges") in S.committed_tables(spark, state)) == (every == 2)
    last = S.versions(spark, state)[-1]
    assert sorted(tuple(r) for r in SP.edges_at(spark, state, last).collect()) == final


@pytest.fixture
def soon_idle(spark):
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "300")
    yield
    spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")


def test_run_to_idle_stops_processing_time_query(spark, tmp, soon_idle):
    src, dest = tmp("lines"), tmp("snapshots")
    spark.createDataFrame([("p" + US + "a",)], "value string").write.text(src)
    q = write_snapshots(stream_word_count(stream_lines(spark, src)), dest, tmp("ck"), trigger={"processingTime": "200 milliseconds"})
    run_to_idle(q, empty_batches=2, timeout_s=60)
    assert not q.isActive and counts(latest(spark, dest, COUNTS, "word")) == {"a": 1}
    run_to_idle(q)      # an ended query


def test_run_to_idle_leaves_a_busy_query_alone(spark, tmp, soon_idle):
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load()
    q = rate.writeStream.format("noop").option("checkpointLocation", tmp("ck")).trigger(processingTime="0 seconds").start()
    with pytest.raises(TimeoutError):
        run_to_idle(q, empty_batches=1, timeout_s=2)
    assert q.isActive
    q.stop()


def test_stream_pagerank_restart_replays_changes(spark, tmp):
    base = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    state, ck, landing = tmp("state"), tmp("ck"), tmp("landing")
    SP.init_graph_state(base, state, iters=3)
    rows = [(0, "1 1 3 1"), (0, "-1 2 3 2"), (1, "1 4 1 3"), (1, "-1 3 4 4"), (2, "1 5 2 5")]
    # no tracker is carried: every slice starts anew from the state folder
    run(spark, tmp, rows, lambda s: SP.stream_pagerank(s, state, ck, iters=3, compact_above=10.0), landing)
    final = [(1, 2), (1, 3), (3, 1), (4, 1), (5, 2)]
    last = S.versions(spark, state)[-1]
    assert sorted(tuple(r) for r in SP.edges_at(spark, state, last).collect()) == final
    got = {r.node: [round(x, 9) for x in r.hist] for r in S.latest(spark, state, "ranks").collect()}
    assert got == final_history(spark, final, 3)


def test_progress_log_keeps_more_triggers_than_spark_does(spark, tmp):
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load()
    log = ProgressLog(spark, every=50)
    q = (rate.writeStream.format("noop").option("checkpointLocation", tmp("ck"))
         .trigger(processingTime="0 seconds").start())
    while (q.lastProgress or {"batchId": 0})["batchId"] < 120:
        pass
    q.stop()
    rows = progress_table(spark, q, log).filter("batch_id IS NOT NULL AND num_input_rows > 0").collect()
    log.close()
    assert {r.batch_id for r in rows} >= set(range(120)) and all(r.num_input_rows == 3 and r.duration_ms >= 0 for r in rows)
    with pytest.raises(RuntimeError):
        progress_table(spark, q)


def test_bucketed_version_reregisters_after_restart(spark, tmp):
    state, df = tmp("state"), spark.createDataFrame([("a", 2), ("b", 1)], COUNTS)
    S.write_version_bucketed(df.repartition(4, "word"), state, 0, "word", 4)
    want = counts(S.read_version(spark, state, 0))
    spark.sql(f"DROP TABLE IF EXISTS {S._table_name(state, 0, None)}")     # as in a new session
    again = S.read_version_bucketed(spark, state, 0, "word", 4, COUNTS)
    assert counts(again) == want == {"a": 2, "b": 1}
    agg = again.groupBy("word").count()
    agg.write.format("noop").mode("overwrite").save()
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan     # grouping by the key moves nothing


def test_malformed_updates_are_kept_or_fail(spark, tmp):
    base = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    rows = [(0, "1 2 3 1"), (0, "x 2 3 2"), (0, "1 2 4 y")]
    state, ck = tmp("state"), tmp("ck")
    SP.init_graph_state(base, state, iters=2)
    run(spark, tmp, rows, lambda s: SP.stream_pagerank(s, state, ck, iters=2))
    assert {(r.line, r.reason) for r in S.rejects(spark, state).collect()} == {
        ("x 2 3 2", "not 'op from to' with op 1 or -1"), ("1 2 4 y", "the sequence is no number")}
    assert sorted(tuple(r) for r in SP.edges_at(spark, state, 0).collect()) == [(1, 2), (2, 1), (2, 3)]
    other, ck = tmp("state"), tmp("ck")
    SP.init_graph_state(base, other, iters=2)
    with pytest.raises(Exception, match="malformed line"):
        run(spark, tmp, rows, lambda s: SP.stream_pagerank(s, other, ck, iters=2, strict=True))


def test_links_of_the_first_version_carry_into_the_stream(spark, tmp, monkeypatch):
    """With a tracker the links prepared for the initial state are not prepared again."""
    made, prepare = [], SP.prepare_links
    monkeypatch.setattr(SP, "prepare_links", lambda e: made.append(1) or prepare(e))
    base = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 2), (None, 3)], "src long, dst long")
    state, ck = tmp("state"), tmp("ck")
    track = S.VersionTracker(state)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    SP.init_graph_state(base, state, iters=2, track=track)
    run(spark, tmp, [(0, "1 3 2 1"), (0, "-1 2 3 2")], lambda s: SP.stream_pagerank(s, state, ck, iters=2, compact_above=10.0, track=track))
    track.close()
    assert len(made) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert {tuple(r) for r in SP.edges_at(spark, state, -1).collect()} == {(1, 2), (2, 3), (3, 1), (None, 3)}
    got = {r.node: [round(x, 9) for x in r.hist] for r in S.latest(spark, state, "ranks").collect()}
    assert got == final_history(spark, [(1, 2), (3, 1), (3, 2), (None, 3)], 2)
