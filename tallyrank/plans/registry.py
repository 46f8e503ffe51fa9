"""The registered queries (one per operator of SURVEY §2) and their DuckDB
oracles. Every query reads whole driver tables, or data Spark derives
from them; doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP
from ..operators import text as T
from ..session import cut_lineage, scratch_path
from ..sources.lines import parse_edge_updates, parse_pages, read_lines
from . import inputs as I
from .oracle import REVISIONS, fields, r6, tok

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round6(c) -> F.Column:
    return F.round(c + F.lit(1e-9), 6) + F.lit(0.0)


# ---------------------------------------------------------------- word count

@register("word_count", f"""
SELECT word, count(*)::BIGINT AS n
FROM (SELECT unnest({tok('text')}) AS word FROM documents) GROUP BY word""")
def q_word_count(spark, sf):
    return T.word_count(I.table(spark, sf, "documents", ("text",)), "text")


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """documents as page lines with one, two or three fields by language:
    en -> ``id<US>text``, fr -> ``id<US>text<US>source``, others -> ``text``;
    newlines in the text become spaces so each document is one line."""
    d = I.table(spark, sf, "documents", ("doc_id", "text", "lang", "source"))
    text = F.regexp_replace("text", "[\\r\\n]", " ")
    sep = F.lit(FIELD_SEP)
    return d.select(
        F.when(F.col("lang") == "en", F.concat(F.col("doc_id").cast("string"), sep, text))
        .when(F.col("lang") == "fr", F.concat(F.col("doc_id").cast("string"), sep, text, sep, F.col("source")))
        .otherwise(text).alias("value"))


_DOC_LINE = """CASE WHEN lang = 'en' THEN doc_id::VARCHAR || chr(31) || regexp_replace(text, '[\\r\\n]', ' ', 'g')
     WHEN lang = 'fr' THEN doc_id::VARCHAR || chr(31) || regexp_replace(text, '[\\r\\n]', ' ', 'g') || chr(31) || source
     ELSE regexp_replace(text, '[\\r\\n]', ' ', 'g') END"""


@register("word_count_lines", f"""
WITH l AS (SELECT {fields(_DOC_LINE)} AS f FROM documents),
t AS (SELECT CASE WHEN len(f) = 2 THEN f[2] ELSE f[1] END AS text FROM l WHERE len(f) >= 1)
SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({tok('text')}) AS word FROM t) GROUP BY word""")
def q_word_count_lines(spark, sf):
    path = scratch_path(spark, "document-lines")
    document_lines(spark, sf).write.text(path)
    return T.word_count_lines(read_lines(spark, path))


@register("page_word_count_long", f"""
SELECT doc_id AS page, word, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest({tok('text')}) AS word FROM documents) GROUP BY doc_id, word""")
def q_page_word_count_long(spark, sf):
    return T.page_word_count_long(I.pages(spark, sf))


@register("page_word_count", f"""
WITH t AS (SELECT doc_id, {tok('text')} AS tk FROM documents),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(tk) AS word FROM t) GROUP BY doc_id, word)
SELECT t.doc_id AS page, count(w.word)::BIGINT AS distinct_words,
       coalesce(sum(w.n), 0)::BIGINT AS total_words, coalesce(sum(w.n * w.n), 0)::BIGINT AS sum_sq_counts
FROM t LEFT JOIN w ON t.doc_id = w.doc_id GROUP BY t.doc_id""")
def q_page_word_count(spark, sf):
    m = T.page_word_count(I.pages(spark, sf))
    vals = F.map_values("counts")
    return m.select("page", F.size("counts").cast("long").alias("distinct_words"),
                    F.aggregate(vals, F.lit(0).cast("long"), lambda a, x: a + x).alias("total_words"),
                    F.aggregate(vals, F.lit(0).cast("long"), lambda a, x: a + x * x).alias("sum_sq_counts"))


@register("signed_tokens", f"""
WITH {REVISIONS}
SELECT seq, page, unnest({tok('new_text')}) AS word, 1::BIGINT AS w FROM revisions
UNION ALL
SELECT seq, page, unnest({tok('old_text')}) AS word, -1::BIGINT AS w FROM revisions WHERE old_text IS NOT NULL""")
def q_signed_tokens(spark, sf):
    return T.signed_tokens(I.revisions(spark, sf))


# Oracle by recompute: counts over each conversation's last turn, with every
# word ever seen kept at 0 -- incremental result == full recompute.
@register("incremental_word_count", f"""
WITH last AS (SELECT text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest({tok('text')}) AS word FROM last) GROUP BY word),
seen AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM conversations)
SELECT seen.word AS word, coalesce(cnt.n, 0)::BIGINT AS n FROM seen LEFT JOIN cnt ON seen.word = cnt.word""")
def q_incremental_word_count(spark, sf):
    rev = I.revisions(spark, sf)
    base = T.word_count(rev.filter(F.col("old_text").isNull()), "new_text")
    return T.apply_word_delta(base, T.signed_tokens(rev.filter(F.col("old_text").isNotNull())))


# --------------------------------------------------------------------- graph

from ..operators import graph as G  # noqa: E402
from ..operators import pagerank as PR  # noqa: E402
from .oracle import GRAPH_B, GRAPH_C, GRAPH_P, history_sql, pagerank_ctes, pagerank_sql  # noqa: E402

ITERS, DAMPING = 5, 0.85


def rounded_rank(df: DataFrame) -> DataFrame:
    return df.select("node", round6(F.col("rank")).alias("rank"))


def rounded_wide(hist: DataFrame, iters: int = ITERS, col: str = "hist") -> DataFrame:
    w = PR.to_wide(hist, iters, col)
    return w.select("node", *[round6(F.col(f"i{i}")).alias(f"i{i}") for i in range(iters)])


@register("adjacency", f"SELECT DISTINCT src, dst FROM ({GRAPH_C})")
def q_adjacency(spark, sf):
    return G.adjacency(I.graph_c_lines(spark, sf))


@register("out_degree", f"SELECT src AS node, count(*)::BIGINT AS outdeg FROM (SELECT DISTINCT src, dst FROM ({GRAPH_C})) GROUP BY src")
def q_out_degree(spark, sf):
    return G.out_degree(I.graph_c_lines(spark, sf))


@register("no_incoming", f"""
SELECT DISTINCT src AS node FROM ({GRAPH_C}) WHERE src NOT IN (SELECT dst FROM ({GRAPH_C}))""")
def q_no_incoming(spark, sf):
    return G.no_incoming(I.graph_c_lines(spark, sf))


_BUILDING = "SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'"


def building_customers(spark, sf):
    return I.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("node"))


@register("neighbors", f"""
SELECT DISTINCT src, dst FROM ({GRAPH_C}) WHERE src IN ({_BUILDING})""")
def q_neighbors(spark, sf):
    return G.neighbors(I.graph_c_lines(spark, sf), building_customers(spark, sf))


@register("frontier", f"""
WITH h1 AS (SELECT DISTINCT dst AS node FROM ({GRAPH_C}) WHERE src IN ({_BUILDING}))
SELECT DISTINCT dst AS node FROM ({GRAPH_C}) WHERE src IN (SELECT node FROM h1)""")
def q_frontier(spark, sf):
    return G.frontier(I.graph_c_lines(spark, sf), building_customers(spark, sf), hops=2)


@register("pagerank", pagerank_sql(GRAPH_C, ITERS, DAMPING))
def q_pagerank(spark, sf):
    return rounded_rank(PR.pagerank(I.graph_c(spark, sf), ITERS, DAMPING))


@register("pagerank_parts", pagerank_sql(GRAPH_P, ITERS, DAMPING))
def q_pagerank_parts(spark, sf):
    return rounded_rank(PR.pagerank(I.graph_p(spark, sf), ITERS, DAMPING))


@register("pagerank_words", pagerank_sql(GRAPH_B, ITERS, DAMPING))
def q_pagerank_words(spark, sf):
    return rounded_rank(PR.pagerank(I.graph_b(spark, sf), ITERS, DAMPING))


@register("pagerank_history_survivors", history_sql(GRAPH_C, ITERS, DAMPING, "survivors"))
def q_history_survivors(spark, sf):
    return rounded_wide(PR.pagerank_history(I.graph_c(spark, sf), ITERS, DAMPING, keep="survivors"))


@register("pagerank_history_all", history_sql(GRAPH_C, ITERS, DAMPING, "all"))
def q_history_all(spark, sf):
    return rounded_wide(PR.pagerank_history(I.graph_c(spark, sf), ITERS, DAMPING, keep="all"))


@register("pagerank_history_words", history_sql(GRAPH_B, ITERS, DAMPING, "survivors"))
def q_history_words(spark, sf):
    return rounded_wide(PR.pagerank_history(I.graph_b(spark, sf), ITERS, DAMPING, keep="survivors"))


_SUPPLIERS = "SELECT s_suppkey AS node FROM supplier"


@register("rank_at", "WITH " + ", ".join(pagerank_ctes(GRAPH_C, ITERS, DAMPING, "all"))
          + f" SELECT r3.node AS node, {r6('r3.r')} AS rank FROM r3 WHERE r3.node IN ({_SUPPLIERS})")
def q_rank_at(spark, sf):
    hist = PR.pagerank_history(I.graph_c(spark, sf), ITERS, DAMPING, keep="all")
    nodes = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return rounded_rank(PR.rank_at(hist, nodes, 2))


@register("zero_deltas", f"""
SELECT node, 0.0::DOUBLE AS i0, 0.0::DOUBLE AS i1, 0.0::DOUBLE AS i2, 0.0::DOUBLE AS i3, 0.0::DOUBLE AS i4
FROM (SELECT src AS node FROM ({GRAPH_C}) UNION SELECT dst FROM ({GRAPH_C}))""")
def q_zero_deltas(spark, sf):
    hist = PR.pagerank_history(I.graph_c(spark, sf), ITERS, DAMPING, keep="all")
    return rounded_wide(PR.zero_deltas(hist), col="delta")


# ------------------------------------------------------- changelog and delta

from ..operators.delta import pagerank_delta  # noqa: E402
from .oracle import CHANGELOG_CTES, delta_sql, new_history_sql  # noqa: E402


@register("apply_edge_updates", f"WITH {', '.join(CHANGELOG_CTES)} SELECT src, dst FROM newe")
def q_apply_edge_updates(spark, sf):
    return G.apply_edge_updates(I.base_edges(spark, sf), I.edge_updates(spark, sf))


@register("edge_update_rejects", """
SELECT l_returnflag || ' ' || l_orderkey || ' ' || l_suppkey || CASE WHEN l_linenumber = 1 THEN ' x' ELSE '' END AS line,
       CASE WHEN l_returnflag = 'N' THEN 'not ''op from to'' with op 1 or -1' ELSE 'the sequence is no number' END AS reason,
       count(*)::BIGINT AS n
FROM (SELECT CASE l_returnflag WHEN 'R' THEN '-1' WHEN 'A' THEN '1' ELSE 'N' END AS l_returnflag, l_orderkey, l_suppkey, l_linenumber FROM lineitem)
WHERE l_returnflag = 'N' OR l_linenumber = 1 GROUP BY ALL
UNION ALL SELECT 'parsed', NULL, count(*)::BIGINT FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 1""")
def q_edge_update_rejects(spark, sf):
    """Order lines as update lines (O14): flag N is no op, and line 1 of an order
    carries a sequence that is no number. No line is lost."""
    li = I.table(spark, sf, "lineitem", ("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"))
    op = F.when(F.col("l_returnflag") == "R", "-1").when(F.col("l_returnflag") == "A", "1").otherwise("N")
    bad_seq = F.when(F.col("l_linenumber") == 1, F.lit("x"))
    lines = li.select(F.concat_ws(" ", op, "l_orderkey", "l_suppkey", bad_seq).alias("value"))
    ok, bad = parse_edge_updates(lines, seq=F.lit(0), with_rejects=True)
    n = F.count(F.lit(1)).alias("n")
    parsed = ok.agg(n).select(F.lit("parsed").alias("line"), F.lit(None).cast("string").alias("reason"), "n")
    return bad.groupBy("line", "reason").agg(n).unionByName(parsed)


def _delta(spark, sf, **how):
    base = I.base_edges(spark, sf)
    links = G.prepare_links(base)
    hist = PR.pagerank_history(links=links, iters=ITERS, damping=DAMPING, keep="all")
    return links, hist, pagerank_delta(base, I.edge_updates(spark, sf), hist, ITERS, DAMPING, links_old=links, **how)


def _released(df: DataFrame, links) -> DataFrame:
    """``df`` written, and the links it read released."""
    out = cut_lineage(df)
    links.unpersist()
    return out


@register("pagerank_delta", delta_sql(ITERS, DAMPING))
def q_pagerank_delta(spark, sf):
    links, _, res = _delta(spark, sf)
    return _released(rounded_wide(res.full_delta(), col="delta"), links)


@register("pagerank_delta_hot", delta_sql(ITERS, DAMPING))
def q_pagerank_delta_hot(spark, sf):
    """No changed source is broadcast but those above 8 edges (O15), which are not shuffled."""
    links, _, res = _delta(spark, sf, max_broadcast=0, split_above=8)
    return _released(rounded_wide(res.full_delta(), col="delta"), links)


# history(E) + delta == history(E'): the updated history against a recompute.
@register("pagerank_delta_history", new_history_sql(ITERS, DAMPING))
def q_pagerank_delta_history(spark, sf):
    links, hist, res = _delta(spark, sf)
    return _released(rounded_wide(res.history(hist)), links)


# ------------------------------------------------------ ordered and state

from ..operators.ordered import slice_batches, take_chars  # noqa: E402
from ..sources.state import load_graph_state, save, save_graph_state  # noqa: E402

TAKE_CHARS = 1_000_000          # the reference generator's default size
ROWS_PER_BATCH, EMPTY_RUNS = 50, 1

_UTF16_LEN = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@register("take_chars", f"""
WITH d AS (SELECT doc_id, {_UTF16_LEN}::BIGINT AS chars FROM documents),
c AS (SELECT doc_id, chars, sum(chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_chars,
             row_number() OVER (ORDER BY doc_id) AS rn FROM d)
SELECT doc_id, chars, cum_chars FROM c WHERE rn = 1 OR cum_chars - chars < {TAKE_CHARS}""")
def q_take_chars(spark, sf):
    d = I.table(spark, sf, "documents", ("doc_id", "text"))
    return take_chars(d, ["doc_id"], TAKE_CHARS).select("doc_id", "chars", "cum_chars")


@register("slice_batches", f"""
SELECT conv_id, turn, ({EMPTY_RUNS} + floor((row_number() OVER (ORDER BY conv_id, turn) - 1) / {ROWS_PER_BATCH}))::INTEGER AS batch
FROM conversations""")
def q_slice_batches(spark, sf):
    c = I.table(spark, sf, "conversations", ("conv_id", "turn"))
    return slice_batches(c, ["conv_id", "turn"], ROWS_PER_BATCH, empty_runs=EMPTY_RUNS)


@register("graph_state_roundtrip", history_sql(GRAPH_C, ITERS, DAMPING, "all"))
def q_graph_state_roundtrip(spark, sf):
    return rounded_wide(_saved_state(spark, sf)[1])


def _saved_state(spark, sf):
    edges = I.graph_c(spark, sf)
    path = scratch_path(spark, "graph-state")
    save_graph_state(path, edges, PR.pagerank_history(edges, ITERS, DAMPING, keep="all"))
    return load_graph_state(spark, path)


@register("graph_state_edges", f"SELECT DISTINCT src, dst FROM ({GRAPH_C})")
def q_graph_state_edges(spark, sf):
    return _saved_state(spark, sf)[0]


@register("graph_state_deltas", ORACLE["zero_deltas"])
def q_graph_state_deltas(spark, sf):
    return rounded_wide(_saved_state(spark, sf)[2], col="delta")


POINTS = 1000       # so many nodes are looked up by literals


@register("rank_at_saved", ORACLE["rank_at"])
def q_rank_at_saved(spark, sf):
    """Point reads of saved ranks: only the buckets of the nodes asked for are read."""
    nodes = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return rounded_rank(PR.rank_at(_saved_state(spark, sf)[1], nodes, 2, few=POINTS))


@register("neighbors_saved", ORACLE["neighbors"])
def q_neighbors_saved(spark, sf):
    """Neighbour lookup on saved edges, by bucket."""
    return G.neighbors(_saved_state(spark, sf)[0], building_customers(spark, sf), few=POINTS)


@register("hot_sources", pagerank_sql(GRAPH_P, ITERS, DAMPING))
def q_hot_sources(spark, sf):
    """Every source of graph P above 8 out-edges taken as hot."""
    links = G.prepare_links(I.graph_p(spark, sf), split_above=8)
    return _released(rounded_rank(PR.pagerank(links=links, iters=ITERS, damping=DAMPING)), links)


@register("page_lines_saved", f"""
SELECT doc_id::VARCHAR AS page, word, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest({tok("regexp_replace(text, '[\\r\\n]', ' ', 'g')")}) AS word FROM documents)
GROUP BY doc_id, word""")
def q_page_lines_saved(spark, sf):
    """Pages written as lines, parsed (O2), counted (O3), saved (O25) and read back."""
    d = I.table(spark, sf, "documents", ("doc_id", "text"))
    lines, out = scratch_path(spark, "page-lines"), scratch_path(spark, "page-counts")
    save(d.select(F.concat_ws(FIELD_SEP, F.col("doc_id").cast("string"),
                              F.regexp_replace("text", "[\\r\\n]", " ")).alias("value")), lines, "text")
    counts = T.page_word_count_long(parse_pages(read_lines(spark, lines)))
    save(counts, out)
    return spark.read.parquet(out)


# ----------------------------------------------------------------- streaming

from ..operators.ordered import running_sum  # noqa: E402
from ..streaming import pagerank as SP  # noqa: E402
from ..streaming import sinks as SK  # noqa: E402
from ..streaming import state as SS  # noqa: E402
from ..streaming import wordcount as SW  # noqa: E402
from ..streaming.sources import (ProgressLog, progress_table, replay, run_to_idle, stream_lines,  # noqa: E402
                                 write_slices)


def revision_lines(spark, sf) -> DataFrame:
    """``(batch, value)``: turn t of each conversation as a page line,
    ``conv<US>text`` for turn 0 and ``conv<US>text<US>previous`` after it;
    newlines become spaces (one record per line). batch = turn."""
    rev = I.revisions(spark, sf)
    clean = lambda c: F.regexp_replace(F.col(c), "\n", " ")
    sep = F.lit(FIELD_SEP)
    page = F.col("page").cast("string")
    value = (F.when(F.col("old_text").isNull(), F.concat(page, sep, clean("new_text")))
             .otherwise(F.concat(page, sep, clean("new_text"), sep, clean("old_text"))))
    return rev.select(F.col("seq").alias("batch"), value.alias("value"))


def _line_files(lines: DataFrame, path: str) -> str:
    lines.select("value").write.text(path)
    return path


def _turn_files(lines: DataFrame, path: str) -> str:
    """One file after another for each turn, so that a stream that takes one file
    a time gets one turn in each micro-batch (a list of turn numbers on the driver)."""
    for b in sorted(r["batch"] for r in lines.select("batch").distinct().collect()):
        lines.filter(F.col("batch") == b).select("value").coalesce(1).write.text(f"{path}/turn-{b:04d}")
    return f"{path}/turn-*"


def _counted(spark, name: str, stream: DataFrame, mode: str = "update") -> tuple:
    dest = scratch_path(spark, f"{name}-snapshots")
    query = SK.write_snapshots(stream, dest, scratch_path(spark, f"{name}-checkpoint"), mode)
    query.awaitTermination()
    return query, dest


_CONV = "conv AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)"
_FINAL_COUNTS = f"""WITH {_CONV},
last AS (SELECT text FROM conv QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
cnt AS (SELECT word, count(*) AS n FROM (SELECT unnest({tok('text')}) AS word FROM last) GROUP BY word),
seen AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM conv)
SELECT seen.word AS word, coalesce(cnt.n, 0)::BIGINT AS n FROM seen LEFT JOIN cnt ON seen.word = cnt.word"""


@register("stream_word_count", _FINAL_COUNTS)
def q_stream_word_count(spark, sf):
    """One query over all lines, in whatever batches its files come."""
    path = _line_files(revision_lines(spark, sf), scratch_path(spark, "swc-lines"))
    _, dest = _counted(spark, "swc", SW.stream_word_count(stream_lines(spark, path, files_per_batch=4)))
    return SK.latest(spark, dest, SW.COUNTS, "word")


@register("stream_word_count_initial", _FINAL_COUNTS)
def q_stream_word_count_initial(spark, sf):
    """Turn 0 as initial state, turn 1 in a first run, the rest after a restart."""
    from ..operators.text import word_count_lines
    lines = revision_lines(spark, sf)
    initial = word_count_lines(lines.filter(F.col("batch") == 0))
    root, dest, checkpoint, seed = (scratch_path(spark, f"swci-{x}") for x in ("lines", "snapshots", "checkpoint", "initial"))
    for part, turns in (("1", F.col("batch") == 1), ("2", F.col("batch") > 1)):
        _line_files(lines.filter(turns), f"{root}/part-{part}")
        counts = SW.stream_word_count(stream_lines(spark, f"{root}/part-*"), initial, seed)
        SK.write_snapshots(counts, dest, checkpoint).awaitTermination()
    return SK.latest(spark, dest, SW.COUNTS, "word")


@register("stream_page_word_count", f"""WITH {_CONV},
last AS (SELECT conv_id, text FROM conv QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id::VARCHAR AS page, word, count(*)::BIGINT AS n
FROM (SELECT conv_id, unnest({tok('text')}) AS word FROM last) GROUP BY conv_id, word""")
def q_stream_page_word_count(spark, sf):
    """``conv<US>text<US>turn`` lines in files of any order: the turn is the sequence."""
    rev, sep = I.revisions(spark, sf), F.lit(FIELD_SEP)
    lines = rev.select(F.concat(F.col("page").cast("string"), sep, F.regexp_replace("new_text", "\n", " "), sep,
                                F.col("seq").cast("string")).alias("value"))
    path = _line_files(lines, scratch_path(spark, "spwc-lines"))
    _, dest = _counted(spark, "spwc", SW.stream_page_word_count(stream_lines(spark, path, files_per_batch=4)))
    return SK.latest(spark, dest, SW.PAGES, "page").select("page", F.explode("counts").alias("word", "n"))


@register("stream_snapshots", f"""WITH {_CONV},
r AS (SELECT turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conv),
s AS (SELECT turn, unnest({tok('text')}) AS word, 1 AS w FROM r
      UNION ALL SELECT turn, unnest({tok('old')}), -1 FROM r WHERE old IS NOT NULL)
SELECT b.batch, word, sum(w)::BIGINT AS n FROM s JOIN (VALUES (0::BIGINT), (1::BIGINT), (3::BIGINT)) b(batch) ON s.turn <= b.batch
GROUP BY b.batch, word""")
def q_stream_snapshots(spark, sf):
    """The whole state as it stood after three of the batches."""
    path = _turn_files(revision_lines(spark, sf), scratch_path(spark, "snap-lines"))
    _, dest = _counted(spark, "snap", SW.stream_word_count(stream_lines(spark, path, files_per_batch=1)), "complete")
    return SK.snapshots(spark, dest, SW.COUNTS).filter(F.col("batch").isin(0, 1, 3)).select("batch", "word", "n")


_ROWS = "SELECT turn AS batch_id, count(*)::BIGINT AS num_input_rows{more} FROM conversations GROUP BY turn"


def _progress(spark, sf) -> DataFrame:
    log = ProgressLog(spark, every=3)
    path = _turn_files(revision_lines(spark, sf), scratch_path(spark, "prog-lines"))
    query, _ = _counted(spark, "prog", SW.stream_word_count(stream_lines(spark, path, files_per_batch=1)))
    rows = progress_table(spark, query, log)
    log.close()
    return rows.filter(F.col("num_input_rows") > 0)


@register("progress_rows", _ROWS.format(more=""))
def q_progress_rows(spark, sf):
    return _progress(spark, sf).select("batch_id", "num_input_rows")


@register("progress_durations", _ROWS.format(more=", true AS timed"))
def q_progress_durations(spark, sf):
    """Every batch has its duration."""
    return _progress(spark, sf).select("batch_id", "num_input_rows", (F.col("duration_ms") > 0).alias("timed"))


@register("stream_idle_stop", _FINAL_COUNTS)
def q_stream_idle_stop(spark, sf):
    """A query on a processing-time trigger (S12) that ends when it has been idle."""
    path = _line_files(revision_lines(spark, sf), scratch_path(spark, "idle-lines"))
    dest, checkpoint = scratch_path(spark, "idle-snapshots"), scratch_path(spark, "idle-checkpoint")
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "500")
    try:
        query = SK.write_snapshots(SW.stream_word_count(stream_lines(spark, path)), dest, checkpoint,
                                   trigger={"processingTime": "200 milliseconds"})
        run_to_idle(query, empty_batches=2)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    return SK.latest(spark, dest, SW.COUNTS, "word")


@register("stream_rejects", """
SELECT turn AS batch, replace(text, chr(10), ' ') AS line, 'fewer than 2 fields' AS reason
FROM conversations WHERE role = 'system'""")
def q_stream_rejects(spark, sf):
    """System turns come without a page field, so the stream must set them aside."""
    c = I.table(spark, sf, "conversations", ("conv_id", "turn", "role", "text"))
    text = F.regexp_replace("text", "\n", " ")
    lines = c.select(F.col("turn").alias("batch"), F.when(F.col("role") == "system", text).otherwise(
        F.concat(F.col("conv_id").cast("string"), F.lit(FIELD_SEP), text)).alias("value"))
    path = _turn_files(lines, scratch_path(spark, "srej-lines"))
    _, dest = _counted(spark, "srej", SW.stream_rejects(stream_lines(spark, path, files_per_batch=1)), "append")
    return SK.snapshots(spark, dest, "line string, reason string").select("batch", "line", "reason")


def update_lines(spark, sf) -> DataFrame:
    """``(batch, value)`` with value ``op src dst seq``; seq is the change's
    position in (date, order, line, op) order."""
    u = I.edge_updates(spark, sf).select(
        "batch", "op", "src", "dst", F.col("seq.o_orderdate").cast("timestamp").cast("long").alias("d"),
        F.col("seq.o_orderkey").alias("k"), F.col("seq.l_linenumber").alias("l"))
    u = running_sum(u, ["d", "k", "l", "op"])
    return u.select("batch", F.concat_ws(" ", "op", "src", "dst", "idx").alias("value"))


@register("stream_pagerank", new_history_sql(ITERS, DAMPING))
def q_stream_pagerank(spark, sf):
    def start(lines, state, ckpt, track):
        if track.last is None:
            SP.init_graph_state(I.base_edges(spark, sf), state, ITERS, DAMPING, track=track)
        return SP.stream_pagerank(lines, state, ckpt, ITERS, DAMPING, track=track)
    slices, landing, state, ckpt = (scratch_path(spark, f"spr-{x}") for x in ("slices", "landing", "state", "checkpoint"))
    write_slices(update_lines(spark, sf), slices)
    track = SS.VersionTracker(state)
    replay(spark, slices, landing, lambda s: start(s, state, ckpt, track=track))
    track.close()
    return rounded_wide(SS.latest(spark, state, "ranks"))   # plain read of the newest ranks version


# ------------------------------------------------------------ edge files

from ..sources.lines import parse_edges  # noqa: E402


def _edge_file(spark, sf, sep: str) -> str:
    """Graph C's order lines written as text, ``src<sep>dst`` per line."""
    path = scratch_path(spark, "edge-lines")
    (I.graph_c_lines(spark, sf).select(F.concat_ws(sep, "src", "dst").alias("value"))
     .write.text(path))
    return path


@register("pagerank_tab_lines", pagerank_sql(
    "SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM (" + GRAPH_C + ")", ITERS, DAMPING))
def q_pagerank_tab_lines(spark, sf):
    """Tab-separated string ids (O1, O7), ranked."""
    edges = parse_edges(read_lines(spark, _edge_file(spark, sf, "\t")), sep="\t")
    return rounded_rank(PR.pagerank(edges, ITERS, DAMPING))


@register("history_ws_lines", history_sql(GRAPH_C, ITERS, DAMPING, "survivors"))
def q_history_ws_lines(spark, sf):
    """White-space separated integer ids (O8), survivors history."""
    edges = parse_edges(read_lines(spark, _edge_file(spark, sf, "  ")), sep=r"\s+", ids="bigint")
    return rounded_wide(PR.pagerank_history(edges, ITERS, DAMPING, keep="survivors"))
