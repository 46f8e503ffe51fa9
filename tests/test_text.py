"""Tokenizer contract and word-count operators (hand-worked cases)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrank.functions.text import FIELD_SEP, java_length, java_split, tokens
from tallyrank.operators import text as T
from tallyrank.sources.lines import corpus_text, parse_edges, parse_edge_updates, parse_pages, parse_revisions

US = FIELD_SEP

# text -> tokens as the JVM's String.split(" ") gives them
SPLIT_CASES = [("", [""]), (" ", []), ("a b", ["a", "b"]), ("a  b", ["a", "", "b"]),
               ("a b  ", ["a", "b"]), (" a", ["", "a"]), ("a\tb c", ["a\tb", "c"]),
               ("x\ny z", ["x\ny", "z"]), ("   ", [])]


def java_like_split(s, sep):
    """Python model of String.split with limit 0 for a literal separator."""
    parts = s.split(sep)
    if s == "":
        return [""]
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def test_tokens_cases(spark):
    df = spark.createDataFrame([(t,) for t, _ in SPLIT_CASES], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [want for _, want in SPLIT_CASES]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n", max_size=12), min_size=1, max_size=8))
def test_tokens_match_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tokens("t")).collect()]
    assert got == [java_like_split(t, " ") for t in texts]


def test_field_split_and_length(spark):
    rows = [("k" + US + "new" + US,), (US + US,), ("k" + US + US + "old",), ("a\U0001F600",)]
    df = spark.createDataFrame(rows, "v string")
    got = [(r[0], r[1]) for r in df.select(java_split("v", US), java_length("v")).collect()]
    assert got[0][0] == ["k", "new"]
    assert got[1][0] == []
    assert got[2][0] == ["k", "", "old"]
    assert got[3][1] == 3           # a supplementary character counts 2 (UTF-16)


def test_page_word_count_keeps_lines_and_empty_pages(spark):
    pages = spark.createDataFrame([("p", "a b a"), ("p", "c"), ("q", " ")], "page string, text string")
    got = sorted((r.page, sorted(r.counts.items())) for r in T.page_word_count(pages).collect())
    assert got == [("p", [("a", 2), ("b", 1)]), ("p", [("c", 1)]), ("q", [])]
    long = sorted(tuple(r) for r in T.page_word_count_long(pages).collect())
    assert long == [("p", "a", 2), ("p", "b", 1), ("p", "c", 1)]


def test_word_count_lines_field_rule(spark):
    lines = spark.createDataFrame([("k1" + US + "x y",), ("solo z",), ("k3" + US + "t" + US + "old",),
                                   ("k4" + US + "a" + US + "b" + US + "c",), ("k5" + US + "w" + US,)], "value string")
    got = dict((r.word, r.n) for r in T.word_count_lines(lines).collect())
    # 2 fields -> field 1; any other count -> field 0 (the key for 3+ fields)
    assert got == {"x": 1, "y": 1, "solo": 1, "z": 1, "k3": 1, "k4": 1, "w": 1}


def test_revisions_and_incremental_count(spark):
    base = T.word_count(spark.createDataFrame([("a b",)], "text string"))
    lines = spark.createDataFrame([("k1" + US + "a a",), ("k1" + US + "a c" + US + "a a",)], "value string")
    rev = parse_revisions(lines, seq=F.monotonically_increasing_id())
    got = dict((r.word, r.n) for r in T.apply_word_delta(base, T.signed_tokens(rev)).collect())
    assert got == {"a": 2, "b": 1, "c": 1}
    # a word whose count falls to 0 stays unless asked
    rev2 = spark.createDataFrame([(0, "k", "c", "b")], "seq long, page string, new_text string, old_text string")
    got2 = dict((r.word, r.n) for r in T.apply_word_delta(base, T.signed_tokens(rev2)).collect())
    assert got2 == {"a": 1, "b": 0, "c": 1}
    assert "b" not in {r.word for r in T.apply_word_delta(base, T.signed_tokens(rev2), drop_zero=True).collect()}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "q", "r"]), st.text(alphabet="ab ", max_size=8)),
                min_size=1, max_size=8))
def test_incremental_equals_recompute(spark, edits):
    """count(old) + signed changes == count(new) for any sequence of page edits."""
    cur, rows = {}, []
    for i, (page, text) in enumerate(edits):
        rows.append((i, page, text, cur.get(page)))
        cur[page] = text
    rev = spark.createDataFrame(rows, "seq long, page string, new_text string, old_text string")
    empty = spark.createDataFrame([], "word string, n bigint")
    inc = {r.word: r.n for r in T.apply_word_delta(empty, T.signed_tokens(rev), drop_zero=True).collect()}
    final = spark.createDataFrame([(t,) for t in cur.values()], "text string")
    assert inc == {r.word: r.n for r in T.word_count(final).collect()}


def test_parsers_reject_bad_lines(spark):
    lines = spark.createDataFrame([("a\tb",), ("lonely",), ("c\td\te",)], "value string")
    ok, bad = parse_edges(lines, with_rejects=True)
    assert sorted(tuple(r) for r in ok.collect()) == [("a", "b"), ("c", "d")]
    assert [r.line for r in bad.collect()] == ["lonely"]
    ints = spark.createDataFrame([("1 2",), (" 3 4",), ("5\t\t6 extra",), ("x 1",)], "value string")
    ok, bad = parse_edges(ints, sep=r"\s+", ids="bigint", with_rejects=True)
    assert sorted(tuple(r) for r in ok.collect()) == [(1, 2), (5, 6)]
    assert bad.count() == 2          # leading blank gives an empty first field
    ups = spark.createDataFrame([("1 1 2",), ("-1 1 2",), ("0 1 2",)], "value string")
    assert parse_edge_updates(ups, seq=F.lit(0)).count() == 2
    pages, rej = parse_pages(spark.createDataFrame([("k" + US + "t",), ("nokey",)], "value string"), with_rejects=True)
    assert pages.count() == 1 and rej.count() == 1
    assert corpus_text(spark.createDataFrame([("a" + US + "b",)], "value string")).first().text == "b"


def test_every_update_line_is_parsed_or_rejected(spark):
    rows = ["1 2 3", "-1 2 3 7", "x 2 3", "2 2 3", "1 2", "", "1 a 3", "1 2 3 x", "1 2 3 4 5", None]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    ok, bad = parse_edge_updates(lines, seq=F.lit(0), with_rejects=True)
    assert ok.count() == 3 and bad.count() == len(rows) - 3
    assert {r.line: r.reason for r in bad.collect()}["1 2 3 x"] == "the sequence is no number"
    # numbered lines by number, then those without one
    order = [(r.op, r.seq.number) for r in ok.orderBy("seq").collect()]
    assert order == [(1, 4), (-1, 7), (1, None)]


def test_lines_and_pairs_are_split_once_without_patterns(spark):
    """Each text is cleaned and split once a row: no pattern runs over it, the filter does not split it again."""
    from tallyrank.functions.text import adjacent_pairs, tokens
    lines = spark.createDataFrame([("k" + US + "a b" + US * 2,), ("k" + US,), (US + "t",), (US,), ("",), ("nokey",), (None,)], "value string")
    pages, rej = parse_pages(lines, with_rejects=True)
    assert sorted(tuple(r) for r in pages.collect()) == [("", "t"), ("k", "a b")]
    assert sorted(r.line for r in rej.collect() if r.line is not None) == ["", US, "k" + US, "nokey"]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("split(") == 1
    words = spark.createDataFrame([("a b a",), ("a",), ("",), ("  ",), (None,), ("x  y ",)], "text string").select(tokens("text").alias("w"))
    pairs = words.select(F.inline_outer(adjacent_pairs("w"))).filter("src IS NOT NULL")
    assert sorted(tuple(r) for r in pairs.collect()) == [("", "y"), ("a", "b"), ("b", "a"), ("x", "")]
