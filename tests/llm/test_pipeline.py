"""Pipeline stages on small documents with clashing columns, nulls and shared ids, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyrank.llm import decontaminate, langid, mixing, simhash

WORDS = [[a + b + c for a in x for b in "aeiou" for c in x] for x in ("bcd", "klm", "rst", "vwz")]
CLASH = ("rejected", "score", "lang_pred", "spans", "n_hit", "row", "fp", "root", "epoch", "key")


def text(rnd, words, n=80):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(i, text(rnd, WORDS[i % 4]), "abcd"[i % 4], "s" + str(i % 3)) for i in range(240)]
    out += [(7, text(rnd, WORDS[0]), "a", "s0"), (300, out[0][1], "a", "s0"), (None, text(rnd, WORDS[1]), "b", "s1"),
            (None, text(rnd, WORDS[2]), "c", None), (301, None, None, "s1"), (302, "", "a", "s1"), out[3], (None, out[5][1], "b", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH), F.length("text").cast("long").alias("n_chars"))


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def unchanged(df, docs):
    assert df.columns == docs.columns
    for c in CLASH:
        assert {r[0] for r in df.select(c).distinct().collect()} <= {f"own {c}"}


def test_one_text_of_every_group_stays(spark, docs, rows):
    got = P.duplicate_stage(spark, docs, "")
    unchanged(got, docs)
    # Group by brute force over all pairs of fingerprints.
    prints = [(i, t, simhash.simhash(t, 3)) for i, t, *_ in rows]
    groups: list[list] = []
    for row in prints:
        near = [g for g in groups if any(((row[2] ^ x[2]) & (1 << 64) - 1).bit_count() <= 2 for x in g)]
        groups = [g for g in groups if g not in near] + [[row] + [x for g in near for x in g]]
    want = sorted((min((i is None, i or 0, fp) for i, _, fp in g)[::2] for g in groups), key=str)
    have = sorted(((r.doc_id is None, simhash.simhash(r.text, 3)) for r in got.collect()), key=str)
    assert have == want
    assert {7} <= {r.doc_id for r in got.collect()} and got.filter("doc_id = 7").count() == 2
    assert P.duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_rejected_languages_go_and_nothing_else(spark, docs, rows):
    got = P.language_stage(spark, docs, "")
    unchanged(got, docs)
    said = langid.identify(docs, P.language_model(docs), keep=("text", "source", "rejected")).collect()
    assert plain(got) == sorted(((r.doc_id, r.text, r.source) for r in said if not r.rejected), key=str)
    assert {r.kept_rejected for r in said} == {"own rejected"} and len(said) == len(rows)
    assert not {r.text for r in got.collect()} & {None, ""} and got.count() > 200
    right = [r.lang_pred == "abcd"[r.doc_id % 4] for r in said if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 7]
    assert sum(right) >= 0.97 * len(right)


def test_hit_documents_go(spark, docs, rows, tmp):
    path = tmp("benchmark")
    item = " ".join(rows[9][1].split()[20:32])
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    got = P.benchmark_stage(spark, docs, path)
    unchanged(got, docs)
    assert plain(got) == sorted(((i, t, s) for i, t, _, s in rows if t != rows[9][1]), key=str)
    found = decontaminate.scan_documents(docs, spark.read.parquet(f"{path}/benchmark.parquet"), keep=("spans", "n_hit"))
    assert found.columns.count("spans") == 1 and found.filter("n_hit > 0").count() == 1
    assert found.select("kept_spans", "kept_n_hit").distinct().collect() == [("own spans", "own n_hit")]


def test_mix_reads_every_taken_word(spark, docs):
    mix = mixing.curriculum(docs)
    got = P.mix_stage(spark, docs, "")
    want = mix.filter("taken > 0").groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.count("*").alias("n"))
    have = got.groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.count("*").alias("n"))
    assert sorted(map(tuple, have.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_run_applies_the_stages_in_order(spark, docs, rows, tmp):
    path = tmp("corpus")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    got = P.run(spark, path)
    left = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, left, path)
    assert plain(got) == plain(P.mix_stage(spark, left, path))
    assert got.filter(F.col("text") == rows[9][1]).count() == 0
