"""BPE by tree concatenation and periodic runs, against the plain way on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyrank.llm import bpe_tree, queries
from tallyrank.llm.periodic_runs import kept_words, periodic_runs, runs

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_parts_joined_equal_the_whole_word(plain):
    codec, rnd = bpe_tree.Codec(open(PATH, encoding="utf-8").read()), random.Random(7)
    for alphabet in ("ab", "theins", "aé中"):
        for _ in range(150):
            w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 60)))
            symbols = "".join(x for _, x in codec.words(w))
            at = rnd.randint(1, len(symbols) - 1)
            assert codec.join(codec.word(symbols[:at], False), codec.word(symbols[at:], True), True) == plain[0](w)


def bpe_rows():
    rnd = random.Random(3)
    bits = ["a", "the", "é", "中文", "'s", "!", " ", "\n", "<|endoftext|>", "<|endof", "́", " ", "12", "İ", "Σ"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    texts += ["a" * 3000, "word " * 900, "x" * 500 + " " + "ab" * 700, None, "", " ", "中" * 400, "a" * 3000]
    return [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 16])
def test_whole_texts_equal_the_library(spark, plain, piece):
    rows = bpe_rows()
    docs = spark.createDataFrame([(*r, "own", 1, "own") for r in rows], "doc_id bigint, text string, ids string, row int, decoded string")
    got = bpe_tree.encode(docs, PATH, piece=piece).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, plain[0](t), plain[1](plain[0](t))) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(want, key=key)


def test_bpe_of_an_empty_table(spark):
    assert bpe_tree.encode(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_query(spark, plain, tmp):
    path = tmp("bpe")
    spark.createDataFrame(bpe_rows(), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11(spark, path).filter("doc_id IS NOT NULL").collect())
    ids = [(i, plain[0](t)) for i, t in bpe_rows() if i is not None]
    assert got == sorted((i, len(x), sha(" ".join(map(str, x))), sha(plain[1](x))) for i, x in ids)


def brute_runs(w, shortest=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            at = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > at and i - at + q >= max(shortest, 2 * q):
                best.setdefault((at - q, i), q)
            i += i == at
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def sequences():
    rnd = random.Random(11)
    yield []
    for _ in range(60):
        yield [rnd.randrange(2) for _ in range(rnd.randint(1, 120))]
        yield sum(([0] * rnd.randint(1, 40) + [1] for _ in range(rnd.randint(1, 6))), [])
        block = [rnd.randrange(3) for _ in range(rnd.randint(1, 9))]
        yield sum(((block * 9)[:rnd.randint(1, 60)] + [rnd.randrange(4)] * rnd.randint(0, 2) for _ in range(5)), [])
    yield [bin(i).count("1") % 2 for i in range(300)]
    yield [0] * 700


@pytest.mark.parametrize("shortest", [1, 2, 5, 12, 20])
def test_runs_equal_all_lags(shortest):
    for w in sequences():
        assert [tuple(r) for r in runs(np.array(w, np.int64), shortest).tolist()] == brute_runs(w, shortest), w


def test_a_million_equal_words_and_unequal_blocks_of_them():
    assert runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    blocks = np.concatenate([np.append(np.zeros(n, np.int64), 1) for n in (40_000, 70_000, 55_000)])
    assert [40_001, 70_000, 1] in runs(blocks).tolist()


def test_kept_words():
    assert kept_words(14, np.array([[1, 12, 3]])).tolist() == [True] * 4 + [False] * 9 + [True]
    assert kept_words(3, np.zeros((0, 3), np.int64)).all()


def test_runs_on_spark(spark):
    rows = [(1, "a b c " * 6 + "end"), (1, "a b c " * 6 + "end"), (2, None), (3, ""), (None, " x\t\ny "), (4, "w " * 100_000)]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id int, text string, runs string, collapsed string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, [(0, 18, 3)], "a b c end")] * 2 + [(2, [], ""), (3, [], ""), (None, [], "x y"), (4, [(0, 100_000, 1)], "w")], key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_runs_query(spark, tmp):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abcdef") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(i, t) for i, t in enumerate([None, "", " \x0b ", "one", "x\x1fy z " * 30] * 9, 1000)]
    path = tmp("runs")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    want, repeated = [], 0
    for i, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            repeated += 1
        found = brute_runs(w)
        drop = {x for s, length, q in found for x in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
                     sha(b" ".join(x for k, x in enumerate(w) if k not in drop).decode())))
    assert repeated > 5
    assert sorted(tuple(r) for r in queries.op13(spark, path).collect()) == sorted(want)
