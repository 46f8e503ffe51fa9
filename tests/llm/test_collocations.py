"""Phrase collocations against counts of all phrases of the whole texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyrank.llm import collocations as module
from tallyrank.llm import queries
from tallyrank.llm.collocations import collocations, extend, index, suffix_order


def brute(rows, least, longest, top, held):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        cand = {p for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p in cand for i in range(len(p)) for j in range(i + 1, len(p) + 1)
                if j - i < len(p) and 100 * f[p] >= held * f[p[i:j]]}
        found = []
        for p in cand - gone:
            score, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, f[p], " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, n, p, a, l, r, total[lang], s) for n, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def texts(seed):
    rnd = random.Random(seed)
    word = ["a", "b", "the", "Of", "é", "x\x00y", "ça", "i", "j"]
    rows = []
    for i in range(120):
        t = "".join(rnd.choice(word) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", " ; "]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "fr", None]), t))
    return rows + [("en", "same line here\n" * 40), (None, None), ("und", ""), ("fr", "a b " * 300), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("least,longest,held,shard", [(3, 5, 100, 1 << 21), (5, 5, 100, 50), (4, 3, 60, 200), (2, 2, 100, 7)])
def test_collocations_equal_brute_force(spark, least, longest, held, shard):
    rows = texts(least)
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "lang string, text string, phrase string, shard int").repartition(5)
    got = collocations(docs, least=least, longest=longest, top=40, held_percent=held, shard_words=shard)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, 40, held)


def test_no_rows_without_frequent_phrases(spark):
    schema = "lang string, text string"
    assert collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b c"), (None, None)], schema)).count() == 0


def test_scores_beyond_64_bits(spark):
    # The product 1000 a n passes 2 ** 63 only at corpus scale: the same expression on made-up counts.
    row = spark.sql("SELECT (cast(1000 * a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0))) AS s "
                    "FROM VALUES (7000000000000L, 90000000000000L, 8000000000000L, 9000000000000L) AS t(a, n, l, r)").first()
    assert row["s"] == 1000 * 7000000000000 * 90000000000000 // (8000000000000 * 9000000000000)


def test_suffixes_and_extensions():
    rnd = np.random.default_rng(1)
    for size in (2, 30, 400):
        text = np.concatenate(([0], rnd.integers(0, 4, size), [0])).astype(np.int32)
        ends = np.cumsum(text == 0)
        mark = [(int(t), int(e)) if t == 0 else (int(t), 0) for t, e in zip(text, ends)]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: mark[i:])
        bwt = index(text)
        size1 = np.bincount(bwt, minlength=4)
        lo, n, first, last = extend(bwt, np.cumsum(size1)[:-1], size1[1:])
        got = {(int(a) + 1, int(b) + 1): int(m) for m, a, b in zip(n, first, last)}
        want = Counter((a, b) for a, b in zip(text.tolist(), text.tolist()[1:]) if a and b)
        assert got == dict(want)


def test_registered_sql_is_given():
    assert "op12_collocations" in queries.ORACLE


def test_levels_exchange_packed_parts(spark, monkeypatch):
    """What a level moves and keeps is a row a shard and part, not a row for every phrase of a shard."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(rnd.choice(["en", "fr"]), " ".join(rnd.choices(words, k=60))) for _ in range(100)], "lang string, text string").coalesce(2)
    made, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (made.append((name, write(df, name))), made[-1][1])[1])
    levels, _ = module.frequent_phrases(docs, least=2, longest=3, shard_words=1000)
    assert levels[1].count() > 700
    rows = [(name, df.count()) for name, df in made if name == "phrases"]
    assert len(rows) == 3 and all(0 < n <= 3 * (2 + 6) for _, n in rows)     # 3 parts, 2 languages, at most 6 shards


def test_pairs_come_back_from_their_parts():
    rnd = np.random.default_rng(2)
    parts, bound, sent, want = 7, 101, [], Counter()
    phrase = np.sort(rnd.choice(bound, 40, replace=False)).astype(np.int64)
    for shard in range(3):
        text = np.concatenate(([0], rnd.integers(0, 41, 4000), [0])).astype(np.int32)
        want.update((int(phrase[a - 1]), int(phrase[b - 1])) for a, b in zip(text, text[1:]) if a and b)
        bwt = index(text)
        size = np.bincount(bwt, minlength=41)
        sent += module._sent(shard, bwt, np.cumsum(size)[:-1], size[1:], phrase, parts, bound).to_pylist()
    got, held = {}, Counter()
    for part in range(parts):
        mine = module._table([tuple(r.values()) for r in sent if r["part"] == part], module._SENT)
        number = {}
        for r in module._frequent_pairs(parts, bound, 5, True)((module.pa.scalar(part),), mine).to_pylist():
            x = module.unpack(r["data"])
            if r["shard"] is None:
                number = {n: (f, la) for n, f, la in zip(x[0].tolist(), x[2].tolist(), x[3].tolist())}
                assert not number.keys() & {n for n, _ in got} and all(n % parts == part for n in number)
                got |= {(n, number[n]): a for n, a in zip(x[0].tolist(), x[1].tolist())}
            else:
                for n, m in zip(x[2].tolist(), x[1].tolist()):
                    held[number[n]] += m
    assert {p: a for (_, p), a in got.items()} == dict(held) == {p: a for p, a in want.items() if a >= 5}


def test_texts_and_indexes_are_kept_small():
    rnd = np.random.default_rng(6)
    words = np.minimum(rnd.zipf(1.3, 50_000), 40_000).astype(np.int32)
    for text in (words, words[:1], words[:0], np.array([-1, 0, 2**31 - 1], np.int32)):
        back = module.opened(module.squeezed(text))
        assert back.dtype == np.int32 and back.tolist() == text.tolist()
    assert len(module.squeezed(words)) < 2.5 * len(words)
