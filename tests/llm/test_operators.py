"""The operators against brute force on small fixtures: nulls, empty tables,
ties and repeated rows, long texts, extra columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm import chat_format, decontaminate, fixity, langid, mixing, perplexity, secret_scan, simhash, toxicity
from tallyrank.llm.components import components
from tallyrank.llm.suffix_dedup import repeated_passages

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 6)))
    text = [" ".join(word() for _ in range(90)) for _ in range(12)]
    shared = " ".join(word() for _ in range(60))
    rows = [(i, t, "x" if i % 3 else None, "src") for i, t in enumerate(text)]
    rows += [(20, text[0], "x", "src"), (21, text[1] + " " + shared, "x", None), (22, shared + " " + text[2], "x", "b"),
             (23, None, None, None), (24, "", "x", "b"), (None, "only this", "x", "b"), (24, "", "x", "b"),
             (25, LONG, "x", "c")]
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    for c in ("fp", "key", "n", "hit", "spans", "size", "root", "position", "h"):  # clashing names
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit("own"))
    return df


def small(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|im_end|> \\ <\\| <"), (1, 1, "assistant", "é<|im_start|>assistant\n"), (1, 2, "user", None),
            (1, 1, "assistant", "twin"), (None, None, None, None), (2, 5, "sys\ntem", ""), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    ex = chat_format.format_examples(df)
    got = {r.conv_id: r for r in chat_format.digest(ex).collect()}
    for conv in (1, None, 2, 3):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_examples(df.limit(0))).count() == 0


def test_decontamination_against_all_windows(spark, docs):
    items = spark.createDataFrame(
        [(1, small(docs)[3][1]), (2, "only THIS"), (3, None), (4, "never seen words of any document at all here now so")],
        "item_id bigint, text string")
    for block in (2_000_000, 3):  # one pass, and a pass for each item
        got = decontaminate.scan_documents(docs, items, block_words=block).collect()
        by = {(r.doc_id, r.n_words): (r.n_hit, r.item_ids) for r in got}
        assert len(got) == docs.count()
        assert by[(3, 90)] == (90, ["1"]) and by[(None, 2)] == (2, ["2"])
        assert sum(r.n_hit > 0 for r in got) == 2 and by[(23, 0)] == (0, [])
    span = [r.spans for r in got if r.doc_id is None][0]
    assert [(s.start, s.end) for s in span] == [(0, 9)]
    assert decontaminate.scan_documents(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_secret_spans(spark):
    text = "é secret: token: abcdefghijklmnop password='deadbeefdeadbeef12' AKIA" + "B2" * 9 + " q7ZpKk3vX9bTfR2mWs8LdYhJ"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "q7Zp example Kk3vX9bT"), (1, text)], "doc_id int, text string")
    found = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    got = [(s.kind, text[s.start:s.end]) for s in found[1].secrets]
    assert ("assign", "password='deadbeefdeadbeef12") in got and ("hex", "deadbeefdeadbeef12") in got
    assert ("access", "AKIA" + "B2" * 9) in got and ("entropy_base64", "q7ZpKk3vX9bTfR2mWs8LdYhJ") in got
    assert not any(k == "assign" and "token" in s for k, s in got)
    assert found[2].secrets == found[3].secrets == found[4].secrets == []
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert clean[1] == "é secret: token: abcdefghijklmnop [SECRET]' [SECRET] [SECRET]" and clean[2] is None


BASE_KINDS = (("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
              ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))


def scanned(text):
    """Every span of a text, each window counted from nothing."""
    out = []
    for kind, pattern, least in BASE_KINDS:
        for m in re.finditer(pattern, text or ""):
            if len(m.group(1) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    for rank, k in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(k.pattern, text or ""):
            run = "".join(" " * len(x) if any(re.search(p, x) for p in secret_scan.ALLOW_PIECES) else x
                          for x in re.findall(r"[/_+=-]+|[^/_+=-]+", m.group()))
            for c in re.finditer(r"[^ ]{%d,}" % k.width, run):
                if any(re.search(p, c.group()) for p in secret_scan.ALLOW):
                    continue
                high = []
                for i in range(len(c.group()) - k.width + 1):
                    window = c.group()[i:i + k.width]
                    h = -sum(n / k.width * math.log2(n / k.width) for n in (window.count(x) for x in set(window)))
                    if h >= k.threshold - 1e-9:
                        high.append(i)
                if high:
                    at = m.start() + c.start()
                    out.append((at + high[0], rank, at + high[-1] + k.width, k.kind))
    return sorted(out)


def test_secrets_against_a_scan_of_every_window(spark):
    rnd, base64 = random.Random(11), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    key = "q7ZpKk3vX9bTfR2mWs8LdYhJ"
    texts = [None, "", f"é example/{key} dummy-{key} {key}_sample_{key[::-1]} sample{key}", f"other/{key}", "a" * 30_000 + "1" + key * 40,
             "123e4567-e89b-12d3-a456-426614174000 0123456789" * 3, "deadbeef" * 9, " ".join([key] * 400)]
    for alphabet in (base64, "0123456789abcdef", "ab01/", base64 + " \n😀=:\"'"):
        texts += ["".join(rnd.choices(alphabet, k=rnd.randint(20, 400))) for _ in range(25)]
    texts += [f"{w}{e}{s}{''.join(rnd.choices(base64, k=40))}" for w in ("Token", "api_key", "x") for e in ("=", ": ") for s in ("", "example/", "'")]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] * 2, "doc_id int, text string, secrets int")
    got = secret_scan.find_secrets(df).collect()
    assert len(got) == 2 * len(texts) and all(r.kept_secrets == r.doc_id for r in got)
    for r in got:
        assert [tuple(x) for x in r.secrets] == scanned(r.text), r.text
    assert [(x.start, x.end) for x in got[2].secrets if x.kind == "entropy_base64"][0][1] == 2 + len("example/" + key)
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def brute_components(pairs):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(pairs, "u bigint, v bigint"))
    assert {r.node: r.root for r in got.collect()} == brute_components(pairs)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_simhash_against_all_pairs(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    rows = [(i, simhash.simhash(t)) for i, t in small(docs)]
    ids = {i for i, _ in rows if i is not None}
    comp = brute_components([(a, b) for a, x in rows for b, y in rows if a in ids and b in ids
                             and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == comp
    assert comp[20] == 0 and comp[24] == 23


@pytest.mark.parametrize("bits", [1, 2])
def test_crowded_blocks_lose_no_link(spark, bits):
    rnd, fps = random.Random(1), set()
    for base in (rnd.getrandbits(62), rnd.getrandbits(62)):
        for _ in range(60):
            fps.add(base ^ sum({1 << rnd.randrange(62) for _ in range(rnd.randint(0, 3))}))
    want = brute_components([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= bits])
    got = components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), bits, crowd=4)).collect()
    assert {r.node: r.root for r in got} == {x: r for x, r in want.items() if sum(v == r for v in want.values()) > 1}


def test_repeated_passages_against_all_windows(spark, docs):
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(docs).collect()}
    assert {(0, 0, 90), (20, 0, 90), (1, 0, 90), (21, 0, 150), (22, 0, 150), (2, 0, 90)} <= got
    assert {g[0] for g in got} == {0, 1, 2, 20, 21, 22, 25}
    assert repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_repeated_passage_is_lost_among_mixed_contexts(spark, seed):
    """Few words, so k-grams recur with contexts that agree on either side; many
    small partitions and batches, so they also recur across those."""
    rng, n, conf = random.Random(seed), 8, {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "6",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([5, 8, 30, 60]))) for _ in range(60)]
    want, seen = set(), {}
    for i, t in enumerate(texts):
        for p in range(len(t.split()) - n + 1):
            seen.setdefault(tuple(t.split()[p:p + n]), set()).add((i, p))
    for places in seen.values():
        if len(places) > 1:
            want |= {(i, w) for i, p in places for w in range(p, p + n)}
    old = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        rows = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (99, "")], "doc_id int, text string")
        got = repeated_passages(rows, min_words=n, window=5).collect()
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert {(r.doc_id, w) for r in got for w in range(r.start_word, r.end_word)} == want


def test_base_counts_and_quality(spark, docs):
    assert perplexity.base_counts("a b c\n\na b c\nx") == (7, 7, 0, 1, 6)
    assert perplexity.base_counts(None) == perplexity.base_counts("") == (0, 0, 0, 0, 0)
    got = perplexity.quality(docs, block=500).collect()  # several blocks
    one = perplexity.quality(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, round(r.log_perplexity or 0, 6), r.kept)
    assert sorted(map(key, got)) == sorted(map(key, one)) and len(got) == docs.count()


def test_kneser_ney_sums_to_one(spark):
    text = "abracadabra alakazam abracadabra"
    top = perplexity.count_grams(spark.createDataFrame([("x", text), (None, text), ("x", None)], "lang string, text string"), 3)
    model = {(r.lang, r.g): math.exp(r.logp) for r in perplexity.kneser_ney(top, 3).collect()}
    assert all(0 < p <= 1 for p in model.values()) and {k[0] for k in model} == {"x", None}
    by_ctx = {}
    for (lang, g), p in model.items():
        by_ctx[lang, g >> 8] = by_ctx.get((lang, g >> 8), 0) + p
    assert all(p <= 1 + 1e-6 for p in by_ctx.values())


def test_quality_rejects_junk_and_foreign_texts(spark):
    rnd = random.Random(11)

    def speech(syllables: str, little: str):
        """Zipf-like: a few short words, and longer ones of which many are new."""
        many = ["".join(rnd.choices(syllables.split(), k=rnd.randint(2, 4))) for _ in range(400)]
        return lambda n: [rnd.choice(little.split()) if rnd.random() < 0.5 else
                          rnd.choice(many) if rnd.random() < 0.7 else
                          "".join(rnd.choices(syllables.split(), k=4)) for _ in range(n)]
    a, b = speech("tion er ing the an re ed", "of the and to in"), speech("ung keit sch ein ver zu", "der die und das von")
    rows = [(f"a{i}", " ".join(a(200)), "a") for i in range(80)] + [(f"b{i}", " ".join(b(200)), "b") for i in range(80)]
    rows += [("symbols", " ".join(w + rnd.choice(["%%%", "$$$", "###"]) for w in a(200)), "a"),
             ("menu", " | ".join(a(200)), "a"), ("foreign", " ".join(b(200)), "a"), ("foreign2", " ".join(a(200)), "b")]
    kept = {r.doc_id: r.kept for r in perplexity.quality(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    assert not any(kept[x] for x in ("symbols", "menu", "foreign", "foreign2"))
    assert sum(kept[r[0]] for r in rows[:160]) >= 156


def _scores_by_hand(rows):
    """Log probability per said word of every text under the other half's bigram
    model, with dictionaries of words instead of packed hashes."""
    texts = [((t or "").lower().split(), lang) for _, t, lang in rows]
    side = [perplexity.half(perplexity.grams(t, 2)) if t else 0 for _, t, _ in rows]
    pairs = [list(zip(["<"] + w, w + [">"])) if w else [] for w, _ in texts]
    models = {}
    for key in {(lang, h) for (_, lang) in texts for h in (0, 1)}:
        two = Counter(p for ps, (_, lang), h in zip(pairs, texts, side) if (lang, h) == key for p in ps)
        one = Counter(w for _, w in two)
        discount = []
        for n in (one, two):
            c = [sum(x == i for x in n.values()) for i in (1, 2, 3, 4)]
            y = c[0] / max(1, c[0] + 2 * c[1])
            discount.append([max(0.1, min(i - (i + 1) * y * c[i] / c[i - 1] if c[0] and c[i - 1] else 0.5 * i, i - 0.05)) for i in (1, 2, 3)])
        taken = [lambda n, d=d: d[min(n, 3) - 1] if n else 0.0 for d in discount]
        total = sum(one.values())
        spare = sum(map(taken[0], one.values())) / total / (len(one) + 1) if total else 1.0
        after = {}
        for (v, _), n in two.items():
            after.setdefault(v, []).append(n)

        def p(v, w, one=one, two=two, taken=taken, total=total, spare=spare, after=after):
            low = spare + ((one[w] - taken[0](one[w])) / total if total else 0.0)
            if v not in after:
                return low
            n = two[v, w]
            return (n - taken[1](n) + sum(map(taken[1], after[v])) * low) / sum(after[v])
        models[key] = p
    out = []
    for ps, (words, lang), h in zip(pairs, texts, side):
        said = max(1, sum(any(c.isalnum() for c in w) for w in words))
        out.append(-sum(math.log(models[lang, 1 - h](v, w)) for v, w in ps) / said if ps else None)
    return out


def test_quality_scores_equal_a_model_by_hand(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 90), weights=[1 / (j + 1) for j in range(60)])), rnd.choice(["a", "b", None]))
            for i in range(80)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "only one of its language", "c"), (103, " ".join(["w1"] * 3000), "a"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    want = sorted((i, -1.0 if x is None else round(x, 4)) for (i, _, _), x in zip(rows, _scores_by_hand(rows)))
    for block, at_once in ((4_000_000, 4), (200, 2)):
        got = sorted((r.doc_id, -1.0 if r.log_perplexity is None else r.log_perplexity)
                     for r in perplexity.quality(docs, block=block, at_once=at_once).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert max(abs(g[1] - w[1]) for g, w in zip(got, want)) < 2e-4
    monkeypatch.setattr(perplexity, "SLICE", 64)      # long texts in several pieces
    side, pieces = perplexity.half(perplexity.grams(rows[1][1] * 9, 2)), list(
        perplexity._runs([(0, "a", perplexity.grams(rows[1][1] * 9, 2)), (1, "b", perplexity.grams("", 2))]))
    assert sum(len(g) for _, _, g, _ in pieces) == len(perplexity.grams(rows[1][1] * 9, 2))
    assert all(h == side and len(g) <= 64 for _, h, g, _ in pieces) and len(pieces) > 1


def test_small_languages_share_a_band_and_empty_tables_pass(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"{lang}{i}", " ".join(rnd.choices(words, k=120)), lang) for lang in ("a", "b", "c", None) for i in range(9)]
    rows += [(f"d{i}", " ".join(rnd.choices(words, k=120)), "d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").withColumn("low", F.lit("clash"))
    got = {r.doc_id: r for r in perplexity.quality(docs).collect()}
    bands = {(r.low, r.high) for x, r in got.items() if x[0] != "d"}
    assert len(got) == len(rows) and len(bands) == 1 and None not in next(iter(bands))
    assert {(r.low, r.high) for x, r in got.items() if x[0] == "d"} != bands
    few = perplexity.quality(docs.filter("lang = 'a'")).collect()
    assert all(r.kept and r.low is None for r in few) and len(few) == 9
    assert perplexity.quality(docs.filter("false")).collect() == []


def test_model_is_of_words_and_of_other_texts():
    """A word is one symbol whatever its length, and the longest words count whole."""
    g = perplexity.grams("Alpha beta alpha beta", 2)
    assert len(g) == 5 and g[1] == g[3] and len(perplexity.grams("x" * 1000, 2)) == 2
    assert perplexity.said_words("a | b ### 7 é") == 4
    text = " ".join(map(str, range(300)))
    assert perplexity.half(perplexity.grams(text, 2)) == perplexity.half(perplexity.grams(text.upper(), 2))


def test_audit_finds_exactly_the_damage(spark):
    rows = [(f, o * 100, bytes([f, o % 251]) * 20) for f in range(3) for o in range(300)] + [(1, 500, None)]
    bad = [r for r in rows if r[:2] != (0, 700)] + [(2, 999_900, b"new")]
    bad = [(f, o, b"rot" if (f, o) == (1, 20_000) else x) for f, o, x in bad]
    schema = "file int, offset bigint, record binary"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(bad, schema)
    got = {(r.file, r.offset, r.status) for r in fixity.audit(a, b, span=1000, fanout=4).collect()}
    assert got == {(0, 700, "missing"), (2, 999_900, "extra"), (1, 20_000, "changed")}
    assert fixity.audit(a, a, span=1000, fanout=4).count() == 0
    assert fixity.audit(a, a.limit(0)).filter("status = 'missing'").count() == 900


def test_warc_records_are_whole(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nb", "é"), (1, "http://a/\r\nb", "é"), (2, None, None), (3, "http://c", LONG)],
                                  "page_id int, url string, html string").withColumnRenamed("page_id", "file").coalesce(1)
    got = fixity.warc_records(pages, page_id="file", date="2020-02-02T00:00:00Z").collect()
    assert [r.offset for r in got] == [sum(len(x.record) for x in got[:i]) for i in range(len(got))]
    for r in got:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        first, *fields = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in fields)
        assert first == "WARC/1.1" and fields["WARC-Date"] == "2020-02-02T00:00:00Z"
        assert {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= set(fields)
        assert len(body) == int(fields["Content-Length"]) + 4 and body.endswith(b"\r\n\r\n")
    assert fixity.warc_records(pages.limit(0), page_id="file").count() == 0


def test_language_model_learns_and_rejects():
    rnd, shape = random.Random(2), langid.Shape(buckets=1 << 10, dim=8)
    said = {"a": "the and of with that", "b": "der und die mit das"}
    rows = [(k, langid.subwords(" ".join(rnd.choices(v.split(), k=12)), shape)) for k, v in said.items() for _ in range(60)]
    rnd.shuffle(rows)
    m = langid.fit(rows, shape)
    assert m.predict("THE WITH of")[0] == "a" and m.predict("und die das")[0] == "b"
    assert m.predict(None) == m.predict("123 !?") == ("und", 0.0, True)
    assert 0 < m.threshold <= 0.5


def test_unseen_languages_are_rejected_and_held_out_documents_stay(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.train(docs, langid.remainder() != 1)
    held = langid.identify(docs.filter(langid.remainder() == 1), m, keep=("lang",)).filter("lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98 and np.mean([r.rejected for r in held]) < 0.02
    unseen = ["il governo ha deciso di aumentare le tasse sulla casa e molti cittadini sono scesi in piazza",
              "de regering heeft besloten om de belasting op huizen te verhogen en veel burgers gingen de straat op",
              "hallitus on päättänyt korottaa asuntojen veroa ja monet kansalaiset lähtivät kadulle",
              "rząd postanowił podnieść podatek od domów i wielu obywateli wyszło na ulice"]
    rows = [(i, x, "own") for i, x in enumerate(unseen)] * 2 + [(8, None, "own"), (9, "", None), (10, "12 34 !", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, score string")
    got = langid.identify(df, m, keep=("score",)).collect()
    assert len(got) == len(rows) and all(r.rejected for r in got) and {r.kept_score for r in got} == {"own", None}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id >= 8)
    assert langid.identify(df.limit(0), m).count() == 0
    none = langid.train(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(df, none).collect()} == {("und", 0.0, True)}


def test_ordinal_severity():
    rnd = random.Random(3)
    text = lambda g: " ".join(rnd.choices("xa xb xc xd xe".split(), k=20) + ["bad"] * (g > 0) + ["awful"] * (g > 1))
    hasher = toxicity.WordHasher(toxicity.no_letter())
    m = toxicity.fit([(toxicity.features(hasher, text(g)), g) for g in [0, 0, 0, 1, 2] * 60])
    e = [m.above(toxicity.features(hasher, t)).sum() for t in ("xa", "xa BAD,", "bad awful")]
    assert e[0] < 0.3 < e[1] < 1.5 < e[2] and list(m.thresholds) == sorted(m.thresholds)
    assert toxicity.fit([]).above(np.zeros(0, np.int64)).sum() == 0


def test_marker_of_a_small_language_is_learnt_and_copies_are_not():
    rnd, hasher = random.Random(8), toxicity.WordHasher(toxicity.no_letter())
    word = lambda: "".join(rnd.choices("abcdefghijkl", k=7))
    # 30 toxic texts in 3000 rows share no word, only how a word begins.
    rows = [(" ".join(word() for _ in range(30)), 0) for _ in range(2700)]
    rows += [(" ".join([*(word() for _ in range(30)), "xidiot"]), 1) for _ in range(270)]
    rows += [(" ".join([*(word() for _ in range(30)), "réeux" + word()]), 1) for _ in range(30)]
    copied = [word() for _ in range(40)]
    rows += [(" ".join(copied[:i] + copied[i + 1:]), 1) for i in range(12)]
    m = toxicity.fit([(toxicity.features(hasher, t), g) for t, g in rows])
    says = lambda t: m.above(toxicity.features(hasher, t)).sum()
    assert says("some réeuxnever words") > 0.5 and says("some xidiot words") > 0.5
    assert says("some words") < 0.5 and says(" ".join(copied[:3])) < 0.5


def test_curriculum_meets_targets(spark, docs):
    mix = mixing.curriculum(docs, range_rows=3).collect()
    per = {}
    for r in mix:
        assert 0 <= r.taken <= r.size and (r.position is None) == (r.taken == 0)
        s = per.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
    total = sum(s[0] for s in per.values())
    assert all(abs(t - got) < 1 and t <= 3 * n + 1e-9 for n, t, got in per.values())
    assert sum(s[1] for s in per.values()) == pytest.approx(total)
    assert [r.position for r in mix if r.position is not None] == sorted(r.position for r in mix if r.position is not None)
    assert mixing.curriculum(docs.limit(0)).count() == 0
    read = mixing.in_order(docs, mixing.curriculum(docs)).collect()
    assert {r.doc_id for r in read} == {r.doc_id for r in mix if r.taken}


def test_pipeline_stages_keep_the_columns(spark, docs):
    import corpus_pipeline as P
    plain = docs.select("doc_id", "text", "lang", "source")
    kept = P.duplicate_stage(spark, plain, "").collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == [*range(12), 21, 22, 23, 25] and ids.count(None) == 1
    assert P.secret_stage(spark, plain, "").columns == plain.columns
    assert not re.search("limit|sample", str(P.STAGES))


def test_model_lookups_are_sorted_and_distinct(monkeypatch):
    rnd = np.random.default_rng(3)
    found = [rnd.integers(0, 40, 300) << 31 | rnd.integers(0, 30, 300) for _ in range(6)]
    langs = ["a", "b", None, "a", "b", "a"]
    tagged = {(la, tag): {int(h): n for n, h in enumerate(perplexity.hashed(la, tag, np.arange(40)).tolist())}
              for la in set(langs) for tag in (1, -2)}
    model = {h: float(n + 1) for part in tagged.values() for h, n in part.items()}
    hashes = np.array(sorted(model), np.uint64)
    up = np.array([model[h] for h in hashes.tolist()], np.float32)
    blocks = perplexity.Blocks.__new__(perplexity.Blocks)
    blocks.sent, blocks.opened = [], (hashes, np.array([up, -up]))
    asked = rnd.permutation(np.concatenate([hashes, hashes[:9], np.arange(5, dtype=np.uint64)]))
    both = blocks.find(asked)
    want = np.array([model.get(h, np.nan) for h in asked.tolist()], np.float32)
    assert np.array_equal(both, [want, -want], equal_nan=True)

    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: (looked.append(np.asarray(v)), search(a, v, *rest))[1])
    got = perplexity._sums(blocks, 2, langs, found)
    monkeypatch.undo()
    for total, la, g in zip(got, langs, found):
        sign = 1 if perplexity.half(g) else -1
        one, ctx = tagged[la, 1], tagged[la, -2]
        (a, b), key = np.divmod(g, 1 << 31), lambda t, x: int(perplexity.hashed(la, t, np.array([x]))[0])
        assert total == sign * sum(one[key(1, x)] + 1 for x in b.tolist()) + sign * sum(ctx[key(-2, x)] + 1 for x in a.tolist())
    assert looked and all((v[1:] >= v[:-1]).all() for v in looked)
    assert sum(len(v) < 50 and len(np.unique(v)) == len(v) for v in looked) * 3 == len(looked) * 2
    assert np.array_equal(blocks.find(asked, 1), -want, equal_nan=True)


def test_counts_of_a_part_merge_in_pieces(monkeypatch):
    """One very common context beside many rare ones, from many tasks, in bounded memory."""
    monkeypatch.setattr(perplexity, "HELD", 200)
    monkeypatch.setattr(perplexity, "PIECE", 8)
    rnd = np.random.default_rng(4)
    want, rows = [Counter(), Counter()], []
    for task in range(40):
        ctx = np.where(rnd.random(120) < 0.6, 500, rnd.integers(1, 1000, 120))
        g, n = np.unique(ctx << 31 | rnd.integers(0, 400, 120), return_counts=True)
        want[task % 2].update(dict(zip(g.tolist(), n.tolist())))
        rows += [(first, task % 2, data) for _, first, data in perplexity._blobs(g, n, 2, 31, 1)]
    part, out, most = perplexity._Part(2, 31, True), [], 0
    for first, side, data in sorted(rows):
        out += part.add(side, first, data)
        most = max(most, part.size + len(part.g))
    out += part.closed()
    assert most < 1000 < len(rows) * 4 < sum(map(len, want))
    shared, ctx, told = set(want[0]) & set(want[1]), [], {}
    assert sum(what == "own" for _, what, *_ in out) > 5
    for side, what, data, contexts, size in out:
        if what != "own":
            continue
        x, c = perplexity.unpack(data), perplexity.unpack(contexts)
        assert size == x.shape[1] + (0 if side else c.shape[1]) and set((x[0] >> 31).tolist()) <= set(c[0].tolist())
        ctx += [] if side else c[0].tolist()
        for i in range(c.shape[1]):
            for h in (0, 1):
                counts = [n for g, n in want[h].items() if g >> 31 == c[0, i]]
                assert c[1 + 4 * h:5 + 4 * h, i].tolist() == [sum(counts), counts.count(1), counts.count(2), sum(n > 2 for n in counts)]
        for g, a, b in x.T.tolist():
            assert g not in told and (want[0][g], want[1][g]) == (a, b)
            told[g] = 1
    assert set(told) == shared and sorted(ctx) == sorted({g >> 31 for g in want[0]} & {g >> 31 for g in want[1]})
    for h in (0, 1):
        sums, = (perplexity.unpack(data)[0].tolist() for side, what, data, *_ in out if what == "sums" and side == h)
        assert sums == [*(list(want[h].values()).count(i) for i in (1, 2, 3, 4)), sum(want[h].values()), len(want[h])]
        low = Counter()
        for side, what, data, *_ in out:
            if what == "n" and side == h:
                low.update(dict(perplexity.unpack(data).T.tolist()))
        assert low == Counter(g & (1 << 31) - 1 for g in want[h])


def test_one_process_scores_with_any_number_of_blocks(spark, monkeypatch):
    rnd, plans, cut = random.Random(8), [], perplexity.cut
    rows = [(i, " ".join(f"w{int(rnd.random() ** 2 * 90)}" for _ in range(80)), rnd.choice(["a", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    monkeypatch.setattr(perplexity, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    got = [sorted((r.doc_id, round(r.log_perplexity, 6), r.kept) for r in perplexity.quality(docs, block=block, at_once=at_once).collect())
           for block, at_once in ((100, 3), (2_000_000, 8))]
    assert got[0] == got[1] and len(got[0]) == 60
    from pathlib import Path
    from urllib.parse import urlparse

    from tallyrank.llm.tables import shared_root
    assert not list(Path(urlparse(shared_root(spark)).path).glob("quality-*"))       # steps in between are gone
    assert [p.count("MapInArrow") for p in plans if "logp" in p and "Aggregate" not in p] == [1, 1]

    h = np.sort(rnd_hashes := np.random.default_rng(1).integers(0, 2 ** 63, 500).astype(np.uint64))
    v = np.random.default_rng(2).normal(size=(2, 500)).astype(np.float32)
    sent = [type("Sent", (), {})() for _ in range(5)]
    for i, x in enumerate(sent):
        x.value = x._value = [perplexity._sealed(h[i * 100 + j:i * 100 + j + 50], v[:, i * 100 + j:i * 100 + j + 50]) for j in (0, 50)]
    blocks = perplexity.Blocks.__new__(perplexity.Blocks)
    blocks.sent, blocks.opened = sent, None
    at = np.searchsorted(h, rnd_hashes)
    assert np.array_equal(blocks.find(rnd_hashes), v[:, at]) and np.isnan(blocks.find(rnd_hashes + np.uint64(1), 0)).all()
    assert not any("_value" in vars(x) for x in sent) and perplexity._opened(perplexity._sealed(h[:0], v[:, :0]))[0].size == 0
