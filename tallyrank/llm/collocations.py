"""Phrase collocations from an FM-index per shard of the texts.

1. Tasks cut their texts into pieces at punctuation and pieces into words, and
   pack them by language as word numbers (a piece is never cut) with the words
   they number.
2. Packs are dealt over shards by the running sum of their sizes: a shard has at
   most twice ``shard_words`` words (and one text), whatever share a language has.
   The words of all packs meet by parts of their hash, where their counts are
   summed. Words of ``least`` occurrences get a number for the whole corpus, every
   shard learns those it holds, and all others end a piece there: no phrase that
   counts can hold them.
3. A shard's index is the Burrows-Wheeler transform of its words, from a full
   suffix sort in which every end of a piece is a symbol of its own. A phrase is
   an interval of suffixes. Extension to the left follows the LF mapping of the
   interval's rows; what the extension is on the other side, an extension to the
   right of its first words, is read off the interval of those words that
   holds it, which a second index over reversed texts would give as well.
4. Level by level (two words, three, up to ``longest``) all shards extend the
   intervals of the phrases that are frequent in the whole corpus, and keep an
   extension if its first words and its last words are both frequent phrases.
   A phrase is a pair of numbers: those of its first and of its last words one
   word shorter. Shards send their pairs as sorted differences, a few bytes each, to
   parts that neither a frequent first nor a frequent last word overfills; a part
   sums the counts, numbers pairs of ``least`` or more and sends every shard its own.
5. Frequent phrases carry the counts of all their beginnings and endings, from
   level to level, so every cut is scored from one row; the greatest count of an
   extension by one word to either side tells whether a longer phrase holds
   nearly all of a phrase's occurrences.

Indexes are one table in the shared folder, bucketed by shard, so a level moves
phrases only. There are as many parts as the words ask for (``2 * shard_words``
each at most, before equal ones are summed). Nothing is broadcast but what Spark itself measures as small and
the shard of every pack (two numbers a pack, counted first).

Null languages are ``und``; null and empty texts have no words; repeated rows
and rows of one id count each; ties in a language's order cannot occur, since
its phrases differ; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from ..session import broadcast_if_small, cut_lineage_bucketed, shuffle_partitions
from .perplexity import pack, unpack
from .tables import cut, map_batches, shuffles_removed, written

#: Ends of pieces become line feeds, A-Z becomes a-z.
_TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def squeezed(symbols: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of their bytes."""
    return zlib.compress(np.ascontiguousarray(symbols.astype(np.int32).view(np.uint8).reshape(-1, 4).T), 1)


def opened(data: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.array(b.reshape(4, -1).T, order="C").view(np.int32).ravel()


class _Numbers(dict):
    """Numbers words from 1 in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class _Shard:
    def __init__(self):
        self.number, self.words = _Numbers(), array("i")

    def add(self, text: str | None) -> int:
        before, get = len(self.words), self.number.__getitem__
        for piece in text.encode("utf-8").translate(_TABLE).split(b"\n") if text else ():
            words = piece.split()
            if words:
                self.words.extend(map(get, words))
                self.words.append(0)
        return len(self.words) - before


def _pack(shard_words: int):
    """Rows ``(pack, lang, words, counts, text)``: the distinct words of a pack, how
    often each occurs, and the text as word numbers (``squeezed``), 0 after each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, total = TaskContext.get().partitionId() << 32, {}, 0

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made, total
            s = held.pop(lang)
            text = np.array(s.words, np.int32)
            total -= len(text)
            made += 1
            counts = np.bincount(text, minlength=len(s.number) + 1)[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([lang]), pa.array([[w.decode("utf-8") for w in s.number]], pa.list_(pa.string())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([squeezed(text)], pa.binary())],
                names=["pack", "lang", "words", "counts", "text"])
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard = held.setdefault(lang, _Shard())
                total += shard.add(text.as_py())
                if len(shard.words) >= shard_words:
                    yield out(lang)
                elif total >= 2 * shard_words:
                    yield out(max(held, key=lambda x: len(held[x].words)))
        for lang in list(held):
            yield out(lang)
    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; every 0 is a symbol of its own, less than the others."""
    n, ends = len(text), text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * n
        key[:-step] += rank[step:]              # a suffix that is shorter has an end before and is alone
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def index(text: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of ``text``, which begins and ends with 0."""
    return text[suffix_order(text) - 1]


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """The row of the suffix one word longer, for rows whose word is not 0."""
    out = np.empty(len(bwt), np.int32)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    return out


def extend(bwt: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of all phrases one word longer than those of the (disjoint) intervals
    ``lo``, ``size`` whose first and last words are among these:
    ``(lo, size, first, last)``, the last two as numbers of given intervals."""
    begins, ends = np.full(len(bwt), -1, np.int32), np.full(len(bwt), -1, np.int32)
    who = np.repeat(np.arange(len(lo), dtype=np.int32), size)
    rows = np.arange(len(who), dtype=np.int32) + np.repeat((lo - (np.cumsum(size) - size)).astype(np.int32), size)
    begins[rows] = who
    more = bwt[rows] != 0
    ends[last_to_first(bwt)[rows[more]]] = who[more]
    at = np.flatnonzero((begins >= 0) & (ends >= 0))
    if not len(at):
        return at, at, at, at
    new = np.flatnonzero(np.insert((begins[at[1:]] != begins[at[:-1]]) | (ends[at[1:]] != ends[at[:-1]]), 0, True))
    first = at[new]
    return first, np.diff(np.append(new, len(at))), begins[first], ends[first]


_SENT = "shard bigint, part int, data binary"
_SPELLED = "pack bigint, shard bigint, lang string, part int, data binary, words binary"
#: What a part makes: its frequent phrases (no shard) and, for each shard, those it holds.
_MERGED = "shard bigint, lang string, words binary, data binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _groups(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``of`` with its places, in order."""
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=of[order[:1]] - 1))
    for rows in np.split(order, starts[1:]) if len(order) else ():
        yield int(of[rows[0]]), rows


def _spelled(parts: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The words of packs by part: place in the pack and count, and the words."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for of, shard, lang, words, n in zip(*(b.column(c) for c in ("pack", "shard", "lang", "words", "counts"))):
            lang, words, n = lang.as_py(), words.values.cast(pa.binary()).to_pylist(), n.values.to_numpy()
            salt = zlib.crc32(lang.encode("utf-8"))
            part = np.fromiter((zlib.crc32(w, salt) for w in words), np.int64, len(words)) % parts
            out += [(of.as_py(), shard.as_py(), lang, i, pack(at + 1, n[at]), zlib.compress(b"\n".join([words[j] for j in at.tolist()]), 1))
                    for i, at in _groups(part)]
        return _table(out, _SPELLED).combine_chunks().to_batches()[0] if out else None
    return run


def _frequent_words(parts: int, least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Counts and numbers of the words of a part: by language ``(phrase, a)`` with the
    words, and for each shard ``(pack, at, phrase)``."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        data, langs = [unpack(x) for x in t.column("data").to_pylist()], t.column("lang").to_pylist()
        at, n = np.concatenate(data, axis=1)
        of = np.repeat(np.arange(len(data)), [x.shape[1] for x in data])
        words = pa.chunked_array([pa.array(zlib.decompress(x).split(b"\n"), pa.large_binary()) for x in t.column("words").to_pylist()])
        words = words.combine_chunks().dictionary_encode()
        names = sorted(set(langs))
        lang = np.searchsorted(names, langs)[of] if len(names) > 1 else np.zeros(len(of), np.int64)
        every, which = np.unique(lang * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True)
        a = np.bincount(which, n).astype(np.int64)
        known, number = np.flatnonzero(a >= least), np.full(len(a), -1, np.int64)
        number[known] = np.arange(len(known)) * parts + key[0].as_py()
        lang_of, word_of = np.divmod(every[known], len(words.dictionary))
        out = []
        for i, rows in _groups(lang_of):
            spelled = words.dictionary.take(pa.array(word_of[rows])).to_pylist()
            out.append((None, names[i], zlib.compress(b"\n".join(spelled), 1), pack(number[known[rows]], a[known[rows]])))
        mine = np.flatnonzero(number[which] >= 0)
        shard, packs = (t.column(c).to_numpy()[of[mine]] for c in ("shard", "pack"))
        for i, rows in _groups(shard):
            rows = rows[np.argsort(packs[rows], kind="stable")]
            out.append((i, None, None, pack(packs[rows], at[mine[rows]], number[which[mine[rows]]])))
        return _table(out, _MERGED)
    return run


def _words(b: pa.RecordBatch) -> pa.RecordBatch:
    """Frequent words of a part as rows."""
    number, a = unpack(b.column("data")[0].as_py())
    words = zlib.decompress(b.column("words")[0].as_py()).split(b"\n")
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array([b.column("lang")[0].as_py()] * len(a), pa.string()),
                                       pa.array(words, pa.binary()).cast(pa.string()), pa.array(a)], names=["phrase", "lang", "word", "a"])


def _sent(shard: int, bwt: np.ndarray, lo: np.ndarray, size: np.ndarray, phrase: np.ndarray, parts: int, bound: int) -> pa.Table:
    """Phrases one word longer than the intervals given, by part: ``(pair, size, lo)``.
    With the part the first number gives the rest of the last one by ``parts``."""
    lo, size, first, last = extend(bwt, lo, size)
    first, last = phrase[first], phrase[last]
    pair, part = first * (bound // parts + 1) + last // parts, (first + last) % parts
    order = np.argsort(pair)
    pair, size, lo, part = pair[order], size[order], lo[order], part[order]
    return _table([(shard, i, pack(pair[rows], size[rows], lo[rows])) for i, rows in _groups(part)], _SENT)


def _pairs(parts: int, bound: int) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
    """Phrases of two words of a shard."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        bwt, phrase = opened(b.column("bwt")[0].as_py()), np.frombuffer(b.column("phrase")[0].as_py(), np.int64)
        size = np.bincount(bwt, minlength=len(phrase) + 1)
        sent = _sent(b.column("shard")[0].as_py(), bwt, np.cumsum(size)[:-1], size[1:], phrase, parts, bound)
        return sent.combine_chunks().to_batches()[0] if len(sent) else None
    return run


def _longer(parts: int, bound: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Phrases of a shard one word longer than those of a level, packed ``(lo, size, phrase)``."""
    def run(shards: pa.Table, level: pa.Table) -> pa.Table:
        if not len(shards) or not len(level):
            return _table([], _SENT)
        lo, size, phrase = np.concatenate([unpack(x) for x in level.column("data").to_pylist()], axis=1)
        bwt = opened(shards.column("bwt")[0].as_py())
        return _sent(shards.column("shard")[0].as_py(), bwt, lo, size, phrase, parts, bound)
    return run


def _frequent_pairs(parts: int, bound: int, least: int, go_on: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Counts and numbers of the pairs of a part: ``(phrase, a, first, last)`` and, to
    ``go_on``, for each shard ``(lo, size, phrase)``."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        part, data = key[0].as_py(), [unpack(x) for x in t.column("data").to_pylist()]
        pair, size, lo = np.concatenate(data, axis=1)
        shard = np.repeat(t.column("shard").to_numpy(), [x.shape[1] for x in data])
        every, which = np.unique(pair, return_inverse=True)
        a = np.bincount(which, size).astype(np.int64)
        known, number = np.flatnonzero(a >= least), np.full(len(a), -1, np.int64)
        if not len(known):
            return _table([], _MERGED)
        number[known] = np.arange(len(known)) * parts + part
        first, last = np.divmod(every[known], bound // parts + 1)
        out = [(None, None, None, pack(number[known], a[known], first, last * parts + (part - first) % parts))]
        mine = np.flatnonzero(number[which] >= 0) if go_on else np.zeros(0, np.int64)
        for i, rows in _groups(shard[mine]):
            rows = mine[rows]
            rows = rows[np.argsort(lo[rows])]
            out.append((i, None, None, pack(lo[rows], size[rows], number[which[rows]])))
        return _table(out, _MERGED)
    return run


def _phrases(b: pa.RecordBatch) -> pa.RecordBatch:
    """Frequent pairs of a part as rows."""
    return pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(b.column("data")[0].as_py())], names=["phrase", "a", "first", "last"])


def _indexed(packs: pa.Table, words: pa.Table) -> pa.Table:
    """The index of the packs of a shard over its frequent words, packed ``(pack, at, phrase)``; others end pieces."""
    shard, bwt, known = [], [], []
    if len(packs) and len(words):
        of, at, number = np.concatenate([unpack(x) for x in words.column("data").to_pylist()], axis=1)
        every = np.unique(number)
        texts = [np.zeros(1, np.int32)]
        for pack, data in zip(packs.column("pack").to_pylist(), packs.column("text")):
            text, mine = opened(data.as_py()), of == pack
            symbol = np.zeros(max(int(text.max(initial=0)), int(at[mine].max(initial=0))) + 1, np.int32)
            symbol[at[mine]] = np.searchsorted(every, number[mine]) + 1
            texts.append(symbol[text])
        text = np.concatenate([*texts, np.zeros(1, np.int32)])
        text = text[np.insert((text[1:] != 0) | (text[:-1] != 0), 0, True)]     # one end after another is one
        shard, bwt, known = [packs.column("shard")[0].as_py()], [squeezed(index(text))], [every.tobytes()]
    return pa.table({"shard": pa.array(shard, pa.int64()), "bwt": pa.array(bwt, pa.binary()), "phrase": pa.array(known, pa.binary())})


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5,
                     shard_words: int = 1 << 20) -> tuple[list[DataFrame], DataFrame]:
    """Per length 1 to ``longest`` a table ``(phrase, first, last, lang, words, tail,
    a, begins, ends)`` of the phrases with ``a >= least`` occurrences: its number and
    those of its first and last words, its words and the last of them, and the
    counts of its beginnings and endings of 1, 2, ... words; and ``(lang, n)``, all words."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    packs = written(d.mapInArrow(_pack(shard_words), "pack bigint, lang string, words array<string>, counts array<bigint>, text binary"), "packs")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = cut(packs.select("pack", "lang", size.alias("n")))
    total = cut(sizes.groupBy("lang").agg(F.sum("n").alias("n")))
    dealt = running_sum(sizes, ["pack"], "n").select("pack", F.floor((F.col("cum") - F.col("n")) / shard_words).alias("shard"))
    packs = packs.join(broadcast_if_small(dealt, sizes.count()), "pack")
    parts = max(1, -(-(total.agg(F.sum("n")).first()[0] or 0) // (2 * shard_words)))

    def merged(sent: DataFrame, merge: Callable[[tuple, pa.Table], pa.Table]) -> tuple[DataFrame, DataFrame]:
        """The frequent phrases of all parts, and what shards hold of them. The number of
        tasks is given: packed rows are small, and Spark would put many parts together."""
        made = written(sent.repartition(shuffle_partitions(spark), "part").groupBy("part").applyInArrow(merge, _MERGED), "phrases")
        return made.filter("shard IS NULL"), made.filter("shard IS NOT NULL").select(F.col("shard").alias("of"), "data")

    spelled = map_batches(packs.select("pack", "shard", "lang", "words", "counts"), _spelled(parts), _SPELLED, 1)
    words, held = merged(spelled, _frequent_words(parts, least))
    words = cut(map_batches(words, _words, "phrase bigint, lang string, word string, a bigint", 1))
    none = F.lit(None).cast("long")
    level = words.select(
        "phrase", none.alias("first"), none.alias("last"), "lang", F.col("word").alias("words"), F.col("word").alias("tail"),
        "a", F.array("a").alias("begins"), F.array("a").alias("ends"))
    shards = (packs.select("shard", "pack", "text").groupBy("shard").cogroup(held.groupBy("of"))
              .applyInArrow(_indexed, "shard bigint, bwt binary, phrase binary"))
    with shuffles_removed(spark):
        shards = cut_lineage_bucketed(shards, "shard", shuffle_partitions(spark), "shards")
    levels = [level]
    for k in range(2, longest + 1):
        bound = (level.agg(F.max("phrase")).first()[0] or 0) + 1
        if k == 2:
            sent = map_batches(shards, _pairs(parts, bound), _SENT, 1)
        else:
            sent = shards.select("shard", "bwt").groupBy("shard").cogroup(held.groupBy("of")).applyInArrow(_longer(parts, bound), _SENT)
        found, held = merged(sent, _frequent_pairs(parts, bound, least, k < longest))
        found = map_batches(found, _phrases, "phrase bigint, a bigint, first bigint, last bigint", 1)
        begin = level.select(F.col("phrase").alias("first"), "lang", F.col("words").alias("w"), F.col("begins").alias("b"))
        end = level.select(F.col("phrase").alias("last"), "tail", F.col("ends").alias("e"))
        level = cut(found.join(begin, "first").join(end, "last").select(
            "phrase", "first", "last", "lang", F.concat_ws(" ", "w", "tail").alias("words"), "tail", "a",
            F.concat("b", F.array("a")).alias("begins"), F.concat("e", F.array("a")).alias("ends")))
        levels.append(level)
    return levels, total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000,
                 held_percent: int = 100, shard_words: int = 1 << 20) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language the ``top`` phrases of
    2 to ``longest`` words and ``least`` occurrences by ``score = floor(1000 a n / (l r))``,
    l and r the counts of the two parts at the cut that scores lowest (the first of equal
    ones). Phrases inside a longer one with ``held_percent`` of their occurrences are left out."""
    levels, total = frequent_phrases(docs, text, lang, least, longest, shard_words)
    rows = []
    for k, level in enumerate(levels[1:], 2):
        if k < longest:
            more = levels[k]
            around = more.select(F.col("first").alias("phrase"), "a").unionByName(more.select(F.col("last").alias("phrase"), "a"))
            around = around.groupBy("phrase").agg(F.max("a").alias("longer"))
            level = level.join(around, "phrase", "left").filter(
                F.col("longer").isNull() | (100 * F.col("longer") < held_percent * F.col("a"))).drop("longer")
        rows.append(level.select("lang", "words", "a", "begins", "ends"))
    big = "decimal(38,0)"
    d = reduce(DataFrame.unionByName, rows).join(total, "lang")
    d = d.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("begins") - 1)))
    d = d.withColumn("l", F.element_at("begins", F.col("cut"))).withColumn("r", F.element_at("ends", F.size("ends") - F.col("cut")))
    score = F.expr(f"(cast(1000 * a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")
    least_cut = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    d = d.groupBy("lang", "words", "a", "n").agg(least_cut).select("lang", F.col("words").alias("phrase"), "a", "n", "least.*")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    d = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return d.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
