"""Quality rules with an n-gram perplexity.

Base rules count words, symbols, repeated lines and words in repeated 3-word
windows (see ``base_counts``); a text fails them if it has fewer than 50 words
or more than half of its words lie in repeated windows.

The language model is an interpolated modified Kneser-Ney model of the given
``order`` over words (split at white space, A-Z as a-z, a mark before and after
the text), one for each language and half of its texts. A text is scored by the
other half's model, so its own counts never vouch for it; the half follows from
the least n-gram hash, so that exact copies and nearly all near copies share it.
Spark counts every whole text: n-grams are packed hashes of their words, counted
in the tasks, sent as sorted differences and merged by context; the continuation
counts of a lower order are the distinct n-grams above it, those seen once
included; three discounts per model and order come from the counts of counts.

The model is kept as sorted 64-bit hashes with values that add up to the log
probability of a text: what an n-gram gains over its suffix, and what its context
leaves to lower orders. N-grams that only one half has can't be asked for and are
left out here, after all counts. It is cut by hash into blocks of at most about
``block`` entries; a task gathers the distinct n-grams of about ``HELD`` words of text
and looks them up in one block after the other, opened in ``at_once`` pieces, so a model of any size scores
the same way, in one pass and the same memory. A level of the model meets the one below
it in the same way. A part's counts come in the order of their n-grams, in pieces of
``PIECE``; what no later piece can add to is passed on. A word is packed to 62 / ``order`` bits (31 for pairs): of V distinct words
of a language a word shares its counts with another at a rate of about V / 2^31,
0.05 % at a million.

A document's figure is its log perplexity per word that has a letter or digit:
marks between words add to it. Per language, of the texts that pass the base
rules, the shortest interval with half of the figures is taken, which junk beside
the bulk moves little; a text is kept if it lies at most ``above`` robust standard
deviations (length / 1.349, at least ``least``) above the middle and ``below``
under it. Languages with fewer than ``min_docs`` such texts share one band, taken
from all their texts together; if these too are fewer, nothing is known to judge by,
and the base rules alone decide.

A null text has no words and fails the base rules; a null language is one of
its own; repeated rows are rows; other columns are ignored; an empty table gives
an empty result. A text of any length is scored whole, ``SLICE`` n-grams at a time.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .tables import conf_held, cut, discard, map_batches, written
from .wordhash import WordHasher, mix, white_space

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\r\x0b\x0c"
_GAP = white_space()
_SAID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_HASHER = WordHasher(_GAP)
#: Distinct n-grams a counting task holds before it passes them on; n-grams of texts that
#: a scoring task looks up together.
HELD = 1 << 21
#: N-grams of a language and half made distinct at a time, and bytes of text taken together.
SLICE, TEXT = 1 << 18, 9 << 20
#: N-grams in a packed row of counts, and such rows that a merging task is given at a time.
PIECE, PIECES = 1 << 13, 64


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8").split()
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    repeated = 0
    if len(seen) < len(grams):
        upto = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def width(order: int) -> int:
    """Bits of a word in a packed n-gram."""
    return 62 // order


def grams(text: str | None, order: int) -> np.ndarray:
    """The word n-grams of a text as packed hashes; 0 marks start and end."""
    words = _HASHER.words(text)
    if not len(words):
        return np.zeros(0, np.int64)
    bits = width(order)
    w = np.maximum(words >> np.uint64(64 - bits), np.uint64(1)).astype(np.int64)
    w = np.concatenate([np.zeros(order - 1, np.int64), w, np.zeros(1, np.int64)])
    n = len(w) - order + 1
    out = w[:n].copy()
    for i in range(1, order):
        out = out << bits | w[i:i + n]
    return out


def said_words(text: str | None) -> int:
    """Words with a letter or digit."""
    b = np.frombuffer(text.encode("utf-8"), np.uint8) if text else np.zeros(0, np.uint8)
    word = np.cumsum(_GAP[b])[_SAID[b]]
    return 1 + int(np.count_nonzero(np.diff(word))) if len(word) else 0


def half(g: np.ndarray) -> int:
    """The half of a text: the same for texts with mostly the same n-grams."""
    return int(mix(mix(g.view(np.uint64)).min(keepdims=True))[0] >> np.uint64(40) & np.uint64(1))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as small bytes; the first is sorted."""
    out = np.array(columns, np.int64).reshape(len(columns), -1)
    out[0, 1:] -= out[0, :-1].copy()
    return len(columns).to_bytes(1, "big") + zlib.compress(np.ascontiguousarray(out.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    out = np.array(b.reshape(8, -1).T, order="C").view(np.int64).reshape(data[0], -1)
    out[0] = np.cumsum(out[0])
    return out


def _dealt(g: np.ndarray, k: int, bits: int, parts: int) -> np.ndarray:
    """The part of each n-gram, by the range of its first word's hash: sorted differences stay small."""
    return (g >> bits * (k - 1)) * parts >> bits


def _blobs(g: np.ndarray, n: np.ndarray, k: int, bits: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Counted n-grams (sorted) by part, ``PIECE`` at most together, with the first of them."""
    ends = np.searchsorted(_dealt(g, k, bits, parts), np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(ends)):
        for at in range(ends[i], ends[i + 1], PIECE):
            rows = slice(at, min(at + PIECE, ends[i + 1]))
            yield int(i), int(g[at]), pack(g[rows], n[rows])


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(g, return_inverse=True)
    return g, np.bincount(at, n, len(g)).astype(np.int64)


_PACKED = "lang string, half int, part int, first bigint, data binary"
_MERGED = "lang string, half int, part int, what string, data binary, contexts binary, n bigint"


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """Packed counts, added up inside tasks first. ``docs (lang, text)``."""
    parts, bits = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), width(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str | None, int], tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[tuple[str | None, int], list[np.ndarray]] = {}
        n_fresh = 0

        def merge() -> None:
            for key in list(fresh):
                new = fresh.pop(key)
                g, n = held.pop(key, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                held[key] = _summed(np.concatenate([g, *new]), np.concatenate([n, np.ones(sum(map(len, new)), np.int64)]))

        def passed_on() -> Iterator[pa.RecordBatch]:
            merge()
            for key in list(held):
                g, n = held.pop(key)
                yield _as_rows([(*key, *x) for x in _blobs(g, n, order, bits, parts)], _PACKED)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = grams(text.as_py(), order)
                if len(x):
                    fresh.setdefault((lang, half(x)), []).append(x)
                    n_fresh += len(x)
                if n_fresh > HELD // 2:
                    merge()
                    n_fresh = 0
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield from passed_on()
        yield from passed_on()

    return docs.select("lang", "text").mapInArrow(run, _PACKED)


class _Part:
    """The counts of a part's ``k``-grams, put together as they come in the order of their
    first n-gram. What is held are n-grams that later pieces can still add to, and, packed,
    those kept of the one context that is not at its end."""

    def __init__(self, k: int, bits: int, shared: bool):
        self.k, self.bits, self.shared = k, bits, shared
        self.g, self.n = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        self.fresh: list[tuple[int, np.ndarray]] = []
        self.size, self.sums = 0, np.zeros((2, 6), np.int64)
        self.open: tuple[int, np.ndarray, list[tuple[int, bytes]]] | None = None

    def add(self, half: int, first: int, data: bytes) -> list[tuple]:
        out = self.closed(first) if self.size > HELD // 2 else []
        self.fresh.append((half, unpack(data)))
        self.size += self.fresh[-1][1].shape[1]
        return out

    def closed(self, first: int | None = None) -> list[tuple]:
        """Rows ``(half, what, data, contexts, n)`` of the n-grams before ``first``, or of all."""
        g = np.concatenate([self.g, *(x[0] for _, x in self.fresh)])
        n, at = np.zeros((2, len(g)), np.int64), len(self.g)
        n[:, :at] = self.n
        for h, x in self.fresh:
            n[h, at:at + x.shape[1]] = x[1]
            at += x.shape[1]
        self.fresh, self.size = [], 0
        order = np.argsort(g, kind="stable")
        g = g[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
        if len(g):
            g, n = g[starts], np.add.reduceat(n[:, order], starts, axis=1)
        end = len(g) if first is None else int(np.searchsorted(g, first))
        self.g, self.n = g[end:].copy(), n[:, end:].copy()
        return self.rows(g[:end], n[:, :end], first is None)

    def rows(self, g: np.ndarray, n: np.ndarray, last: bool) -> list[tuple]:
        k, bits, out = self.k, self.bits, []
        for h in (0, 1):
            x, m = g[n[h] > 0], n[h][n[h] > 0]
            self.sums[h] += np.array([*((m == i).sum() for i in (1, 2, 3, 4)), m.sum(), len(m)])
            if last:
                out.append((h, "sums", pack(self.sums[h]), b"", 0))
            if k > 1 and len(x):
                low = _summed(np.sort(x & ((1 << bits * (k - 1)) - 1)), np.ones(len(x), np.int64))
                out.append((h, "n", pack(*low), b"", len(low[0])))
        keep = (n[0] > 0) & (n[1] > 0) if self.shared else np.ones(len(g), bool)
        if k == 1:
            return [*out, (0, "own", pack(g[keep], *n[:, keep]), b"", int(keep.sum()))]
        ctx, at = np.unique(g >> bits, return_inverse=True)
        per = np.array([np.bincount(at, v, len(ctx)) for m in n for v in (m, m == 1, m == 2, m > 2)], np.int64)
        held: list[tuple[int, bytes]] = []
        if self.open is not None:
            was, before, held = self.open
            if not len(ctx) or ctx[0] != was:
                ctx, per, at = np.concatenate([[was], ctx]), np.concatenate([np.zeros((8, 1), np.int64), per], axis=1), at + 1
            per[:, 0] += before
        done = len(ctx) if last else max(0, len(ctx) - 1)       # the last context may go on
        end = int(np.searchsorted(at, done))
        if done:
            whole = pack(ctx[:1], *per[:, :1])
            out += [(1, "own", data, whole, size) for size, data in held]
            held = []
        both = (per[0] > 0) & (per[4] > 0) if self.shared else np.ones(len(ctx), bool)
        both[done:] = False
        mine, rest = keep & (np.arange(len(g)) < end), keep & (np.arange(len(g)) >= end)
        out.append((0, "own", pack(g[mine], *n[:, mine]), pack(ctx[both], *per[:, both]), int(mine.sum() + both.sum())))
        if rest.any():
            held = [*held, (int(rest.sum()), pack(g[rest], *n[:, rest]))]
        self.open = (int(ctx[done]), per[:, done], held) if done < len(ctx) else None
        return out


def _merged(packed: DataFrame, k: int, bits: int, shared: bool, folder: str) -> DataFrame:
    """Counts of ``k``-grams put together by part. Rows of ``what``: ``own`` (n-grams
    with their counts in both halves, and contexts, for each half with the sum of
    counts and how many are 1, 2, more; of ``half`` 1 if another row has its context too),
    ``sums`` (n-grams counted 1, 2, 3, 4 times, sum of counts, n-grams) and ``n`` (suffixes
    with their continuation counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = (None, -1), None
        for b in batches:
            out = []
            for lang, h, i, first, data in zip(*(b.column(c).to_pylist() for c in range(5))):
                if part is None or key != (lang, i):
                    out += [(key, r) for r in part.closed()] if part is not None else []
                    key, part = (lang, i), _Part(k, bits, shared)
                out += [(key, r) for r in part.add(h, first, data)]
            if out:
                yield _as_rows([(at[0], r[0], at[1], *r[1:]) for at, r in out], _MERGED)
        if part is not None:
            yield _as_rows([(key[0], r[0], key[1], *r[1:]) for r in part.closed()], _MERGED)
    return _kept(packed.repartition("lang", "part").sortWithinPartitions("lang", "part", "first").mapInArrow(run, _MERGED),
                 f"{folder}/grams{k}")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``written`` for packed rows of up to megabytes: few of them in a batch, a page or a
    row group, and not compressed again, which would take buffers beside the heap."""
    with conf_held(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PIECES)):
        return written(df, name, {"compression": "uncompressed", "parquet.block.size": str(4 << 20),
                                  "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"})


def _suffixes(level: DataFrame, k: int, bits: int) -> DataFrame:
    """Packed counts of ``k``-grams out of the level above, dealt over as many parts as
    their number asks for, not over the square of the partitions."""
    rows = level.filter("what = 'n'").select("lang", "half", "data", "n")
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // HELD))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        return _as_rows([(lang, side, *piece)
                         for lang, side, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)))
                         for piece in _blobs(*unpack(data), k, bits, parts)], _PACKED)
    return map_batches(rows, run, _PACKED, 1)


def _discounts(c: np.ndarray) -> np.ndarray:
    """For n-grams counted once, twice, more often; ``c``: how many are counted 1 to 4 times."""
    y = c[0] / max(1, c[0] + 2 * c[1])
    d = [i - (i + 1) * y * c[i] / c[i - 1] if c[0] and c[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return np.array([max(0.1, min(x, i - 0.05)) for i, x in zip((1, 2, 3), d)])


def _given(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n > 0, d[np.clip(n, 1, 3) - 1], 0.0)


def hashed(lang: str | None, tag: int, g: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of a language's models."""
    salt = 0x51ED270B + tag + 64
    for b in ("?" if lang is None else "=" + lang).encode("utf-8"):
        salt = (salt * 0x100000001B3 ^ b) & 0xFFFFFFFFFFFFFFFF
    return mix(g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(np.array([salt], np.uint64)))


def _packed_values(h: np.ndarray, v: np.ndarray) -> bytes:
    """Hashes, sorted here, with a value (float32) for each half."""
    order = np.argsort(h)
    return pack(h[order].view(np.int64), *v[:, order].view(np.uint32))


def _values(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unpack(data)
    return x[0].copy().view(np.uint64), x[1:].astype(np.uint32).view(np.float32)


def _sealed(h: np.ndarray, v: np.ndarray) -> bytes:
    """Sorted hashes with a value for each half, in planes of bytes that open fast: those
    that zlib makes smaller are packed, the others stay."""
    step = np.diff(h, prepend=np.zeros(1, np.uint64))
    planes = [x.view(np.uint8).reshape(len(h), size)[:, i].tobytes() for x, size in ((step, 8), *((np.ascontiguousarray(x), 4) for x in v))
              for i in range(size)]
    small = [zlib.compress(x, 1) for x in planes]
    kept = [z if len(z) < 0.9 * len(x) else x for z, x in zip(small, planes)]
    return np.array([len(h), *map(len, kept)], np.int64).tobytes() + b"".join(kept)


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(data, np.int64, 17).tolist()
    h, v, at = np.empty((n, 8), np.uint8), np.empty((2, n, 4), np.uint8), 17 * 8
    for i, size in enumerate(sizes):
        x = memoryview(data)[at:at + size]
        plane = np.frombuffer(x if size == n else zlib.decompress(x), np.uint8)
        if i < 8:
            h[:, i] = plane
        else:
            v[(i - 8) // 4, :, i % 4] = plane
        at += size
    return np.cumsum(h.view(np.uint64)[:, 0], dtype=np.uint64), v.view(np.float32)[:, :, 0]


def _look(hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted ``h`` are among ``hashes``, and where."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = bisect_left(h, hashes[0]), bisect_right(h, hashes[-1])
    at = np.searchsorted(hashes, h[lo:hi])
    there = hashes[at] == h[lo:hi]
    return lo + np.flatnonzero(there), at[there]


class Blocks:
    """Blocks of a table of hashes with values, each a list of sealed pieces, broadcast as
    bytes of bounded size; a task's process holds the bytes of one and opens one piece."""

    def __init__(self, spark: SparkSession, blocks: Iterable[list[bytes]]):
        self.sent = [spark.sparkContext.broadcast(x) for x in blocks]
        self.opened: tuple[np.ndarray, np.ndarray] | None = None

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.opened is not None:
            yield self.opened
        for sent in self.sent:
            yield from map(_opened, sent.value)
            vars(sent).pop("_value", None)      # else every block's bytes stay in the process

    def find(self, h: np.ndarray, side: int | slice = slice(None)) -> np.ndarray:
        """The values of each hash, of both halves or of one; not a number where it is in no
        block. Hashes are looked up in order, which leaves most steps in the cache."""
        out = np.full((2, len(h)), np.nan, np.float32)[side]
        order = np.argsort(h)
        h = h[order]
        for hashes, values in self.each():
            which, at = _look(hashes, h)
            out[..., order[which]] = values[side][..., at]
        return out

    def drop(self) -> None:
        """The copies on the driver's and the executors' disks go."""
        for sent in self.sent:
            sent.destroy()
        self.sent = []


#: A table of packed model entries: rows, and what makes ``_ENTRIES`` of their batches.
Table = tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]


def blocks_of(tables: list[Table], value: str, entries: int, block: int, at_once: int, name: str) -> Blocks:
    """The ``entries`` of tables, dealt by ranges of the hash and written as blocks of at most
    about ``block`` entries in ``at_once`` pieces; the driver holds one block at a time."""
    bits = max(0, int(np.ceil(np.log2(max(1, entries / block)))))
    schema = "block int, n bigint, data binary"

    def joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [_values(x) for x in found]
        h, v = np.concatenate([h for h, _ in found]), np.concatenate([v for _, v in found], axis=1)
        order = np.argsort(h, kind="stable")
        return h[order], v[:, order]

    def pieces(held: list[bytes]) -> pa.RecordBatch:
        h, v = joined(held)
        ends = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else (0, len(h))
        return _as_rows([(i, int(hi - lo), _packed_values(h[lo:hi], v[:, lo:hi]))
                         for i, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi], schema)

    def dealt(df: DataFrame, made: Callable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in made(batches):
                for n, data in zip(b.column("n").to_pylist(), b.column(value)):
                    held.append(data.as_py())
                    size += n
                    if size > HELD // 2:
                        yield pieces(held)
                        held, size = [], 0
            if size:
                yield pieces(held)
        return df.mapInArrow(run, schema)

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        h, v = joined(t.column("data").to_pylist())
        step = -(-len(h) // at_once)
        return pa.Table.from_batches([_as_rows([(key[0].as_py(), len(h[i:i + step]), _sealed(h[i:i + step], v[:, i:i + step]))
                                                for i in range(0, len(h), step)], schema)])

    rows = _kept(reduce(DataFrame.unionByName, (dealt(*t) for t in tables)).groupBy("block").applyInArrow(whole, schema), name)

    def found() -> Iterator[list[bytes]]:
        held, size = [], 0
        with conf_held(rows.sparkSession, "spark.sql.files.maxPartitionBytes", str(4 << 20)):   # few pieces on their way at a time
            for r in rows.select("n", "data").toLocalIterator():
                held.append(bytes(r["data"]))
                size += r["n"]
                if size >= block:
                    yield held
                    held, size = [], 0
        if held:
            yield held
    return Blocks(rows.sparkSession, found())


_LEVEL = "lang string, g binary, own binary, rest binary, below binary"
_ENTRIES = "n bigint, lang string, g binary, logp binary, gain binary"


def _as_rows(rows: list[tuple], names: str) -> pa.RecordBatch | None:
    """Packed rows: arrays become bytes."""
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    schema = pa.schema([(f, types[t]) for f, t in fields])
    return pa.RecordBatch.from_pylist([{f: x.tobytes() if isinstance(x, np.ndarray) else x for (f, _), x in zip(fields, r)}
                                       for r in rows], schema) if rows else None


def _halves(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(2, -1)


def _filled(sent: Blocks, k: int, bits: int):
    """Into packed rows of level ``k``: the log probability of each n-gram's suffix."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        asked = [hashed(r[0], k - 1, np.frombuffer(r[1], np.int64) & ((1 << bits * (k - 1)) - 1)) for r in rows]
        found = np.split(sent.find(np.concatenate(asked)), np.cumsum([len(h) for h in asked])[:-1], axis=1)
        return _as_rows([(*r[:4], np.ascontiguousarray(x)) for r, x in zip(rows, found)], _LEVEL)
    return run


def _entries(k: int):
    """Model entries of packed rows of level ``k``: ``logp`` of an n-gram and its gain over its suffix."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lang, g, *rest in zip(*(c.to_pylist() for c in b.columns)):
            own, rest, below = (_halves(x).astype(np.float64) for x in rest)
            less = rest * np.exp(below)
            p, h = own + less, hashed(lang, k, np.frombuffer(g, np.int64))
            out.append((len(h), lang, g, _packed_values(h, np.log(p).astype(np.float32)),
                        _packed_values(h, np.log(p / less).astype(np.float32))))
        return _as_rows(out, _ENTRIES)
    return run


def _in_turn(first: Callable, *steps: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``first`` of each row, and of its results, so many that they have about ``HELD / 2``
    n-grams, the other steps in the same process."""
    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for step in steps:
            b = step(b)
        return b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                one = first(b.slice(i, 1))
                if one is not None:
                    held.append(one)
                    size += sum(len(x.as_buffer()) for x in one.column("g")) // 8
                if size > HELD // 2:
                    yield done(held)
                    held, size = [], 0
        if held:
            yield done(held)
    return run


def model_tables(top: DataFrame, order: int, shared: bool, block: int, at_once: int, folder: str
                 ) -> tuple[list[Table], int, dict[tuple[str | None, int], float], list[Blocks]]:
    """Tables of packed model entries (``_ENTRIES``), values with their
    hashes for both halves: contexts (``gain`` only) and n-grams of every order, the
    highest order last; the number of their entries; the log probability of an unknown
    word by language and half; and the blocks the last table needs. ``shared``: only what
    both halves have."""
    bits = width(order)
    levels: dict[int, DataFrame] = {}
    for k in range(order, 0, -1):
        levels[k] = _merged(top if k == order else _suffixes(levels[k + 1], k, bits), k, bits, shared, folder)
    tables, entries, unknown, lower, used = [], 0, {}, None, []
    for k in range(1, order + 1):
        sums: dict[tuple[str | None, int], np.ndarray] = {}
        for r in levels[k].filter("what = 'sums'").select("lang", "half", "data").toLocalIterator():
            at = (r["lang"], r["half"])
            sums[at] = sums.get(at, 0) + unpack(r["data"])[0]
        spare: dict[tuple[str | None, int], float] = {}
        disc = {at: _discounts(c) for at, c in sums.items()}
        if k == 1:
            for at, c in sums.items():
                left = disc[at] @ [c[0], c[1], c[5] - c[0] - c[1]]
                spare[at] = float(left / c[4] / (c[5] + 1)) if c[4] else 1.0
                unknown[at] = float(np.log(spare[at]))

        def rows(b: pa.RecordBatch, k=k, sums=sums, disc=disc, spare=spare) -> pa.RecordBatch | None:
            out = []
            for lang, data, ctx in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x = unpack(data.as_py())
                own, rest = np.full((2, 2, len(x[0])), np.nan, np.float32)
                if k > 1:
                    all_ctx = unpack(ctx.as_py())
                    per_ctx = all_ctx[1:, np.searchsorted(all_ctx[0], x[0] >> bits)]
                for h in (0, 1):
                    here = x[1 + h] > 0
                    if not here.any():
                        continue
                    n, d = x[1 + h, here], disc[lang, h]
                    if k == 1:
                        total, rest[h, here] = sums[lang, h][4], spare[lang, h]
                    else:
                        per = per_ctx[4 * h:4 * h + 4, here]
                        total, rest[h, here] = per[0], d @ per[1:] / per[0]
                    own[h, here] = (n - _given(n, d)) / total
                if len(x[0]):
                    out.append((lang, x[0], own, rest, np.full(own.shape, 0.0 if k == 1 else np.nan, np.float32)))
            return _as_rows(out, _LEVEL)

        def contexts(b: pa.RecordBatch, k=k, disc=disc) -> pa.RecordBatch | None:
            out = []
            for lang, data in zip(b.column(0).to_pylist(), b.column(2)):
                x = unpack(data.as_py())
                back = np.full((2, len(x[0])), np.nan, np.float32)
                for h in (0, 1):
                    per = x[1 + 4 * h:5 + 4 * h]
                    here = per[0] > 0
                    if here.any():
                        back[h, here] = np.log(disc[lang, h] @ per[1:, here] / per[0, here])
                if len(x[0]):
                    out.append((len(x[0]), lang, x[0], None, _packed_values(hashed(lang, -k, x[0]), back)))
            return _as_rows(out, _ENTRIES)

        own = levels[k].filter("what = 'own'").select("lang", "data", "contexts", "half", "n")
        here = own.agg(F.sum("n")).first()[0] or 0
        if k > 1:
            tables.append((own.filter("half = 0"), _in_turn(contexts)))
            used.append(blocks_of([lower], "logp", n_lower, block, at_once, f"{folder}/blocks{k - 1}"))
        lower = own, _in_turn(rows, *([_filled(used[-1], k, bits)] if k > 1 else []), _entries(k))
        if k < order:
            lower = _kept(own.mapInArrow(lower[1], _ENTRIES), f"{folder}/level{k}"), iter
        n_lower, entries = here, entries + here
        tables.append(lower)
    return tables, entries, unknown, used


def kneser_ney(top: DataFrame, order: int) -> DataFrame:
    """``(lang, half, g, logp)`` for every highest-order n-gram of a model."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, g = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py(), np.int64)
        hashes, values = _values(b.column(2)[0].as_py())
        logp = values[:, np.searchsorted(hashes, hashed(lang, order, g))].astype(np.float64)
        side, at = np.nonzero(~np.isnan(logp))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(side.astype(np.int32)),
                                           pa.array(g[at]), pa.array(logp[side, at])], names=["lang", "half", "g", "logp"])
    own, made = model_tables(top, order, False, 2_000_000, 8, "kneser_ney")[0][-1]
    found = own.mapInArrow(made, _ENTRIES).select("lang", "g", "logp")
    return map_batches(found, run, "lang string, half int, g bigint, logp double", 1)


def _runs(found: Iterable[tuple[int, str | None, np.ndarray]]) -> Iterator[tuple[str | None, int, np.ndarray, np.ndarray]]:
    """N-grams of texts ``(row, language, n-grams)`` with their rows, by language and
    half, at most about ``SLICE`` at a time; a longer text comes in several pieces."""
    held: dict[tuple[str | None, int], list[tuple[int, np.ndarray]]] = {}
    size: dict[tuple[str | None, int], int] = {}

    def joined(key: tuple[str | None, int]) -> tuple[str | None, int, np.ndarray, np.ndarray]:
        pieces, size[key] = held.pop(key), 0
        return *key, np.concatenate([x for _, x in pieces]), np.repeat([i for i, _ in pieces], [len(x) for _, x in pieces])

    for i, lang, g in found:
        if not len(g):
            continue
        key = (lang, half(g))
        for at in range(0, len(g), SLICE):
            held.setdefault(key, []).append((i, g[at:at + SLICE]))
            size[key] = size.get(key, 0) + len(held[key][-1][1])
            if size[key] >= SLICE:
                yield joined(key)
    for key in list(held):
        yield joined(key)


def _sums(sent: Blocks, order: int, langs: list[str | None], found: list[np.ndarray]) -> np.ndarray:
    """What the model adds to the log probability of each text, given by its n-grams."""
    w, sums = width(order), np.zeros(len(found))

    def asked(lang: str | None, tag: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, room for their values, and which of them each n-gram has."""
        back: np.ndarray | slice = slice(None)
        if tag != order:        # far fewer words and contexts than n-grams
            x, back = np.unique(x, return_inverse=True)
        h = hashed(lang, tag, x)
        at = np.argsort(h)
        place = np.empty(len(h), np.int32)
        place[at] = np.arange(len(h), dtype=np.int32)
        return h[at], np.zeros(len(h), np.float32), place[back]

    def add(held: list[tuple]) -> None:
        for hashes, values in sent.each():
            for side, _, _, parts in held:
                for h, value, _ in parts:
                    which, at = _look(hashes, h)
                    value[which] = np.nan_to_num(values[side, at])
        for _, row, which, parts in held:
            gain = np.zeros(len(parts[0][2]), np.float64)
            for _, value, place in parts:
                gain += value[place]
            sums[:] += np.bincount(row, gain[which], len(sums))

    held, size = [], 0
    for lang, side, g, row in _runs(zip(range(len(found)), langs, found)):
        size += len(g)
        g, which = np.unique(g, return_inverse=True)
        held.append((1 - side, row.astype(np.int32), which.astype(np.int32), [
            asked(lang, tag, g & ((1 << w * tag) - 1) if tag > 0 else (g >> w) & ((1 << w * (-tag - 1)) - 1))
            for tag in (*range(1, order + 1), *range(-order, -1))]))
        if size >= HELD:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    return sums


def _slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``TEXT`` bytes in column ``at``, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(upto // TEXT)) + 1), b.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield b.slice(lo, hi - lo)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 2,
            block: int = 2_000_000, at_once: int = 8, above: float = 3.0, below: float = 12.0, least: float = 0.02, min_docs: int = 20) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, the base counts, ``base_failed``,
    ``log_perplexity`` (null without words), its language's ``low`` and ``high``
    band, and ``kept``."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    id_type = dict(d.dtypes)["doc_id"]
    folder = f"quality-{uuid.uuid4().hex[:12]}"
    tables, entries, unknown, used = model_tables(count_grams(d, order), order, True, block, at_once, folder)
    model = blocks_of(tables, "gain", entries, block, at_once, f"{folder}/model")
    discard(d.sparkSession, folder)     # the model is with the driver; these would stand on disk beside its copies
    for sent in used:
        sent.drop()

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        """Log probabilities, and the base counts with them."""
        langs, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
        found, counts = [grams(t, order) for t in texts], list(zip(*map(base_counts, texts)))
        base = [len(g) * unknown.get((lang, 1 - half(g)), 0.0) if len(g) else 0.0 for lang, g in zip(langs, found)]
        logp = _sums(model, order, langs, found) + base
        per = [max(1, said_words(t)) if len(g) else 0 for t, g in zip(texts, found)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(logp, pa.float64()), pa.array(per, pa.int64()), *(pa.array(c, pa.int64()) for c in counts)],
            names=["doc_id", "lang", "logp", "per", *names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from map(count, _slices(b, 2))
    rows = cut(d.mapInArrow(score, f"doc_id {id_type}, lang string, logp double, per bigint, "
                            + ", ".join(f"{c} bigint" for c in names)))
    model.drop()
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "log_perplexity": F.when(F.col("per") > 0, -F.col("logp") / F.col("per"))})
    cuts = F.percentile_approx("log_perplexity", [i / 50 for i in range(51)], 10_000)
    judged = rows.filter(~F.col("base_failed")).select("lang", "log_perplexity")
    sizes = cut(judged.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).select(
        F.col("lang").alias("l"), (F.col("texts") < min_docs).alias("small")))
    sizes = broadcast_if_small(sizes, sizes.count())

    def pooled(df: DataFrame) -> DataFrame:
        """With ``small`` (its language has the common band) and ``name``, else its language."""
        df = df.join(sizes, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
        return df.withColumn("small", F.coalesce("small", F.lit(True))).withColumn("name", F.when(~F.col("small"), F.col("lang")))

    bands = pooled(judged).groupBy("small", "name").agg(F.count(F.lit(1)).alias("n"), cuts.alias("q"))
    shortest = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.struct(
        F.element_at("q", i + 26) - F.element_at("q", i + 1), (F.element_at("q", i + 26) + F.element_at("q", i + 1)) / 2)))
    bands = bands.filter(F.col("n") >= min_docs).withColumn("half", shortest)
    spread = F.greatest(F.col("half")["col1"] / 1.349, F.lit(least))
    bands = cut(bands.select(F.col("small").alias("s"), F.col("name").alias("l"), (F.col("half")["col2"] - spread * below).alias("low"),
                             (F.col("half")["col2"] + spread * above).alias("high")))
    rows = pooled(rows).join(broadcast_if_small(bands, bands.count()),
                             (F.col("small") == F.col("s")) & F.col("name").eqNullSafe(F.col("l")), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.select(F.col("doc_id").alias(doc_id), F.col("lang").alias(lang), *names, "base_failed",
                       (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "low", "high")
