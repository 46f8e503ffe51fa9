"""Repeated passages by a sparse suffix array.

Of every window of ``window`` consecutive word k-grams the one with the least
hash is an anchor (a minimiser), so two occurrences of a passage of
``min_words`` = k + window - 1 words keep a suffix at the same place of it;
about 2 / (window + 1) of all suffixes are retained.

1. Anchors whose k-gram occurs once in the whole corpus are dropped (a count
   with map-side combine; a k-gram may occur any number of times).
2. The suffixes that remain are sorted: by the k-gram's hash, then by the
   words that follow, then by the words before it, nearest first. The sort is
   a range partitioning that ends with document and place, so a passage with
   any share of all rows spreads over many tasks.
3. Neighbours are compared and the match extended right and left, word by
   word, up to ``window - 1`` words each way; a longer match goes on at the
   next anchor, which lies within that reach. The neighbour that agrees
   longest to the right need not be the one that agrees to the left, so the
   suffixes of a k-gram are sorted once for every way to share the remaining
   ``window - 1`` words between the two sides (no further to the right than
   the neighbours agree) and neighbours compared again. What the first and the
   last k-gram of a partition leave open there meets the other partitions'
   by hash: every partition gives one row at most for a hash.
4. Spans of ``min_words`` or more are united per document.

Words are runs of characters that are no ASCII white space, A-Z as a-z; they
are compared by 32 bits of their hash beyond the 64-bit hash of the k-gram.
A task holds the suffixes of one k-gram that its partition has.

A row is a document; rows with the same id and text are one (they don't
repeat each other), a null or short text has no passage, null ids are ids,
other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .tables import cut, doc_key, map_batches
from .wordhash import WordHasher, mix, white_space

ORDER = ("h", "right", "left", "key", "pos")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window (the first of equal ones)."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def _contexts(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a binary column (4 bytes each) as a matrix, and their number per row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 4
    n = np.diff(offsets)
    words = np.zeros((len(column), width), np.uint32)
    if offsets[-1] > offsets[0]:
        words[np.arange(width) < n[:, None]] = np.frombuffer(column.buffers()[2], "<u4", int(offsets[-1]))[offsets[0]:]
    return words, n


def _prefix_hashes(start: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the first 0, 1, ... words of each row."""
    yield start
    for i in range(words.shape[1]):
        start = mix(start * _STEP + words[:, i].astype(np.uint64) + np.uint64(1))
        yield start


def _repeats(rows: pa.Table, k: int, width: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Spans of the sorted suffixes of some whole k-grams. With ``first`` (``last``)
    other partitions may hold suffixes of the first (last) of these k-grams."""
    rows = rows.combine_chunks()
    h, key, pos = (rows.column(c).to_numpy() for c in ("h", "key", "pos"))
    fresh = np.ones(len(h), bool)                     # a row that repeats is one
    fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    if not fresh.all():
        rows = rows.filter(pa.array(fresh)).combine_chunks()
        h, key, pos = h[fresh], key[fresh], pos[fresh]
    (right, n_right), (left, n_left) = (_contexts(rows.column(c).chunk(0), width) for c in ("right", "left"))

    both = np.arange(width) < np.minimum(n_right[1:], n_right[:-1])[:, None]
    common = np.cumprod((right[1:] == right[:-1]) & both, axis=1, dtype=np.int8).sum(axis=1)
    common[h[1:] != h[:-1]] = -1                      # words neighbours agree in to the right; -1: other k-gram
    reach = np.maximum(np.append(common, -1), np.insert(common, 0, -1))
    edge = np.zeros(len(h), bool)
    # A row agrees with one beyond the partition no longer than with the row at that end.
    if first:
        m = int(np.searchsorted(h, h[0], "right"))
        edge[:m] = True
        reach[:m] = np.maximum(reach[:m], np.minimum.accumulate(np.insert(common[:m - 1], 0, width)))
    if last:
        m = int(np.searchsorted(h, h[-1], "left"))
        edge[m:] = True
        reach[m:] = np.maximum(reach[m:], np.minimum.accumulate(np.append(common[m:], width)[::-1])[::-1])

    lefts = list(_prefix_hashes(np.zeros(len(h), np.uint64), left))
    to_right, to_left = np.full(len(h), -1), np.full(len(h), -1)
    doc_id = rows.column("doc_id").chunk(0)

    def spans(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [gram, doc_id.take(pa.array(at)), pa.array(key[at]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            names=["gram", "doc_id", "key", "lo", "hi"])

    for r, rights in enumerate(_prefix_hashes(h.view(np.uint64), right)):
        at = np.flatnonzero((reach >= r) & (n_right >= r) & (n_left >= width - r))
        if not len(at):
            continue
        grams = mix(rights[at] + lefts[width - r][at] * _STEP)
        order = np.argsort(grams, kind="stable")
        at, grams = at[order], grams[order]
        same = grams[1:] == grams[:-1]
        met = at[np.append(same, False) | np.insert(same, 0, False)]
        to_right[met] = r
        to_left[met] = np.maximum(to_left[met], width - r)
        ask = np.insert(~same, 0, True) & edge[at]    # one row for each hash
        if ask.any():
            one = at[ask]
            yield spans(one, pos[one] - (width - r), pos[one] + k + r, pa.array(grams[ask].view(np.int64)))
    found = np.flatnonzero(to_right >= 0)
    if len(found):
        yield spans(found, pos[found] - to_left[found], pos[found] + k + to_right[found], pa.nulls(len(found), pa.int64()))


def _neighbours(k: int, width: int):
    """Task code over a sorted partition: ``_repeats`` of its k-grams, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], True
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            ends = int(np.searchsorted(h, h[-1], "left"))     # where the last k-gram of the batch begins
            other = bool(held) and held[-1].column(0)[0].as_py() != h[0]
            if other or ends:
                done = held if other and not ends else [*held, b.slice(0, ends)]
                if done:
                    yield from _repeats(pa.Table.from_batches(done), k, width, first, False)
                    first = False
                held = []
            held.append(b.slice(ends))
        if held:
            yield from _repeats(pa.Table.from_batches(held), k, width, first, True)
    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50,
                      window: int = 16) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words)``: the maximal runs of words, at
    least ``min_words`` long, that occur elsewhere too (in another document or
    at another place of the same); ends exclusive, ``n_words`` is their length.
    Documents without such a run have no row."""
    k = min_words - window + 1
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), doc_key(doc_id, text).alias("key"))
    id_type = dict(d.dtypes)["doc_id"]

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        hasher = WordHasher(white_space())
        h, key, pos = [], [], []
        for row, x in zip(b.column(0).to_pylist(), b.column(1)):
            grams = hasher.grams(hasher.words(x.as_py()), k)
            at = anchors(grams, window)
            h.append(grams[at].view(np.int64))
            key.append(np.full(len(at), row, np.int64))
            pos.append(at.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, key, pos)], names=["h", "key", "pos"])

    found = map_batches(d.select("key", "text"), find, "h bigint, key bigint, pos int", 1000)
    # A repeated row counts too, which keeps suffixes that then meet only themselves.
    twice = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # A k-gram with many rows is dealt over shares of at most about ``share`` rows. There are
    # at most 4 x partitions such k-grams, and twice as many shares, by choice of ``share``.
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    share = max(1, -(-total // (4 * shuffle_partitions(docs.sparkSession))))
    twice = twice.select("h", F.ceil(F.col("n") / share).alias("shares"))
    often = twice.filter("shares > 1").withColumnRenamed("h", "often")
    dealt = (found.join(F.broadcast(often), F.col("h") == F.col("often"), "left")
             .select("h", "key", "pos", F.coalesce(F.pmod(F.xxhash64("key", "pos"), "shares"), F.lit(0)).alias("share")))
    twice = twice.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    kept = (dealt.join(twice, ["h", "share"], "left_semi").groupBy("key")
            .agg(F.collect_set("pos").alias("at")))

    def suffixes(b: pa.RecordBatch) -> pa.RecordBatch:
        hasher = WordHasher(white_space())
        h, right, left, row, pos = [], [], [], [], []
        for j, (x, at) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
            words = hasher.words(x.as_py())
            at, short = np.array(sorted(at)), words.astype("<u4")
            h.append(hasher.grams(words, k).view(np.int64)[at])
            right += [short[p + k:p + k + window - 1].tobytes() for p in at]
            left += [short[max(0, p - window + 1):p][::-1].tobytes() for p in at]
            row.append(np.full(len(at), j))
            pos.append(at.astype(np.int32))
        row = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(h)), pa.array(right, pa.binary()), pa.array(left, pa.binary()), b.column(0).take(row),
             b.column(1).take(row), pa.array(np.concatenate(pos))], names=["h", "right", "left", "key", "doc_id", "pos"])

    full = d.select("key", "doc_id", "text").join(kept, "key")
    rows = map_batches(full, suffixes, f"h bigint, right binary, left binary, key bigint, doc_id {id_type}, pos int", 200)
    in_order = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    met = cut(in_order.mapInArrow(_neighbours(k, window - 1), f"gram bigint, doc_id {id_type}, key bigint, lo int, hi int"))
    # Of each hash a partition gives one row at most, so no hash has more rows than there are partitions.
    asked = met.filter("gram IS NOT NULL")
    answered = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    matches = met.filter("gram IS NULL").unionByName(asked.join(answered, "gram", "left_semi"))

    spans = F.sort_array(F.collect_set(F.struct("lo", "hi")))
    per_doc = matches.groupBy("key", "doc_id").agg(spans.alias("spans"))

    def unite(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lo, hi = spans[0]["lo"], spans[0]["hi"]
            for s in spans[1:]:
                if s["lo"] > hi:
                    out.append((i, lo, hi, hi - lo))
                    lo, hi = s["lo"], s["hi"]
                hi = max(hi, s["hi"])
            out.append((i, lo, hi, hi - lo))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (b.column(0).type, pa.int32(), pa.int32(), pa.int32()))],
            names=["doc_id", "start_word", "end_word", "n_words"])
    return map_batches(per_doc.select("doc_id", "spans"), unite,
                       f"doc_id {id_type}, start_word int, end_word int, n_words int").withColumnRenamed("doc_id", doc_id)
