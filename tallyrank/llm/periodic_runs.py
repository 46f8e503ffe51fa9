"""Periodic runs of words, by a sparse dynamic program over diagonals.

A run is a maximal stretch of words with a smallest period q whose length is at
least ``shortest`` and at least 2q. On the diagonal of lag q (word i against
word i - q) it is one segment of consecutive matches, of length - q words. The
program extends match lengths word by word along the active lags; a diagonal
that ends with a sufficient length is a run at once. Two facts keep it sparse:

* A run of lag q has at least k = max(q, shortest - q) matches in a row. So for
  lags in [k, 2k) an earlier occurrence counts only if the next k words agree,
  not one word: the lags fall into tiers, k doubles from tier to tier, and the
  identity of all k-word windows of a tier follows from the tier before (exact
  numbers of pairs, no hashes). Tiers end where no window occurs twice.
* Only the first match of a segment opens its diagonal. An occurrence at most
  k / 2 words after another of the same window continues it with the window's
  own period, so two such occurrences are always preceded by the same word and
  never open a diagonal. Every pair that opens one has a member without a close
  predecessor, and of these a tier holds at most five in reach of any word.

A text of n words thus opens O(n log n) diagonals whatever it repeats (a word
repeated a million times opens two for each word, not a million), and all their
match lengths are counted at once in numpy: by whole windows of the tiers,
longest first, then by words. Diagonals of the same stretch belong to multiples
of one period; the least is kept.

A row is a document; repeated rows and null ids stay rows of their own; a null
or empty text has no words and no runs; an empty table gives no rows; other
columns are ignored. A task holds one text at a time, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for every pair, equal for equal pairs."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """A number for every window of ``k`` words, equal for equal windows."""
    g, size = words, 1
    while 2 * size <= k:
        g, size = _numbered(g[:-size], g[size:]), 2 * size
    return _numbered(g[:len(g) - (k - size)], g[k - size:]) if size < k else g


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, and every member."""
    n = np.maximum(hi - lo, 0)
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lo[who]


def _opened(words: np.ndarray, g: np.ndarray, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (i, j) where windows agree, i - j is a lag in [lo, hi), and the words
    before them differ. None if no window occurs twice."""
    at = np.argsort(g, kind="stable")
    same = g[at[1:]] == g[at[:-1]]
    if not same.any():
        return None
    twice = np.append(same, False) | np.insert(same, 0, False)
    at = at[twice]
    span = np.int64(len(words) + 1)
    key = g[at] * span + at
    close = np.zeros(len(at), bool)
    close[1:] = (g[at[1:]] == g[at[:-1]]) & (2 * (at[1:] - at[:-1]) <= k)
    free = np.flatnonzero(~close)
    base, pos = g[at[free]] * span, at[free]
    who, j = _ranges(np.searchsorted(key, base + np.maximum(pos - hi + 1, 0)), np.searchsorted(key, base + pos - lo, "right"))
    i, j = pos[who], at[j]
    who, later = _ranges(np.searchsorted(key, base + np.minimum(pos + lo, span - 1)),
                         np.searchsorted(key, base + np.minimum(pos + hi, span - 1)))
    met = close[later]                          # those without a close predecessor are in the first set
    i, j = np.concatenate([i, at[later[met]]]), np.concatenate([j, pos[who[met]]])
    opens = (j == 0) | (words[i - 1] != words[j - 1])
    return i[opens], j[opens]


def runs(words: np.ndarray, shortest: int = 12) -> np.ndarray:
    """``(start, length, period)`` of all runs, by start, then period. ``words``: a number for each word."""
    n, k = len(words), max(1, (shortest + 1) // 2)
    none = np.zeros((0, 3), np.int64)
    if n < max(shortest, 2):
        return none
    tiers, opened, g, lo = [], [], _windows(words, k), 1
    while True:
        found = _opened(words, g, k, lo, 2 * k)
        if found is None:
            break
        tiers.append((k, g))
        opened.append(found)
        if len(g) <= k:
            break
        g, k, lo = _numbered(g[:-k], g[k:]), 2 * k, 2 * k
    if not opened:
        return none
    i, j = (np.concatenate(x) for x in zip(*opened))
    length = np.zeros(len(i), np.int64)         # of the match so far
    for k, g in reversed(tiers):
        able = np.flatnonzero(i + length < len(g))
        able = able[g[i[able] + length[able]] == g[j[able] + length[able]]]
        length[able] += k
    for _ in range(tiers[0][0] - 1):
        able = np.flatnonzero(i + length < n)
        able = able[words[i[able] + length[able]] == words[j[able] + length[able]]]
        length[able] += 1
    lag = i - j
    enough = length >= np.maximum(lag, shortest - lag)
    start, length, lag = j[enough], (length + lag)[enough], lag[enough]
    order = np.lexsort((lag, length, start))
    out = np.column_stack([start, length, lag])[order]
    first = np.ones(len(out), bool)             # of one stretch the smallest period
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when of every run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 12) -> DataFrame:
    """``(doc_id, runs, collapsed)`` of every document: its runs ``array<struct<start,
    length, period>>`` in words, by start, then period, and its words, joined by one
    space, without those that any run holds after its first period."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], []
        for t in b.column(1):
            words = (t.as_py() or "").encode("utf-8").split()       # at ASCII white space
            number: dict[bytes, int] = {}
            found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), shortest)
            rows.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
            if len(found):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), found))]
            texts.append(b" ".join(words).decode("utf-8"))
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(texts, pa.string())],
                                          names=["doc_id", "runs", "collapsed"])
    out = map_batches(d, find, f"doc_id {dict(d.dtypes)['doc_id']}, runs {RUNS}, collapsed string", 256)
    return out.withColumnRenamed("doc_id", doc_id)
