"""Severity of toxicity by cumulative-link ordinal regression.

Grades 0 to K are ordered; P(grade > k) = sigmoid(w.x - t_k) with one weight
vector shared by all thresholds t_0 < t_1 < ...; the expected severity is the
sum of these probabilities. Features are sparse: which hashed words and word
beginnings (of ``HEADS`` bytes) a text has (letters only, A-Z as a-z). Before the
fit those with a chi-square of at least ``min_chi`` against "grade above k", for
any k, are chosen (the ``keep`` largest) among those in at least ``min_texts``
texts; both are absolute, so a marker of a small language counts however many rows
other languages have. A group of near copies counts as one text here (equal in
three least feature hashes), so it doesn't teach its own rare words.

Bound: at most about ``sample`` labelled rows are used to fit (drawn by a hash
of id and text); only their feature numbers reach the driver. Scoring covers
every whole text.

A null or empty text has no features and gets the severity that the
thresholds alone give; rows with a null grade are not used to fit; repeated
rows are rows; without labelled rows every severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Shipped, map_batches
from .wordhash import WordHasher, mix, no_letter

BITS = 22
HEADS = (4, 5, 6, 8)


@dataclass
class Model:
    buckets: np.ndarray     # sorted feature numbers
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def above(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold."""
        if not len(self.thresholds):
            return np.zeros(0)
        at = np.minimum(np.searchsorted(self.buckets, found), max(0, len(self.buckets) - 1))
        w = self.weights[at][self.buckets[at] == found].sum() if len(self.buckets) and len(found) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - w, -50, 50)))


def features(hasher: WordHasher, text: str | None) -> np.ndarray:
    """Sorted numbers of the distinct words and word beginnings of a text."""
    found = np.concatenate([hasher.words(text), *(hasher.heads(text, n) for n in HEADS)])
    return np.unique(found >> np.uint64(64 - BITS)).astype(np.int64)


def without_copies(rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """One row of each group of near copies with the same grade; of rows with
    fewer than 16 features each stays, since those agree by chance."""
    seen: set = set()
    out = []
    for f, g in rows:
        if len(f) < 16:
            out.append((f, g))
            continue
        least = [int(mix(f.astype(np.uint64) + np.uint64((i + 1) << 32)).min()) for i in range(12)]
        keys = {(i, g, *least[i:i + 3]) for i in range(0, 12, 3)}
        if not keys & seen:
            out.append((f, g))
        seen |= keys
    return out


def select(rows: list[tuple[np.ndarray, int]], keep: int, min_texts: int, min_chi: float) -> np.ndarray:
    """The feature numbers with the largest chi-square against "grade > k" for any
    k, of at least ``min_chi`` and in at least ``min_texts`` rows."""
    n, top = len(rows), max(g for _, g in rows)
    seen = np.zeros((top + 1, 1 << BITS), np.int32)
    for f, g in rows:
        seen[:g + 1, f] += 1
    some = np.flatnonzero(seen[0] >= min_texts)
    df, best = seen[0, some].astype(float), np.zeros(len(some))
    for k in range(top):
        bad, hit = sum(g > k for _, g in rows), seen[k + 1, some].astype(float)
        det = hit * (n - bad - (df - hit)) - (bad - hit) * (df - hit)
        best = np.maximum(best, n * det ** 2 / np.maximum(df * (n - df) * max(bad, 1) * max(n - bad, 1), 1))
    order = np.argsort(-best, kind="stable")[:keep]
    return np.sort(some[order[best[order] >= min_chi]])


def fit(rows: list[tuple[np.ndarray, int]], keep: int = 1024, min_texts: int = 5, min_chi: float = 40.0,
        rounds: int = 600, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """Maximum likelihood with an L1 penalty on the shared weights (Adam, full batch)."""
    top = max((g for _, g in rows), default=0)
    if top == 0:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    alone = without_copies(rows)
    chosen = select(alone, keep, min_texts, min_chi) if alone else np.zeros(0, np.int64)
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (f, _) in enumerate(rows):
        x[i] = np.isin(chosen, f, assume_unique=True)
    over = np.array([[g > k for k in range(top)] for _, g in rows], float)
    share = over.mean(axis=0).clip(1e-4, 1 - 1e-4)
    t = np.log((1 - share) / share)
    # First threshold, then logarithms of the gaps: the order can't be lost.
    p = np.concatenate([np.zeros(len(chosen)), t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(chosen)
    for i in range(1, rounds + 1):
        gaps = np.exp(p[k + 1:])
        t = p[k] + np.concatenate([[0], np.cumsum(gaps)])
        z = (x @ p[:k].astype(np.float32)).astype(float)[:, None] - t
        q = 1 / (1 + np.exp(np.clip(-z, -50, 50)))
        # Likelihood of the grade: P(> g-1) - P(> g).
        edge = np.hstack([np.ones((len(x), 1)), q, np.zeros((len(x), 1))])
        grade = over.sum(axis=1).astype(int)
        prob = np.maximum(edge[np.arange(len(x)), grade] - edge[np.arange(len(x)), grade + 1], 1e-9)
        slope = q * (1 - q)
        dz = np.zeros_like(z)
        has, rows_at = grade > 0, np.arange(len(x))
        dz[rows_at[has], grade[has] - 1] -= slope[has, grade[has] - 1] / prob[has]
        low = grade < top
        dz[rows_at[low], grade[low]] += slope[low, grade[low]] / prob[low]
        dz /= len(x)
        g_w = (x.T @ dz.sum(axis=1).astype(np.float32)).astype(float) + penalty * np.sign(p[:k])
        g_t = -dz.sum(axis=0)
        g = np.concatenate([g_w, [g_t.sum()], gaps * np.cumsum(g_t[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8) * min(1.0, 2 * (1 - i / (rounds + 1)))
    return Model(chosen, p[:k], p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1:]))]))


def train(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade",
          sample: int = 20_000, **options) -> Model:
    """Fit on the documents graded in ``grades (doc_id, grade)``."""
    g = grades.select(F.col(doc_id).alias("id"), F.col(grade).cast("int").alias("grade")).filter("grade IS NOT NULL")
    rate = min(1.0, sample / max(1, g.count()))
    draw = F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    g = g.filter(draw < rate)
    t = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(g, "id").select("id", "text", "grade")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hasher = WordHasher(no_letter())
        return pa.RecordBatch.from_arrays(
            [pa.array([str(i) for i in b.column(0).to_pylist()]), b.column(2),
             pa.array([features(hasher, x.as_py()).astype(np.int32).tobytes() for x in b.column(1)], pa.binary())], names=["id", "grade", "at"])
    # Copies teach nothing new; the order does not depend on the partitions.
    once = {(bytes(r["at"]), max(0, r["grade"])) for r in map_batches(t, run, "id string, grade int, at binary", 256).toLocalIterator()}
    return fit([(np.frombuffer(at, np.int32), g) for at, g in sorted(once)], **options)


def severity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
             toxic_from: int = 1) -> DataFrame:
    """``(doc_id, expected_severity, grade, toxic)`` per row: ``grade`` is the
    number of thresholds passed with probability one half or more, ``toxic``
    whether it is ``toxic_from`` or higher."""
    sent = Shipped(docs.sparkSession, model)
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, hasher = sent.get(), WordHasher(no_letter())
        p = [m.above(features(hasher, x.as_py())) for x in b.column(1)]
        grade = [int((q >= 0.5).sum()) for q in p]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([float(q.sum()) for q in p]), pa.array(grade, pa.int32()),
             pa.array([g >= toxic_from for g in grade])], names=["doc_id", "expected_severity", "grade", "toxic"])
    return map_batches(t, run, f"doc_id {dict(t.dtypes)['doc_id']}, expected_severity double, grade int, toxic boolean"
                       ).withColumnRenamed("doc_id", doc_id)
