"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased and every run of characters that are no letters becomes
one space; subwords are its character n-grams (``sizes`` code points, spaces
mark word ends), hashed to ``buckets``. The input is the mean of the embedding rows
of all subwords of the whole text, the output a softmax over the languages of
the training rows. Embeddings and output weights are trained together by
stochastic gradient descent in numpy on the driver.

Bound: at most ``per_language`` documents of each language are used to fit
(chosen by a hash of id and text, a Spark filter whose rate follows from the
language's row count), so what reaches the driver does not grow with the
table. A fifth of them is kept out of training: on it a temperature is fitted
(calibrated confidence). Rejection is calibrated on languages the model has not
seen: the languages are dealt over ``folds`` groups, for each a model is trained
without it, and the confidences that this model gives the group's texts are
collected. The threshold is the least one that rejects ``unseen`` of those texts
and leaves accepted rows right in ``precision`` of the cases, but never one that
rejects more than 1 - ``keep`` of the held rows that are told rightly. With
fewer than three languages none can be left out: precision alone decides, and
the threshold is at most one half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Shipped, kept_names, map_batches

_GAP = regex.compile(r"\P{L}+")
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 13
    dim: int = 16
    sizes: tuple[int, ...] = (1, 2, 3)


def subwords(text: str | None, shape: Shape) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's subwords; None if it has no letter."""
    letters = _GAP.sub(" ", text.lower()).strip() if text else ""
    if not letters:
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32)
    total = np.zeros(shape.buckets, np.int64)
    shift = np.uint32(32 - shape.buckets.bit_length() + 1)
    for n in shape.sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i:len(codes) - n + 1 + i]) * _MIX
                h ^= h >> np.uint32(15)
            total += np.bincount((h * _MIX) >> shift, minlength=shape.buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    shape: Shape
    languages: list[str]
    table: np.ndarray      # buckets x dim, embeddings
    out: np.ndarray        # dim x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.out + self.bias

    def mean(self, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, n = features
        return (n / n.sum()).astype(np.float32) @ self.table[at]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence and whether it is rejected."""
        features = subwords(text, self.shape)
        if features is None or not self.languages:
            return "und", 0.0, True
        p = softmax(self.logits(self.mean(features)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _trained(x: np.ndarray, y: np.ndarray, train: np.ndarray, check: np.ndarray, languages: list[str], shape: Shape,
             epochs: int, rate: float, batch: int, seed: int) -> Model:
    """A model of the rows ``train``, its temperature fitted on the rows ``check``;
    ``y`` numbers the languages."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (shape.buckets, shape.dim)).astype(np.float32)
    model = Model(shape, languages, table, np.zeros((shape.dim, len(languages)), np.float32),
                  np.zeros(len(languages), np.float32))
    train = train.copy()
    steps, done = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            b, lr = train[i:i + batch], rate * (1 - done / steps)
            h = x[b] @ model.table
            g = softmax(model.logits(h))
            g[np.arange(len(b)), y[b]] -= 1
            g /= len(b)
            back = g @ model.out.T
            model.out -= lr * 30 * (h.T @ g)
            model.bias -= lr * g.sum(axis=0)
            model.table -= lr * 300 * (x[b].T @ back)
            done += 1
    z = model.logits(x[check] @ model.table)
    losses = {t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
              for t in np.geomspace(0.25, 8, 41)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def fit(rows: list[tuple[str, tuple[np.ndarray, np.ndarray]]], shape: Shape, epochs: int = 30, rate: float = 0.3,
        batch: int = 32, precision: float = 0.99, seed: int = 7, keep: float = 0.995, unseen: float = 0.99,
        folds: int = 5) -> Model:
    """Train on ``(language, features)`` rows; every fifth row calibrates."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model(shape, languages, np.zeros((shape.buckets, shape.dim), np.float32),
                     np.zeros((shape.dim, 0), np.float32), np.zeros(0, np.float32))
    x = np.zeros((len(rows), shape.buckets), np.float32)
    for i, (_, (at, n)) in enumerate(rows):
        x[i, at] = n / n.sum()
    y = np.array([languages.index(lang) for lang, _ in rows])
    held = np.arange(len(rows)) % 5 == 4
    how = (shape, epochs, rate, batch, seed)

    def sure(model: Model, at: np.ndarray) -> np.ndarray:
        return softmax(model.logits(x[at] @ model.table) / model.temperature)

    train, check = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    model = _trained(x, y, train, check, languages, *how)
    p = sure(model, check)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-best)
    ok = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    wanted = float(best[order][ok[-1]]) if len(ok) else 1.0

    foreign = []
    for fold in range(min(folds, len(languages)) if len(languages) > 2 else 0):
        known = [k for k in range(len(languages)) if k % folds != fold]
        inside = np.isin(y, known)
        if len(known) < 2 or not (inside & ~held).any() or not (inside & held).any():
            continue
        m = _trained(x, np.searchsorted(known, y), np.flatnonzero(inside & ~held), np.flatnonzero(inside & held),
                     [languages[k] for k in known], *how)
        foreign.append(sure(m, np.flatnonzero(~inside)).max(axis=1))
    wanted = max(wanted, float(np.quantile(np.concatenate(foreign), unseen))) if foreign else min(0.5, wanted)
    most = float(np.quantile(best[right], 1 - keep)) if right.any() else 0.5
    model.threshold = min(wanted, most)
    return model


def training_rows(docs: DataFrame, usable: Column, per_language: int, doc_id: str, text: str, lang: str,
                  shape: Shape) -> list[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """Features of at most about ``per_language`` usable rows of each language."""
    t = docs.filter(usable & F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in t.groupBy("lang").count().collect()}  # a row for each language
    draw = F.xxhash64("lang", "id", "text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(rate)

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [(i.as_py() or "", g.as_py(), subwords(x.as_py(), shape)) for i, x, g in zip(*b.columns)]
        out = [o for o in out if o[2] is not None]
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out]), pa.array([o[1] for o in out]),
             pa.array([o[2][0] for o in out], pa.list_(pa.int64())),
             pa.array([o[2][1] for o in out], pa.list_(pa.int64()))], names=["id", "lang", "at", "n"])
    picked = map_batches(t.filter(draw < rate), run, "id string, lang string, at array<bigint>, n array<bigint>", 256)
    rows = sorted(picked.toLocalIterator(), key=lambda r: (r["id"], r["lang"]))
    return [(r["lang"], (np.array(r["at"]), np.array(r["n"]))) for r in rows]


def train(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = 600, shape: Shape = Shape()) -> Model:
    """Fit on rows of ``docs`` where ``usable`` holds and ``lang`` is not null."""
    return fit(training_rows(docs, usable, per_language, doc_id, text, lang, shape), shape)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, lang_pred, score, rejected)`` per row, from the text only.

    A null text, or one without a letter, is ``und`` with score 0 and
    rejected; repeated rows stay rows; without training rows all are ``und``. A
    kept column of an output's name comes out as ``kept_<name>``.
    """
    sent = Shipped(docs.sparkSession, model)
    t = docs.select(F.col(doc_id).alias(doc_id), F.struct(*(F.col(c) for c in keep)).alias("kept"),
                    F.col(text).alias("the_text")) if keep else docs.select(doc_id, F.col(text).alias("the_text"))
    kinds = dict(t.dtypes)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.get()
        said = [m.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
        return pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()),
             pa.array([s[2] for s in said], pa.bool_())], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])
    head = ", ".join(f"`{c}` {kinds[c]}" for c in t.columns[:-1])
    out = map_batches(t, run, f"{head}, lang_pred string, score double, rejected boolean")
    names = kept_names(keep, (doc_id, "lang_pred", "score", "rejected"))
    return out.select(doc_id, *(F.col("kept")[c].alias(name) for c, name in names.items()), "lang_pred", "score", "rejected")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: 1 marks held-out documents (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
