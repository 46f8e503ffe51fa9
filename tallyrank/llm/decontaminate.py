"""Benchmark decontamination with one Aho-Corasick automaton over word ids.

Normalisation: A-Z to a-z; words are maximal runs of digits, a-z and all
characters beyond ASCII. Items are cut into windows of ``n`` consecutive
words (an item with fewer words, but not none, is one window). The automaton's
alphabet is the items' vocabulary, so a document is scanned once, as a
sequence of word ids, and a match ends at a known word; words no item uses
lead back to the root. Offsets of hit runs refer to the original text.

The items are the only thing sent to every task. They are collected and
broadcast in blocks of at most ``block_words`` words (a proven bound on
driver and executor memory); further blocks are further passes of the same
scan over the carried result, so any number of items works the same way.

Nulls: a null text has no words; a null item text has no windows; null ids are
ids like any other (a null item id is listed as an empty string). Documents
that repeat are separate rows. Without items nothing is hit. Other columns of
the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept_names

# Bytes that are no word characters become spaces, A-Z becomes a-z, and bytes
# beyond ASCII (parts of other characters) stay.
_SPACE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).isalpha() else 0x20 for b in range(256))
_TABLE = _SPACE.lower()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def windows(item: list[bytes], n: int) -> Iterator[tuple[int, int]]:
    if item:
        for i in range(max(1, len(item) - n + 1)):
            yield i, min(len(item), i + n)


class Scanner:
    """Vocabulary and automaton of a block of items; made once per task."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for lo, hi in windows(ids, n):
                owners.setdefault(tuple(ids[lo:hi]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), who))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, ids: tuple[int, ...]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word ranges of all occurrences, and the items they belong to."""
        ranges, who = [], set()
        if not self.empty:
            for end, (k, owners) in self.automaton.iter(ids):
                ranges.append((end - k + 1, end + 1))
                who |= owners
        return ranges, who


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, spark: SparkSession) -> Iterator[Broadcast]:
    """The items, broadcast in blocks of at most ``block_words`` words (an item
    with more is a block of its own), fetched one Spark partition at a time."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    for r in rows.toLocalIterator():
        k = len(words(r["text"]))
        if block and size + k > block_words:
            yield spark.sparkContext.broadcast(block)
            block, size = [], 0
        block.append((r["id"], r["text"]))
        size += k
    if block:
        yield spark.sparkContext.broadcast(block)


def word_offsets(text: str, hit: list[int]) -> list[dict]:
    """Runs of consecutive hit words as code-point ranges of the original text."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out: list[dict] = []
    for k, w in enumerate(hit):
        if k and hit[k - 1] == w - 1:
            out[-1]["end"] = at[w][1]
        else:
            out.append({"start": at[w][0], "end": at[w][1]})
    return out


def _pass(block, n: int, last: bool):
    """Add one block's hits to every row; the last pass also finds the offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block.value, n)
        for b in batches:
            texts = b.column("text").to_pylist()
            hits, items, spans, n_words = [], [], [], []
            for text, hit, who in zip(texts, b.column("hit").to_pylist(), b.column("item_ids").to_pylist()):
                found = words(text)
                get = scanner.vocab.get
                ranges, new = scanner.scan(tuple([get(w, 0) for w in found]))
                if ranges:
                    covered = set(hit).union(*(range(lo, hi) for lo, hi in ranges))
                    hit, who = sorted(covered), sorted(new.union(who))
                hits.append(hit)
                items.append(who)
                n_words.append(len(found))
                spans.append(word_offsets(text, hit) if last and hit else [])
            own = {"hit": hits, "item_ids": items, "spans": spans, "n_words": n_words}
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[f.name], f.type) if f.name in own else b.column(i) for i, f in enumerate(b.schema)],
                schema=b.schema)
    return run


def scan_documents(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_words: int = 2_000_000,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, the columns ``keep`` (the text may be
    one of them), ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``item_ids`` (of the windows that occur, sorted as strings) and
    ``spans``, the hit runs as ``array<struct<start, end>>`` in code points of
    the original text. A kept column of such a name comes out as ``kept_<name>``."""
    spark = docs.sparkSession
    df = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        *(F.col(c).alias(f"kept_{c}") for c in keep if c not in (doc_id, text)),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit"),
        F.array().cast("array<string>").alias("item_ids"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    blocks = list(item_blocks(items, item_id, item_text, block_words, spark)) or [spark.sparkContext.broadcast([])]
    schema = df.schema
    for k, block in enumerate(blocks):
        df = df.mapInArrow(_pass(block, n, k == len(blocks) - 1), schema)
    kept = {doc_id: "doc_id", text: "text"}
    names = kept_names(tuple(c for c in keep if c != doc_id), (doc_id, "n_words", "n_hit", "item_ids", "spans"))
    return df.select(
        F.col("doc_id").alias(doc_id),
        *(F.col(kept.get(c, f"kept_{c}")).alias(name) for c, name in names.items()),
        "n_words", F.size("hit").cast("long").alias("n_hit"), "item_ids", "spans")


def remove_spans(text: Column, spans: Column, by: str = "") -> Column:
    """``text`` with the (sorted, disjoint) ``spans`` replaced by ``by``; built-in functions only."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(spans) > 0, F.array_join(pieces, by)).otherwise(text)
