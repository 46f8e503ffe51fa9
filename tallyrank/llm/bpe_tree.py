"""BPE encoding and decoding, with long unsplit texts put together as a tree.

A text of at most ``piece`` code points is encoded by the tokenizer in one task,
each distinct string between white space once for a batch of texts. A longer one
is cut, and its pieces are rows of their own that are dealt over all tasks:

* at white space, which the tokenizer drops, so that nothing spans a cut;
* where more than ``piece`` code points hold no white space, into the words the
  tokenizer's own normaliser and splitter find there;
* a word that is still longer than ``piece`` symbols into parts. The parts are
  encoded apart, then joined two by two, level by level: around each join a
  window of tokens is encoded again and grown on either side until its first
  and last token are those the sides have there. The result is exact: BPE
  output is the one sequence in which every two neighbouring tokens are what
  encoding the two alone gives; pairs inside the sides and inside the window
  are that already, and the window shares its outer tokens with the sides.

Only the last part of a word carries the tokenizer's end-of-word mark. The
tokenizer comes as a file's path; the driver reads it and sends its content,
which does not grow with the data, to the tasks.

A row is a document; repeated rows and null or repeated ids stay rows of their
own; a null text counts as empty, an empty text has no ids; an empty table gives
no rows; other columns are ignored. Strings of the tokenizer's special tokens
inside a text become those tokens, as in the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, map_batches

RAW, WORDS, INNER, LAST = range(4)      # what a piece holds
_BLANK = re.compile(r"[ \t\n\r]")
#: What white space separates, without the marks that follow a run of letters.
_MARKS = ".,;:!?"
_SOLID = re.compile(r"[^ \t\n\r]+")
_CHUNK = re.compile(rf"[A-Za-z]+(?![^ \t\n\r{_MARKS}])|[^ \t\n\r]+")
#: Distinct strings a task remembers the ids of.
REMEMBERED = 100_000
_PIECE = "row bigint, no int, word int, kind int, texts array<string>"
_IDS = "row bigint, no int, word int, kind int, ids array<int>"


class Codec:
    """A tokenizer, and its BPE model without and with the end-of-word mark."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer, models
        spec = json.loads(content)
        spec["truncation"] = spec["padding"] = None
        model = spec["model"]
        if model["type"] != "BPE" or any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("a BPE tokenizer is needed whose added tokens are plain strings")
        self.whole = Tokenizer.from_str(json.dumps(spec))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.mark = model["end_of_word_suffix"] or ""
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.mark) if self.mark else self.inner
        self.token = {i: t for t, i in model["vocab"].items()}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        names = self.whole.get_vocab(with_added_tokens=True)
        self.names = pa.array(sorted(names, key=names.get), pa.string())
        self.known: dict[str, list[int]] = {}
        self.ends = np.array([bool(self.mark) and n.endswith(self.mark) for n in sorted(names, key=names.get)])
        split = self.whole.pre_tokenizer
        self.parts_marks = split is not None and all(len(split.pre_tokenize_str("ab" + m)) == 2 for m in _MARKS)
        if sorted(names.values()) != list(range(len(names))):
            raise ValueError("the tokenizer's ids have gaps")

    def texts(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts; each distinct string between white space (a run of
        letters without the mark after it, if the splitter parts them) is encoded once."""
        chunks = [_CHUNK.findall(t) for t in texts] if self.parts_marks else [_SOLID.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list({c for cs in chunks for c in cs if c not in self.known})
        letters = [c for c in fresh if c.isascii() and c.isalpha()] if self.mark else []
        at_once = self._at_once(letters)
        rest = [c for c in fresh if c not in at_once]
        self.known.update(at_once)
        self.known.update(zip(rest, (e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False))))
        return [list(chain.from_iterable(map(self.known.__getitem__, cs))) for cs in chunks]

    def _at_once(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of words, from one text of all. Each ends with a token that has the
        end mark; as many marks as words means one each, else nothing is taken."""
        ids = self.whole.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1
        return dict(zip(words, (ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())))) if len(ends) == len(words) else {}

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        if self.whole.decoder is not None:
            return pa.array(self.whole.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())
        # Without a decoder the library joins the tokens by a space.
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")

    def word(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.last if last else self.inner).tokenize(symbols)]

    def symbols(self, ids: list[int], last: bool) -> str:
        s = "".join(self.token[i] for i in ids)
        return s[:len(s) - len(self.mark)] if last and self.mark else s

    def words(self, text: str) -> Iterator[tuple[int, str]]:
        """The words (as BPE symbols) and special tokens (as they are) of a text."""
        for i, t in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield RAW, t
            elif t:
                norm, split = self.whole.normalizer, self.whole.pre_tokenizer
                for w, _ in split.pre_tokenize_str(norm.normalize_str(t) if norm else t):
                    yield WORDS, w

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of two neighbouring parts of a word as one; ``last``: the word ends with ``right``."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            l, r = left[len(left) - a:], right[:b]
            ends = last and b == len(right)
            window = self.word(self.symbols(l, False) + self.symbols(r, ends), ends)
            left_agrees = a == len(left) or window[0] == l[0]
            right_agrees = b == len(right) or window[-1] == r[-1]
            if left_agrees and right_agrees:
                return left[:len(left) - a] + window + right[b:]
            a, b = a if left_agrees else 2 * a, b if right_agrees else 2 * b


def pieces(codec: Codec, text: str, piece: int) -> Iterator[tuple[int, int, list[str]]]:
    """``(word, kind, texts)`` of the pieces of a text in order; parts of one word share ``word``."""
    no, at = 0, 0
    while at < len(text):
        end = at + piece
        blank = _BLANK.search(text, end - 1) if end < len(text) else None
        if end >= len(text) or (blank and blank.start() < end + piece):
            end = len(text) if end >= len(text) else blank.end()
            yield no, RAW, [text[at:end]]
            no += 1
        else:                                   # no white space for ``piece`` code points
            end = blank.end() if blank else len(text)
            held: list[str] = []
            size = 0
            for kind, w in codec.words(text[at:end]):
                alone = kind == RAW or len(w) > piece
                if held and (alone or size + len(w) > piece):
                    yield no, WORDS, held
                    no, held, size = no + 1, [], 0
                if kind == RAW:
                    yield no, RAW, [w]
                    no += 1
                elif alone:
                    parts = -(-len(w) // piece)
                    for i in range(parts):
                        yield no, INNER if i + 1 < parts else LAST, [w[i * piece:(i + 1) * piece]]
                    no += parts
                else:
                    held.append(w)
                    size += len(w)
            if held:
                yield no, WORDS, held
                no += 1
        at = end


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))


def _sent(docs: DataFrame, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _with_codec(sent: Broadcast, fn):
    """A function of batches that gets a codec, made once in each task."""
    made: list[Codec] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(Codec(sent.value))
        return fn(made[0], b)
    return run


def _cut(piece: int):
    def run(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        out = [(row, no, word, kind, texts) for row, text in zip(b.column(0).to_pylist(), b.column(1))
               for no, (word, kind, texts) in enumerate(pieces(codec, text.as_py(), piece))]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())))],
            names=["row", "no", "word", "kind", "texts"])
    return run


def _encode_pieces(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
    ids = []
    for kind, texts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
        if kind == RAW:
            ids.append(codec.texts(texts)[0])
        else:
            ids.append([i for w in texts for i in codec.word(w, kind != INNER)])
    return pa.RecordBatch.from_arrays([*b.columns[:4], _lists(ids)],
                                      names=["row", "no", "word", "kind", "ids"])


def _join_pair(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one or two neighbouring parts ``(no, kind, ids)`` to one part."""
    kinds, ids = [], []
    for pair in b.column(3).to_pylist():
        kinds.append(pair[-1]["kind"])
        ids.append(pair[0]["ids"] if len(pair) == 1 else codec.join(pair[0]["ids"], pair[1]["ids"], kinds[-1] == LAST))
    return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kinds, pa.int32()), _lists(ids)],
                                      names=["row", "no", "word", "kind", "ids"])


def _tree(parts: DataFrame, sent: Broadcast) -> DataFrame:
    """The parts of each word joined two by two until one is left. A level groups two rows at most."""
    parts = parts.withColumn("no", F.col("no") - F.col("word"))
    while True:
        parts = cut(parts)
        if (parts.agg(F.max("no")).first()[0] or 0) == 0:
            return parts.withColumn("no", F.col("word"))
        pairs = (parts.groupBy("row", F.floor(F.col("no") / 2).cast("int").alias("no"), "word")
                 .agg(F.sort_array(F.collect_list(F.struct("no", "kind", "ids"))).alias("pair")))
        parts = map_batches(pairs, _with_codec(sent, _join_pair), _IDS, 16)


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", piece: int = 1 << 16,
           batch: int = 512) -> DataFrame:
    """``(doc_id, ids array<int>, decoded)`` of every document: the ids of its whole
    text as the tokenizer at path ``tokenizer`` gives them without adding special
    tokens, and what these decode to, special tokens included."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent, kind = _sent(docs, tokenizer), dict(d.dtypes)["doc_id"]
    out = f"doc_id {kind}, ids array<int>, decoded string"

    def both(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.texts(b.column(1).to_pylist())
        found = _lists(ids)
        return pa.RecordBatch.from_arrays([b.column(0), found, codec.decoded(found)], names=["doc_id", "ids", "decoded"])

    def decoded(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = _lists(b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), ids, codec.decoded(ids)], names=["doc_id", "ids", "decoded"])

    short = map_batches(d.filter(F.length("text") <= piece), _with_codec(sent, both), out, batch)
    # The rows of long texts, numbered once for good in the shared folder.
    long = d.filter(F.length("text") > piece).withColumn("row", F.monotonically_increasing_id())
    names = cut(long.select("row", "doc_id", "text"))
    rows = map_batches(names.select("row", "text"), _with_codec(sent, _cut(piece)), _PIECE, 1)
    rows = rows.repartition("row", "no")
    ids = cut(map_batches(rows, _with_codec(sent, _encode_pieces), _IDS, 16))
    split = F.col("kind").isin(INNER, LAST)
    whole = ids.filter(~split).unionByName(_tree(ids.filter(split), sent))
    whole = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("all"))
    whole = whole.select("row", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))
    joined = names.select("row", "doc_id").join(whole, "row").select("doc_id", "ids")
    result = short.unionByName(map_batches(joined, _with_codec(sent, decoded), out, batch))
    return result.withColumnRenamed("doc_id", doc_id)
