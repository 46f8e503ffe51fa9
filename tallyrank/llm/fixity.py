"""WARC records and a Merkle fixity audit of replicas.

``warc_records`` lays rows out as WARC/1.1 resource records with the four
mandatory fields; the pages hold no time of their own, so ``WARC-Date`` is an
argument, one time for the whole crawl. An input partition is a file, as each
task would write one, and a record's offset is where it starts in its file:
``file`` and ``offset`` follow from how the input is split.

``audit`` compares replicas ``(file, offset, record)``. Leaves are hashes of
records. Every node above covers an ordered range of offsets: level 1 has a
node for each ``span`` bytes of a file (by the offset where a record starts),
each further level joins ``fanout`` neighbouring ranges, up to one root a
file, and the file roots are joined in the same way, by ranges of file
numbers, to one root of the replica. A node's hash is taken over its children
in order. Groups are bounded by ``span`` and ``fanout``, whatever is in the
files; a hash moves up, never a record.

The audit compares roots and descends only into branches that differ: at each
level the children of differing nodes are compared, the rest is never read
again. Below level 1 it reports records that differ, are missing from or extra
in the replica, by offset.

Records that repeat at the same place count as many times as they occur; a
null record is hashed as a null, not as an empty one; an empty replica differs
in every record of the other; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

SPAN, FANOUT = 1 << 16, 16
CRAWLED = "2001-01-01T00:00:00Z"


def warc_record(url: str | None, payload: str | None, date: str = CRAWLED) -> bytes:
    """One resource record; its id follows from its content. Null counts as empty."""
    body = (payload or "").encode("utf-8")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = hashlib.sha256(body).hexdigest()
    head = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, target + digest)}>\r\n"
            f"WARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return head.encode("utf-8") + body + b"\r\n\r\n"


def warc_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
                 date: str = CRAWLED) -> DataFrame:
    """``(page_id, file, offset, record)`` in the order of the input. Repeated rows are
    records of their own; other columns are ignored; ``date`` is UTC, as in ISO 8601."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                records = [warc_record(u.as_py(), x.as_py(), date) for u, x in zip(c.column(1), c.column(2))]
                offsets = []
                for r in records:
                    offsets.append(at)
                    at += len(r)
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array([file] * len(records), pa.int32()), pa.array(offsets, pa.int64()),
                     pa.array(records, pa.binary())], names=["page_id", "file", "offset", "record"])
    return p.mapInArrow(run, f"page_id {dict(p.dtypes)['page_id']}, file int, offset bigint, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """``(file, offset, length, hash)`` of every record."""
    r = F.col("record").cast("binary")
    return records.select(
        F.col("file").cast("long").alias("file"), F.col("offset").cast("long").alias("offset"),
        F.length(r).cast("long").alias("length"), F.coalesce(F.sha2(r, 256), F.lit("null")).alias("hash"))


def _node(*order: str) -> Column:
    """The hash of a group's children, in their order."""
    return F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(*order))),
        lambda c: F.concat_ws(" ", *(c[x].cast("string") for x in order))), "\n"), 256).alias("hash")


def tree(leaf: DataFrame, span: int = SPAN, fanout: int = FANOUT, height: int | None = None,
         file_height: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of a replica's tree, lowest first: per file ``(file, node, hash)``,
    then over files ``(node, hash)``; the last has the root. ``leaf`` should be
    materialised: each level is made from the one below and kept."""
    levels = [cut(leaf.groupBy("file", F.floor(F.col("offset") / span).alias("node")).agg(_node("offset", "length", "hash")))]
    for _ in range(height or 0):
        levels.append(cut(levels[-1].withColumn("child", F.col("node")).groupBy(
            "file", F.floor(F.col("child") / fanout).alias("node")).agg(_node("child", "hash"))))
    files = [cut(levels[-1].groupBy(F.col("file").alias("node")).agg(_node("node", "hash")))]
    for _ in range(file_height or 0):
        files.append(cut(files[-1].withColumn("child", F.col("node")).groupBy(
            F.floor(F.col("child") / fanout).alias("node")).agg(_node("child", "hash"))))
    return levels, files


def _heights(most_offset: int, most_file: int, span: int, fanout: int) -> tuple[int, int]:
    """Levels above the first until one node is left, within files and over them."""
    def levels(n: int) -> int:
        k = 0
        while n > 0:
            n, k = n // fanout, k + 1
        return k
    return levels(most_offset // span), levels(most_file)


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes whose hashes differ or that only one side has."""
    j = a.select(*keys, F.col("hash").alias("ha")).join(b.select(*keys, F.col("hash").alias("hb")), keys, "full")
    return j.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """``(file, offset, status, length, replica_length)`` of every record that
    differs: status ``changed``, ``missing`` (not in the replica) or ``extra``.
    Records at the same place (bytes of other lengths can't share one in a
    sound file) are compared as a sorted list."""
    sides = [cut(leaves(x)) for x in (primary, replica)]
    most = [s.agg(F.max("offset"), F.max("file")).first() for s in sides]
    height, file_height = _heights(max((m[0] or 0) for m in most), max((m[1] or 0) for m in most), span, fanout)
    (la, fa), (lb, fb) = (tree(s, span, fanout, height, file_height) for s in sides)

    # From the root of the replica down to files, then down to ranges.
    open_ = _differing(fa[-1], fb[-1], ["node"])
    for a, b in zip(fa[-2::-1], fb[-2::-1]):
        under = open_.select(F.col("node").alias("parent"))
        a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(under, "parent", "left_semi") for x in (a, b))
        open_ = cut(_differing(a, b, ["node"]))
    files = open_.select(F.col("node").alias("file"))
    open_ = cut(_differing(*(x[-1].join(files, "file", "left_semi") for x in (la, lb)), ["file", "node"]))
    for a, b in zip(la[-2::-1], lb[-2::-1]):
        under = open_.select("file", F.col("node").alias("parent"))
        a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(under, ["file", "parent"], "left_semi")
                for x in (a, b))
        open_ = cut(_differing(a, b, ["file", "node"]))

    def records(s: DataFrame, tag: str) -> DataFrame:
        here = s.withColumn("node", F.floor(F.col("offset") / span)).join(open_, ["file", "node"], "left_semi")
        return here.groupBy("file", "offset").agg(
            F.sum("length").alias(f"len_{tag}"), F.sort_array(F.collect_list("hash")).alias(f"hash_{tag}"))
    j = records(sides[0], "a").join(records(sides[1], "b"), ["file", "offset"], "full")
    status = (F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed"))
    return j.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(
        "file", "offset", status.alias("status"), F.col("len_a").alias("length"), F.col("len_b").alias("replica_length"))
