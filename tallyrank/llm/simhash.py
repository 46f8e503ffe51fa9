"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprint: A-Z to a-z, words are runs of characters that are no ASCII white
space, shingles are ``shingle`` consecutive words joined by a space, repeats
included (fewer words: the whole sequence; none, or a null text: fingerprint
zero). A bit is 1 if more than half of the shingles' XXH64 values have it.

Links join fingerprints that differ in at most ``max_bits`` bits. Documents
are first collapsed to distinct fingerprints, so copies cost one row each and
never meet. The 64 bits are cut into ``max_bits + 2`` blocks; two fingerprints
within the distance agree in at least two blocks, so every pair of blocks is a
key (six keys of 32 bits at distance 2), and fingerprints that share a key are
candidates, verified by Hamming distance.

A key shared by more than ``crowd`` fingerprints is not joined with itself.
There, links are found exactly without pairs. For an even distance every
fingerprint stands under all values within half of it (in the bits outside
the key): two fingerprints stand under a common value just when they are
within the distance, so linking all of a value to the least of them joins the
same components with one edge each. For an odd distance the values within the
whole distance are looked up among the fingerprints, which gives the links
themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, map_batches

#: Shingles are counted in slices of so many, which bounds memory for any text.
SLICE = 65536


def simhash(text: str | None, shingle: int = 3) -> int:
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(g, 42) for g in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        h = np.array(hashes[i:i + SLICE], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, kept, fp)`` per row; ``fp`` is the fingerprint as a signed long
    and ``kept`` a struct of the columns ``keep`` (left out if there are none)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([simhash(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])
    kept = [F.struct(*keep).alias("kept")] if keep else []
    t = docs.select(F.col(doc_id).alias("doc_id"), *kept, F.col(text).alias("text"))
    return map_batches(t, run, ", ".join(f"{c} {k}" for c, k in t.dtypes[:-1]) + ", fp bigint")


def _blocks(n: int) -> list[int]:
    """Masks of ``n`` blocks of nearly equal width that cover 64 bits."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of "within ``max_bits``" over
    the distinct longs of ``fps (fp)``."""
    blocks = _blocks(max_bits + 2)
    masks = [a | b for a, b in combinations(blocks, 2)]
    keyed = cut(fps.select("fp", F.posexplode(F.array(*(
        F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("mask", "key")))
    size = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(size, ["mask", "key"])
    few, many = shared.filter(F.col("n") <= crowd).drop("n"), shared.filter(F.col("n") > crowd).drop("n")

    other = few.select("mask", "key", F.col("fp").alias("v"))
    pairs = (few.withColumnRenamed("fp", "u").join(other, ["mask", "key"]).filter(F.col("u") > F.col("v"))
             .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v"))

    def near(bits: int) -> DataFrame:
        return many.select("mask", "key", "fp", F.explode(_within(F.col("fp"), F.col("mask"), masks, bits)).alias("v"))

    if max_bits % 2:
        met = near(max_bits).join(many.select("mask", "key", F.col("fp").alias("v")), ["mask", "key", "v"])
    else:
        stars = near(max_bits // 2).withColumnRenamed("v", "at")
        least = stars.groupBy("mask", "key", "at").agg(F.min("fp").alias("v"))
        met = stars.join(least, ["mask", "key", "at"])
    met = met.filter(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionByName(met)


def _within(fp: Column, mask: Column, masks: list[int], bits: int) -> Column:
    """All values within ``bits`` bits of ``fp`` that agree with it under its mask."""
    def flips(m: int) -> list[int]:
        free = [i for i in range(64) if not m >> i & 1]
        return [_signed(sum(1 << i for i in c)) for k in range(bits + 1) for c in combinations(free, k)]
    by_mask = F.array(*(F.array(*(F.lit(x).cast("long") for x in flips(m))) for m in masks))
    return F.transform(F.get(by_mask, mask), lambda x: fp.bitwiseXOR(x))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2, crowd: int = 64) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` per row of ``docs``.

    ``component_id`` is the least id reachable over links, the own included
    (null only if all ids there are null); ``root`` is the component's least
    fingerprint. Rows that repeat stay rows; null and empty texts link like
    any other with fingerprint zero; other columns are ignored.
    """
    fp = cut(fingerprints(docs, doc_id, text, shingle))
    distinct = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(distinct.select("fp"), max_bits, crowd))
    rooted = cut(distinct.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left")
                 .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return fp.join(of_fp, "fp").select(F.col("doc_id").alias(doc_id), "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
