"""A training-data pipeline over ``documents``: every stage calls one operator
of ``tallyrank.llm``, works on all its predecessor kept and is written as
Parquet before the next one reads it.

1. ``language_id``: documents whose language is rejected go.
2. ``near_duplicates``: one document of each SimHash component stays, the one
   with the least id (of rows alike in id and fingerprint any one).
3. ``decontaminate``: documents with a word inside a benchmark window go.
4. ``secrets``: secrets are replaced by a marker.
5. ``mix``: the curriculum; a row per reading of a document, in training order.

Stages 1 to 4 return the columns of ``documents``, ``n_chars`` kept right
where a text changes. Rows with a null text have no language and go in stage 1.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import langid
from tallyrank.llm.decontaminate import scan_documents
from tallyrank.llm.mixing import curriculum, in_order
from tallyrank.llm.queries import language_model
from tallyrank.llm.secret_scan import redact
from tallyrank.llm.simhash import fingerprints, near_duplicates
from tallyrank.llm.tables import cut, read, shared_root

#: SQL cannot train a classifier: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` (if there) as long as the text is now."""
    kind = dict(like.dtypes).get("n_chars")
    if kind:
        docs = docs.withColumn("n_chars", F.length("text").cast(kind))
    return docs.select(*like.columns)


def _whole(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the whole row as one column, whose fields clash with no operator's."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    said = langid.identify(_whole(docs), language_model(docs), keep=("row",))
    return said.filter(~F.col("rejected")).select("row.*")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(near_duplicates(docs.select("doc_id", "text"), shingle=3, max_bits=2).select("doc_id", "fp", "root"))
    # Of each component the least id stays (null last), of its texts the one with the least fingerprint.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("least")
    stays = cut(found.groupBy("root").agg(least).select(F.col("least.doc_id").alias("id"), F.col("least.fp").alias("fp")))
    # An id with one fingerprint says which row is meant; the texts of other ids, and of none, are looked at again.
    texts = cut(found.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                .filter("lo <> hi OR doc_id IS NULL").select(F.col("doc_id").alias("several")))
    unclear = F.col("id").eqNullSafe(F.col("several"))
    clear = stays.join(texts, unclear, "left_anti").select(F.col("id").alias("doc_id"))
    one = docs.join(clear, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    again = docs.join(texts, F.col("doc_id").eqNullSafe(F.col("several")), "left_semi")
    again = fingerprints(_whole(again), keep=("row",)).select("doc_id", F.col("kept.row").alias("row"), F.col("fp").alias("its"))
    meant = stays.join(texts, unclear, "left_semi")
    again = again.join(meant, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("its") == F.col("fp")), "left_semi")
    return one.unionByName(again.dropDuplicates(["doc_id", "its"]).select("row.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan_documents(_whole(docs), read(spark, sf_dir, "benchmark", ("item_id", "text")), keep=("row",))
    return found.filter("n_hit = 0").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(redact(docs), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_order(docs, curriculum(docs))


STAGES = [("language_id", language_stage), ("near_duplicates", duplicate_stage), ("decontaminate", benchmark_stage),
          ("secrets", secret_stage), ("mix", mix_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
