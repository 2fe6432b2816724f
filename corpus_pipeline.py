"""From raw documents to packed training sequences: five stages, each an operator of ``callroute.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all the rows it is given
and returns the columns of ``documents`` (the last one: pieces in sequences).
Null texts count as empty, null ids are kept, rows are judged on their own
where copies are not the matter; further columns of ``documents`` are left
out, whatever their names. Without documents every stage returns no rows;
without labels the classifier knows nothing and keeps all.
``run`` writes each stage's rows to the shared folder and reads them for the
next, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callroute.llm import common, mixing, packing, quality, simhash, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it learns from the labelled ones of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs.where(quality.learnable("doc_id")), labels.where(quality.learnable("doc_id")))
    return quality.score(docs.select(*COLUMNS), weights).where("_score >= 0.5").drop("_score")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of the smallest id (null last) and text hash, and of equal rows one."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text"))
    out = common.cut(simhash.near_duplicates(docs, shingle=4, distance=4, keep=["doc_id", "row"]).select("doc_id", "row", "_root"), "classes")
    least = out.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("p"))
    picked = least.select(F.col("p.doc_id").alias("id"), F.col("p.row").alias("r"), F.lit(True).alias("picked"))
    counted = out.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    counted = counted.join(picked, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("row").eqNullSafe(F.col("r")), "left")
    first = F.col("picked").isNotNull()
    odd = common.cut(counted.where(~first | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), F.col("row").alias("r"), first.alias("first")), "copies")
    same = docs["doc_id"].eqNullSafe(odd["id"]) & docs["row"].eqNullSafe(odd["r"])
    alone = docs.join(odd, same, "left_anti").select(*COLUMNS)
    repeated = docs.join(odd.where("first"), same, "left_semi")
    # rows of one id and text differ in their other columns at most: the least of those is kept, whatever the order of rows
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = repeated.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    return alone.union(one.select("doc_id", "text", "rest.*").select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings that also start elsewhere."""
    out = suffix.drop_repeats(docs.select(*COLUMNS))
    # a cut inside a character leaves bytes that are no character; they become replacement signs
    text = F.when(F.size("_spans") > 0, F.make_valid_utf8(F.col("_kept").cast("string"))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents in the target mix of sources, languages and topics."""
    marked = docs.select(*COLUMNS, mixing.topic("text").alias("topic"), mixing.words("text").alias("n_tokens"))
    out = mixing.mix(marked, mixing.TARGETS, "n_tokens", mixing.BUDGET, rounds=mixing.ROUNDS, unlisted=True)
    return out.where("_kept").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has no tokenizer, no fingerprints and no trained model: the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
