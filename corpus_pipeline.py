"""Corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import decontam_join, markov_secrets, minhash_odd, mix_budget, toxicity_grammar
from loupe.llm.common import read, scratch

NEAR_PERCENT = 80  # similarity at which the pipeline takes documents for copies
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, text=None) -> DataFrame:
    """Documents with the hash of their text, as the operators return it."""
    return docs.select(*COLUMNS, F.xxhash64("text" if text is None else text).alias("_hash")).alias("d")


def _same(side: str):
    return F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col("d._hash") == F.col(f"{side}.text_hash"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; rows with one id and several texts are
    judged apart, null and empty texts stay."""
    model = toxicity_grammar.learn(docs, read(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(toxicity_grammar.toxicity(model, F.col("text")) < toxicity_grammar.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays;
    rows that repeat id and text keep one row, rows with one id and several
    texts are judged apart, rows without an id all stay."""
    kept = minhash_odd.near_duplicates(docs, percent=NEAR_PERCENT).where("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    known = _keyed(docs.where("doc_id is not null")).join(kept.alias("x"), _same("x"), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return known.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; rows with one id and
    several texts are judged apart, null and empty texts and null ids stay."""
    bad = decontam_join.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash").distinct()
    return _keyed(docs).join(bad.alias("x"), _same("x"), "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, repeated ones too, and
    null texts stay null."""
    found = markov_secrets.find_secrets(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    d = _keyed(docs, F.coalesce("text", F.lit(""))).join(found.alias("x"), _same("x"), "left")
    text = F.when(F.col("x.spans").isNull(), F.col("d.text")).otherwise(markov_secrets.redact(F.col("d.text"), F.col("x.spans")))
    d = d.select("d.doc_id", text.alias("text"), "d.lang", "d.source", F.col("d.n_chars").alias("was"), F.col("x.spans").isNull().alias("same"))
    n = F.when(F.col("same"), F.col("was")).otherwise(F.length("text").cast("long"))
    return d.withColumn("n_chars", n).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents that the mix takes, as often as it takes
    them (``copy`` numbers them), the others are gone.  Null and empty texts
    have no words and are never taken; an empty table gives an empty result."""
    return mix_budget.repeat_documents(docs.select(*COLUMNS), mix_budget.mix_to_weights(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", secrets), ("mix", mix)]
ORACLE_SQL = None  # learned scores and a seeded choice of documents: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
