"""A corpus cleaning pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import bpe, decontaminate, ngram_join, substring_dedup, toxicity
from matchlake.llm.tables import text_key
from matchlake.operators.tables import settled

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score, learnt from the labelled documents of this input, is TOXIC or more."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    name = _free(docs, "score")
    kept = toxicity.score(docs, model, docs.columns, out=name).where(F.col(name) < TOXIC)
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of near copies, once; of those without doc_id one of each text, and all without words."""
    firsts = ngram_join.join(docs).where("component_id = doc_id").select("doc_id").distinct()
    name = _free(docs, "text_key")
    kept = docs.join(firsts, "doc_id", "left_semi").withColumn(name, text_key(F.col("text"))).dropDuplicates(["doc_id", name])
    nameless = docs.where("doc_id is null").withColumn(name, F.when(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), text_key(F.col("text"))))
    texts = nameless.where(F.col(name).isNotNull()).dropDuplicates([name]).unionByName(nameless.where(F.col(name).isNull()))
    return kept.select(*docs.columns).unionByName(texts.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words and more that repeat out of the texts; all documents stay."""
    return _measured(substring_dedup.remove_repeats(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's token ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return name


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where documents have the column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: The stages fit models and follow links, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder, and what the stage wrote on the way is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
