"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import bpe, centroids, cover_tree, decontaminate, html_wrapper, mixing, ngram_join, periodic_runs, quality, substring_dedup, token_counts, toxicity, url_filter
from matchlake.llm.sql import SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op1: verdict, and host and path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url by the rules, else by its host's propagated trust and distrust."""
    return url_filter.judge(_read(spark, sf_dir, "pages"), RULES)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def _fold(n: int):
    """crc32 of doc_id as text, modulo n; -1 without a doc_id, which is never held out (nor learnt from: it has no label)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of the benchmark, and the items that these are from."""
    found = decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), listed=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; the rows with a fold of 0 are not learnt from."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by the 50k byte-level ranks."""
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_wrapper.main_text(_read(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every document; over_limit: more than 1024."""
    counts = token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from every document the words inside 35-word windows that occur anywhere else."""
    return substring_dedup.digests(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document's quality; the rows with a fold of 2 are not learnt from."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), _fold(4) != 2)
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors with a cosine of 0.95 or more."""
    return cover_tree.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mixing.amounts(_read(spark, sf_dir, "documents"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which the texts whose checksum h of doc_id ends in 0 repeat a stretch of words from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    some = some.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which are made periodic first."""
    return periodic_runs.digests(_made_periodic(_read(spark, sf_dir, "documents")))


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters all vectors around 40 centroids."""
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_link_graph, op2_ngram_jaccard, op3_decontamination, op4_toxicity, op5_byte_bpe, op6_html_wrapper, op7_token_counts, op8_substring_dedup, op9_quality, op10_cover_tree, op11_mixing, op12_periodic_runs, op13_hamerly)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
