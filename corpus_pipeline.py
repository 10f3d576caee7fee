"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept, and learns from nothing else of it,
so the table itself may go once the first stage is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, ngram_join, toxicity
from tessera.llm.queries import language_model, toxicity_model, vocabulary_path
from tessera.llm.session import checkpoint, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")  # of documents; all stages but the last return them
LEAST_SCORE = 0.5  # of the language stage
FEW_IDS = 1_000_000  # ids that are broadcast, at most; their number is counted first
FEW_PIECES = 1 << 17  # of the encoding stage, whose workers hold what the other stages keep as well

ORACLE_SQL = None  # fitted models and tokenisers are not expressible in SQL; tests hold the stages against brute force


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model learns from the labelled ones."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("__text_", F.col("text")), model, "__text_", COLUMNS).where("predicted = 0").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go. The model learns from those that came this far."""
    kept = langid.predict(docs.withColumn("__text_", F.col("text")), language_model(docs), "__text_", COLUMNS)
    return kept.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and 80 per cent the one with the smallest id stays. Of rows alike
    in id and text one stays, with the least other columns; rows that share an id but not the text stay, as do rows
    without an id."""
    groups = checkpoint(ngram_join.jaccard_components(docs, size=5, percent=80))
    kept = docs.join(_few(groups.where("component_id <> doc_id").select("doc_id").distinct()), "doc_id", "left_anti").select(*COLUMNS)
    repeated = checkpoint(groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return kept
    few = _few(repeated)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = kept.join(few, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("o"))
    return kept.join(few, "doc_id", "left_anti").unionByName(once.select("doc_id", "text", "o.*")).select(*COLUMNS)


def _few(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast if they are counted to be few; else the join shuffles."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage alike to a benchmark item go, each row by its own text, whatever its id."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the offsets that decoding needs."""
    encoded = bpe.encode(docs, vocabulary_path(), keep=("doc_id", "lang", "source"), cache=FEW_PIECES)
    return encoded.withColumn("n_tokens", F.expr("cast(length(ids) div 4 as bigint)"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each cut from its predecessor by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
