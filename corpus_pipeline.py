"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing and sharding, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.decontam import mark_benchmark
from tessitura.llm.jaccard import near_duplicates
from tessitura.llm.mixing import mix
from tessitura.llm.queries import MIX_SEED, REST, WEIGHTS
from tessitura.llm.sharding import assign_shards
from tessitura.llm.shared import discard, stored, table, written
from tessitura.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have no telling word and stay; repeated rows fare alike; an empty table gives none."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five-word Jaccard similarity 0.8 or more the one of the smallest doc_id stays; of its repeated rows, each.

    Null and empty texts are linked with nothing and stay. A null doc_id counts as the smallest: rows without one stay, and stand for their groups.
    """
    classes = near_duplicates(docs, width=5, num=4, den=5)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go; null and empty texts hold none and stay, repeated rows fare alike."""
    return mark_benchmark(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights, and the copies shuffled. Null sources are of the rest; null and empty texts have no size."""
    return mix(docs, WEIGHTS, rest=REST, seed=MIX_SEED).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy with its shard, by doc_id alone; rows without one share a shard."""
    return assign_shards(docs, "doc_id", (1.0,) * SHARDS).select(*COLUMNS, "shard")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: SQL cannot express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next; what it no longer needs is deleted then."""
    docs, start = table(spark, sf_dir, "documents"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            discard(spark, start, keep=1)
    return docs
