"""A corpus made ready for training: quality, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the
last return the columns of ``docs`` for the rows that stay. Stages read labels and
benchmark items from ``sf_dir``. ``run`` writes each stage's rows to the shared folder
and rereads them for the next. Each begins with executors that have given back what
the stage before took and no longer uses.

Defined results: the operators' docstrings hold. Rows with a null doc_id all stay in the
near-duplicate stage, as no id tells them apart; of a component with ids, the row with
the least stays. Of repeated rows of an id one stays if their texts are equal.
An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import common, decontaminate, ngram_join, packing, quality, toxicity

#: Ids of dropped documents sent to every task at most; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for quality."""
    common.trim_executors(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = common.unused("score", docs.columns), common.unused("good", docs.columns)
    return quality.score_quality(docs, model, docs.columns, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic."""
    common.trim_executors(spark)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    common.trim_executors(spark)
    names = common.unused("score", docs.columns), common.unused("toxic", docs.columns)
    return toxicity.score_toxicity(docs, model, docs.columns, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the five-word shingle join at a similarity of 0.8."""
    common.trim_executors(spark)
    with common.temporary(spark):
        found = ngram_join.ngram_components(docs, ngram_join.JoinParams(words=5, percent=80))
        other = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
        gone = common.materialise(other.distinct(), "dropped", keep=True)
        twice = common.materialise(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "repeated", keep=True)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    if twice.isEmpty():
        return kept
    again = docs["doc_id"] == twice["again"]
    few = kept.join(twice, again, "left_semi")
    return kept.join(twice, again, "left_anti").unionByName(few.dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    common.trim_executors(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents in windows of 2048, in the proportions of their sources."""
    import public_tokenizers

    common.trim_executors(spark)
    return packing.pack(docs, packing.PackParams(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Scores, joins and tokens here have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
