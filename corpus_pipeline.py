"""A corpus pipeline of five stages over documents; see STAGES.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents. No SQL can express the first stage's model, so there is no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from quarrylake.llm.common import stored


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model of labels does not find toxic, by op4's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.keep(docs, model, toxicity.THRESHOLD)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of maximal repeated line runs; a document of which no word is left goes."""
    out = line_dedup.remove_repeated_lines(docs, counts=("_pipeline_lines", "_pipeline_removed"))
    nothing = (F.col("_pipeline_removed") > 0) & (mixing.word_count(F.col("text")) == 0)
    return out.where(~nothing).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    classes = jaccard_join.near_duplicate_classes(docs)
    return docs.join(classes.where("doc_id = component_id").select("doc_id").distinct(), "doc_id").select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold too little of benchmark to count as contaminated."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, items)
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
