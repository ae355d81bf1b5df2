"""A training corpus from `documents`: five stages, each on all that the one before kept.

1. toxicity: documents whose score is 0.5 or more go; the model learns from `labels`.
2. line dedup: lines that occurred earlier go; documents that lose all their lines go with them.
3. near-dedup: one document of each group stays (five-word shingles, Jaccard similarity of 0.8 or more).
4. decontamination: documents that hold ten consecutive words of a `benchmark` item go.
5. packing: what is left is tokenized and packed into sequences of at most 1024 tokens; the rows hold their ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exchange, line_dedup, minhash_dedup, packing, queries, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = toxicity.training_rows()
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(learn), labels.where(learn))
    return toxicity.annotate(docs, model, spans=False).where("toxic_score < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_emptied(line_dedup.dedup_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs, width=5, similarity=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"), width=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs, queries.tokenizer(), window=1024)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores of a trained model decide in the first stage, so SQL can't express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; what a stage returns is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{exchange.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
