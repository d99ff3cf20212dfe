"""The corpus pipeline: documents without toxic ones, bad ones, near copies and personal data, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
into the shared checkpoint folder and hands the reread table to the next stage. The last table holds
the pieces' token ids, so that the training sequences can be built from the result alone.

Defined cases, for every stage and run(): a null or empty text is no toxic one, has the quality that
the classifier's bias gives, is never a near copy, holds no personal data and is packed as its end
id alone; very long texts are read whole; a text without any word stays beside its like, of rows that
repeat a text with words one stays (the smallest doc_id, then digest; null ids last); a null doc_id
is kept as it is; an empty table gives an empty result; without labels of both classes the classifiers
score the share of label 1 (toxicity 0, quality 0.5 if there are none); further columns of documents
go through all stages but the last unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectio.llm import ngram_join, packing, pii, quality, toxicity
from lectio.llm.common import held_out, read_table, stage, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: fitted on the labelled documents outside its held-out fold."""
    model = toxicity.fit_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out(*toxicity.FOLD))
    return toxicity.drop_toxic(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: fitted on the labelled documents outside its held-out fold."""
    model = quality.fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out(*quality.FOLD))
    return quality.keep_quality(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies one document stays."""
    return ngram_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: spans become the name of their kind."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces, their token ids and their places in training sequences."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("personal-data", redact_personal_data),
    ("packing", pack),
]

#: Trained stages can't be written in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return docs
