"""The corpus pipeline: documents through quality, line dedup, near-dedup, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows of ``docs``; all but the
last return the columns of ``docs``.  Labels for the quality stage are read from ``sf_dir``.
Rows with nulls pass as in the operators: see their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.llm import jaccard, linededup, mixing, packing, quality
from seqspan.llm.common import columns_of, stored, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (predicted 0) go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks of lines are cut from later documents; rows stay, n_chars follows."""
    found, cut = linededup.cut_lines(docs)
    new = {"text": linededup.shortened("text", cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
    return found.select(*[new[name].alias(name) if name in new else c for c, name in zip(columns_of(docs), docs.columns, strict=True)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, Jaccard similarity
    of 0.8 or more.  SimHash finds the candidates, the whole shingle sets decide."""
    return jaccard.keep_one(docs, width=5, least=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source ask for."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of permitted sizes."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: learned models, 64-bit hashes and bin packing are beyond SQL; tests use plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written to the shared folder once and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
