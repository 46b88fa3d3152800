"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.llm import lines, mixing, packing, quality, simhash
from vialens.llm.common import fresh_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forests fitted on labelled rows accept."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accept(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' boilerplate lines; n_chars is counted anew where a text has changed."""
    if "n_chars" not in docs.columns:
        return lines.drop_boilerplate(docs)
    out = lines.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 or more of their five-word shingles."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources with weights 1, 2, 3, repeating, takes them."""
    return mixing.apply_mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2,048 words."""
    return packing.pack(docs)


STAGES = [("quality rules", keep_good), ("line dedup", drop_lines), ("near-duplicates", drop_copies), ("mixing", mix_sources), ("packing", pack_bins)]
#: The fitted forests and the similarity links have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
