"""A training-data pipeline over documents: each stage applies one operator of amalgam.llm."""

from pyspark.sql import DataFrame, SparkSession

from amalgam.llm import decontam, mixing, quality, simhash, tokenout
from amalgam.llm.common import sheltered, stored
from amalgam.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the classifiers keep."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return sheltered(docs, ("doc_id", "text"), lambda d: quality.judge(d, model).where("kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: near by SimHash, or similar in their five-word shingles."""
    return simhash.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards square roots of the sources' shares, in a global shuffle."""
    return sheltered(docs, ("doc_id", "text", "source"), lambda d: mixing.mix(d, temperature=0.5, seed=7))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents: written as Simple-8b files in the order that mixing shuffled them into, read back, one row for each document."""
    # workers that the other stages have used hold less: fewer words remembered cost time, not results
    return tokenout.tokenize(docs, tokenizer_path(), end_id=1, by_id=False, cache_words=150_000)


STAGES = [("quality", keep_quality), ("simhash", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("tokens", encode)]

#: The classifier, fingerprints and tokenizer of the stages are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
