"""From documents to packed windows: each stage reads the table that the one before it wrote."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import exact_dedup, language_id, mixing, packing, simhash
from driftline.llm.queries import tokenizer_path
from driftline.session import own_dir, scratch, tidy_executors

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """f, begun with executors that have given back what the stages before have left: they are the same ones for all stages."""

    @functools.wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy_executors(spark)
        return f(spark, docs, sf_dir)

    return begun


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts and narrow margins go."""
    return language_id.keep_identified(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the least id."""
    return exact_dedup.keep_first(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document of the least id."""
    return simhash.keep_one(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the windows that the documents fill."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: the classifier, the fingerprints and the tokenizer aren't SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, begin in STAGES:
        with scratch(spark):  # what a stage writes on its way
            out = begin(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
