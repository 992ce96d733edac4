"""A corpus pipeline of five operators, each stage on what the one before kept.

``run`` applies the stages to ``documents``; every stage is written as Parquet to
the shared folder and read again. ORACLE_SQL is None: a trained classifier, an
edit-distance search and a tokenizer cannot be stated in SQL, so the tests
compare the rows with plain versions of the stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.functions.session import remove_tables, tables_written, written_table
from counterpanel.llm import decontaminate, jaccard, mixing, token_output, toxicity
from counterpanel.llm.memory import BATCH_ROWS, BATCH_SETTING, hand_back
from counterpanel.llm.queries import fresh_path, read


_passing: dict[str, list[str]] = {}  # tables of the stage before, by application


def stage(apply: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that removes the intermediate tables of the one before it.

    A stage's result is written before the next stage is called, so the tables that
    went into it are not read again. Python workers get at most BATCH_ROWS rows at
    a time, unless the session asks for less. The driver hands back what the stage
    before held, such as the classifier's sample.
    """

    @wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        remove_tables(spark, _passing.pop(app, []))
        hand_back()
        if int(spark.conf.get(BATCH_SETTING)) > BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        before = set(tables_written(spark))
        out = apply(spark, docs, sf_dir)
        _passing[app] = [path for path in tables_written(spark) if path not in before]
        return out

    return run_stage


@stage
def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.ordinary_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return jaccard.representatives(docs)


@stage
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: one row per copy taken, cut where a target ends."""
    return mixing.mixed_documents(docs)


@stage
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what is read back from them."""
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, path, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_ordinary),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing_sources", mix_sources),
    ("token_output", write_token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = written_table(apply(spark, docs, sf_dir), f"stage-{name}")
    return docs
