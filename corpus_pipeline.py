"""Prepares a corpus for training: five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read
again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import common, decontaminate, near_dup, pii, queries, toxicity
from reviewmill.session import ensure_scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    score = common.free_name(docs, "score")
    return toxicity.add_score(docs, model, score_col=score).where(F.col(score) < queries.TOXIC).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id, a null id being the largest.

    Rows are numbered and stored with their number, so one id on several texts is several documents
    and rows that are equal are told apart. Rows with null or blank text are in no group and stay.
    """
    row, key = common.free_name(docs, "row"), common.free_name(docs, "key")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = rows.withColumn(key, F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", F.col(row).alias("row")))
    kept = near_dup.near_duplicates(keyed, id_col=key).where("kept").select(F.col(key)["row"].alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    names = "".join(docs.columns) + "_"  # a prefix that no column has
    found = decontaminate.find_passages(docs, queries.table(spark, sf_dir, "benchmark"), prefix=names)
    return found.where(~decontaminate.contaminated(names)).select(docs.columns)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text.

    The secret is the session's (``queries.KEY_SETTING``); the test tables do with the sample key.
    """
    masked = pii.mask_text(docs, queries.pseudonym_key(spark), count_col=common.free_name(docs, "n_values")).select(docs.columns)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of them and of the decoded text."""
    return queries.coded(docs.select("doc_id", "text")).select("doc_id", "ids", *queries.bpe_digests())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", with_pseudonyms),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return common.stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


#: A trained classifier decides in the first stage, so SQL has no twin.
ORACLE_SQL = None
