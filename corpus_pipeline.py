"""A corpus from raw documents to training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents: n_chars follows the text where a stage changes it. Extra
columns of the documents pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.llm import decontaminate, line_dedup, packing, simhash, toxicity
from specflow.llm.common import crc_rest, frozen
from specflow.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = table(spark, sf_dir, "labels").filter(crc_rest(F.col("doc_id"), 4) != 2)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, out="_toxic_score")
    score = F.col(scored.columns[-1])
    return scored.filter(score < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    kept = line_dedup.drop_shared_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, width=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or only in passing."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_words, n_hit = found.columns[-4:-2]
    return found.filter(~decontaminate.is_contaminated(n_words, n_hit)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can state neither the classifier nor the subword ids
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
