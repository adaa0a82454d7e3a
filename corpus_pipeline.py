"""A training corpus from documents: toxic ones go, repeated lines are cut, near copies fold into one, leaked benchmark
questions go, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the columns of
``docs`` as they came (whatever they are; doc_id and text are needed), the last one the pieces of op8. Nulls, empty texts, repeated rows
and empty tables are handled as the operators' docstrings say; a null text that passes line dedup becomes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow.llm import decontamination, line_dedup, packing, simhash, toxicity
from tierflow.llm.queries import table
from tierflow.operators.scale import staged


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is one half or more; labels are learnt on documents outside the held-out fold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that occurred before (of any length), or nearly so (30 bytes or more); every document stays, n_chars follows the text."""
    out = line_dedup.line_dedup(docs, exact=1)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: the one with the smallest doc_id (of repeated rows, one)."""
    return simhash.one_of_each(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark question, also with other numbers, names or units."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_filter), ("line dedup", lines_once), ("simhash near-dedup", near_copies_once),
          ("benchmark decontamination", leaks_out), ("best-fit packing", packed)]
ORACLE_SQL = None  # SQL has no SimHash and no fitted model; tests/llm compares every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
