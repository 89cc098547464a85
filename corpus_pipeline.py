"""A corpus pipeline of five of the text operators: STAGES, run(spark, sf_dir), and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import decontaminate, minhash, packing, suffix_dedup, toxicity
from sparkweave.llm.common import Workspace, read_table, unused_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of sf_dir, rejects go.

    Null and empty texts have the score of no words, and stay unless the model rejects that. Rows are judged one by one,
    repeated ones alike; null ids and extra columns, whatever their names, pass through; an empty table stays empty.
    """
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five words a shingle and a similarity of 0.8, one row stays.

    It is the row with the smallest id; a null id is larger than any other, and of rows with one id one is taken. So
    repeated rows, and copies with a null id, are near-duplicates as any other. Null and empty texts, and those without
    words, are like nothing and stay. Extra columns, whatever their names, stay as they are; an empty table stays empty.

    Rows are told apart by numbers, which are written with them, so that a task that runs again sees the same ones.
    """
    row = unused_name(docs.columns, "row")
    own = Workspace(spark).save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(own, minhash.Similarity(shingle=5, percent=80), id_col=row).select(F.col("doc_id").alias(row), "component_id")
    ids = own.select(row, F.col("doc_id").cast("long").alias("__id"))
    first = found.join(ids, row).groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", row))[row].alias(row))
    gone = found.join(first, row, "left_anti").select(row)
    return own.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text under every 200-byte string that also starts elsewhere goes; every document stays.

    Null texts stay null, and empty ones empty; repeated rows hold each other's strings, and end with an empty text if
    they are long enough. Null ids and extra columns, whatever their names, pass through, but for n_chars, which is
    counted anew; an empty table stays empty.
    """
    return suffix_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay. Rows are judged one by one, repeated ones alike; null ids and extra columns,
    whatever their names, pass through; an empty table stays empty, and an empty benchmark takes nothing.
    """
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 words: a row for each piece of a document, with its bin and place.

    Null and empty texts give a row without a bin; null ids and sources conflict with nothing; repeated rows are packed
    each, never into one bin; other columns are ignored; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the models nor suffix arrays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each is written to the shared folder and read again."""
    work = Workspace(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
