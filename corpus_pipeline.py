"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A table may have further columns, whatever their names:
they are passed on. An empty table gives an empty one. A null source or language is kept as it is. Very long texts are
whole documents like others in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import line_dedup, mixing, ngram_join, packing, quality
from marlstone.llm.common import documents, folder

#: Near-duplicate groups of this stage: five words to a shingle, Jaccard similarity of at least 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go.

    Null, empty and white texts have no words and go. Rows are judged one by one, so a null id doesn't matter, repeated
    rows stay or go together, and there are no ties.
    """
    return quality.keep_good(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; documents of which nothing is left go. n_chars follows the text.

    Null, empty and white texts have no lines and stay as they are (a null text keeps a null n_chars). Copies stand in the
    order of the ids, a null id last; ties go by a hash of the text. Rows alike in id and text count as one document, so
    they stay or are cut together.
    """
    cut = line_dedup.drop_copied(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, null being larger than all others.

    Null, empty and white texts have no shingles and all stay. Rows with equal ids and different texts stand in the order
    of a hash of the text; of rows alike in id and text one stays.
    """
    return ngram_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null, empty and white texts have size 0 and are taken at random like others of their source, at no cost in words; a
    source of such texts alone has target 0 and goes. A null source is a source. Equal sizes stand in the order of a
    digest of the id; repeated rows are rows of their own.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length, one row each, with their ids.

    A null or empty text is the end id alone, a sequence of length 1. A null id stays null; repeated rows and equal ids
    each give their own sequences. Only the id and the text are read.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_runs), ("ngram_join", near_copies), ("mix_sources", mixed), ("pack", packed)]

#: The components of the near-copy stage and the ids of the last one are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    root = folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
