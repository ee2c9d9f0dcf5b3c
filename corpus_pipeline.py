"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns a DataFrame; ``run`` writes each result as Parquet and reads it
again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import exact_dedup, language_id, mixing, packing, simhash
from labelforge.llm.common import ensure_checkpoint_dir, table
from labelforge.llm.queries import MAY_LEARN, OTHER_WEIGHT, WEIGHTS, tokenizer

#: A stage needs learnt or counted parts SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: those without a letter, and those that the best language's automaton parses far worse than letters without any rule.

    Automata are fitted on labelled rows of ``documents``; where no language could be learnt, documents with a letter stay. A null or empty
    text goes; a very long one is parsed whole; ties between languages reject nothing; of repeated rows all or none stay; an empty table stays empty;
    other columns, of any name, are kept.
    """
    training = language_id.sample_training(table(spark, sf_dir, "documents"), MAY_LEARN)
    return language_id.keep_known(docs, training)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays.

    A null text equals an empty one; a null id is below all others; of repeated rows one stays, that whose other
    columns are largest; texts of any length are compared whole; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies (five-word shingles, similarity 0.8 or more), the one with the smallest id stays.

    A null or empty text is near to none; a text of under five words is one shingle; rows with a null id stay; rows that
    repeat an id stay or go together; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that sources interleave at their target weights.

    A null source is one of the others; null and repeated ids have a place each; columns that bear the names of mixing's own stay as they are.
    """
    found = mixing.mix(docs, WEIGHTS, OTHER_WEIGHT)
    return found.orderBy(found.columns[-1]).select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; of each length, documents go out in the order in which mixing wrote them.

    A null or empty text is one piece with the closing id alone; null and repeated ids are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), in_file_order="parquet" in {f.rsplit(".", 1)[-1] for f in docs.inputFiles()[:1]})


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages wrote before it is removed when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
