"""The corpus pipeline: stages applied to ``documents``, each reading what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last one returns token ids.
Nulls, empty texts, repeated rows and empty tables have the results that the operators' docstrings give; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyspark.llm.base import fresh, settle, table
from galleyspark.llm.importance import sampled
from galleyspark.llm.near_dups import near_duplicates
from galleyspark.llm.pfair import in_order, mix
from galleyspark.llm.tiling import find_items
from galleyspark.llm.token_planes import read_planes, write_planes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the importance sample leaves out."""
    return sampled(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of five-word shingle sets, the one of smallest doc_id; repeated rows of it count once.

    Documents with an empty set and rows with a null doc_id are kept. Where the doc_id that stays repeats with different texts, each text stays once.
    """
    found = near_duplicates(docs.select("doc_id", "text")).filter("doc_id is not null").groupBy("doc_id").agg(F.every("kept").alias("kept"), F.count("*").alias("n"))
    touched = settle(found.filter("not kept or n > 1"))
    once = docs.join(touched.select("doc_id"), "doc_id", "left_anti")
    repeated = docs.join(touched.filter("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half of the words of a benchmark item, in any order of passages."""
    hits = fresh(docs.columns, "hits")
    return find_items(docs, table(spark, sf_dir, "benchmark")).filter(F.size(hits) == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the order of the files being the mix of the sources."""
    position = fresh(docs.columns, "position")
    return in_order(mix(docs), docs.columns, position)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte planes of the token ids in the order of the mix, and for each document its place in them, read back from the files."""
    import public_tokenizers

    chunks, index = write_planes(docs, public_tokenizers.path("word_bpe_49k.json"), in_file_order=True)
    return read_planes(chunks, index)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("pack_tokens", pack_tokens),
]

#: Fitted models, minimum hashes, tiles and tokens have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
