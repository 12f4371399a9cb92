"""The training-data pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage works on all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of documents.

Defined results, for all stages: each row is judged as a row. Rows of one
doc_id are one document where documents are counted or compared by id, a null
doc_id counts as the largest, a null text stays null and is as an empty one.
A text of any length is one value of one task. Other columns pass through,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleiswerk.llm.bpe import public_vocabulary
from gleiswerk.llm.common import materialize, table
from gleiswerk.llm.jaccard_join import one_of_each
from gleiswerk.llm.line_dedup import dedup_lines
from gleiswerk.llm.packing import pack_documents
from gleiswerk.llm.quality import good_documents
from gleiswerk.llm.suffix_dedup import cut_repeats


def sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go.

    A null or empty text has too few words and goes. Of rows with one doc_id
    all stay if any may. Of labels that disagree on a document the worse counts;
    without labels of both kinds only the base rules decide.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one: that of the largest doc_id.

    Lines are one if equal but for white space at their ends and A-Z. A text
    that loses all lines is empty, and stays a row. Rows of a null doc_id, and
    short lines, lose nothing.
    """
    return sized(dedup_lines(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id.

    Repeated rows of that id and text stay all, as they are one document.
    Documents without words are near none and stay. Of a group of null doc_ids
    alone one row stays.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more stay in the document of the smallest id.

    Rows of one doc_id lose nothing to each other. What is left of a character
    that a cut goes through is left out.
    """
    return sized(cut_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens, as ``pack_documents`` returns them.

    A null or empty text is the one end token. Repeated and null doc_ids are
    packed row by row.
    """
    return pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Isolation forests, repeats in suffix arrays and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
