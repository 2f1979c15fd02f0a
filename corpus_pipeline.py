"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
between stages the rows are written as Parquet and read again. All but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import language_id, mixing, near_dedup, packing, substring_dedup
from sieveline.llm.common import cut, prepare, table
from sieveline.sources.tables import mark, only_last


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language, all columns as they are.

    Rows go whose text is null, empty or without a letter, or long enough to tell and in
    no learned language; very short texts with letters stay. Repeated rows go or stay
    alike. An empty table gives no rows. Columns of any name are carried along.
    """
    prepare(spark)
    return language_id.told_rows(docs, language_id.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, all columns as they are.

    Rows without doc_id stay, and so do texts without words, which are near nothing. Rows
    that share a doc_id go or stay together. An empty table gives no rows.
    """
    found = near_dedup.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns; texts without the words of passages that documents with smaller ids have, n_chars to match.

    Null texts and rows without doc_id stay as they are. Repeated rows lose the same
    words. An empty table gives no rows.
    """
    return substring_dedup.drop_duplicate_spans(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, all columns as they are.

    A null source is a source, the last. Null texts and texts without words have size 0
    and come along with their source's whole repetitions. The row that ends a source's
    share has the first words of its text, and n_chars to match. Repeated rows are taken
    alike. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its piece is the closing id. Each repeated row is packed
    for itself. Other columns, of any name, are left out. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: The last stage tokenises, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            # what a stage wrote on its way, and its input, are no longer needed
            docs = cut(docs)
            only_last(since)
    return docs
