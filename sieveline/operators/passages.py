"""Documents that contain a passage: the gold of known-passage retrieval, found without a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import written
from .bm25 import Index, few, query_terms


def _phrase(text: str, tokenizer: str) -> Column:
    """The tokens with a space around each; tokens have no spaces."""
    return F.concat(F.lit(" "), F.array_join(tokens(text, tokenizer), " "), F.lit(" "))


def containing(index: Index, corpus: DataFrame, passages: DataFrame, tokenizer: str = "regex") -> DataFrame:
    """qid, ordinal of the documents that have all tokens of a passage in a row; (qid, text) of passages, (ordinal, text) of corpus.

    Only documents with the passage's rarest token are looked at: a document without it
    cannot contain the passage. A passage without tokens, or with one that no document
    has, is contained in none.
    """
    terms = query_terms(passages, tokenizer).join(index.idf.select("term", "df"), "term", "left").na.fill(0, ["df"])
    rarest = terms.groupBy("qid").agg(F.min(F.struct("df", "term")).alias("r")).where("r.df > 0").select("qid", "r.term")
    open_ = few(written(rarest)).join(index.tf.select("ordinal", "term"), "term").join(passages.select("qid", _phrase("text", tokenizer).alias("phrase")), "qid").select("ordinal", "qid", "phrase")
    # a document's text goes to its own number once, however many passages are looked for in it
    texts = corpus.select("ordinal", _phrase("text", tokenizer).alias("document"))
    return open_.join(texts, "ordinal").where(F.contains("document", "phrase")).select("qid", "ordinal").distinct()
