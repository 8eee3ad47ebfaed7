"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.langid import identify_languages, learn_dictionaries
from larder.llm.mixing import mix_documents
from larder.llm.neardup import near_duplicates, text_key
from larder.llm.packing import pack_documents
from larder.llm.pii import redact
from larder.llm.shared import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; undetermined ones go, so null texts and texts without a letter do.

    Repeated rows stay or go together; null doc_id and null lang don't matter, but rows without lang teach nothing: where
    no row has one, nothing can be told and all go. No rows give no rows.
    """
    return identify_languages(docs, learn_dictionaries(docs), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id.

    Null, empty and wordless texts and rows without a doc_id stay. Repeated rows of a document that stays all stay;
    of a doc_id with several texts only those go that are copies of another document. No rows give no rows.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = (docs["doc_id"] == gone["gone_id"]) & (text_key(docs["text"]) == gone["gone_key"])
    return docs.join(gone.hint("merge"), same, "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars counts the new text. Null and empty texts stay as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: repeated documents are repeated rows, the one at a source's cut keeps its first words.

    All other columns keep their values. Null source is a source of its own. Documents without words are in no mix. No rows give no rows.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; every row is packed, repeated ones as often as they come."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the compression of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage's result is a table of the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
