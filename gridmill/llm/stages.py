"""Stages of the corpus pipeline: each takes documents and gives documents or a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .near_copies import drop_near_copies
from .packing import pack_documents
from .pii import mask_pii
from .quality import clean_documents
from .queries import tokenizer_path
from .toxicity import drop_toxic


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their failing lines; see clean_documents() for null, repeated and odd rows."""
    return clean_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; see drop_toxic() for null, repeated and odd rows."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    The fingerprint operator's index proposes what lies within two bits, bands
    propose the rest, and whole sets decide; see drop_near_copies() for null,
    repeated and odd rows.
    """
    return drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; see mask_pii() for null, repeated and odd rows."""
    return mask_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048; see pack_documents() for null, repeated and odd rows."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
