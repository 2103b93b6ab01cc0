"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import drop, keep
from tidemill.llm.jaccard_join import distinct_documents
from tidemill.llm.mixing import mixed_documents, source_family
from tidemill.llm.packing import pack_documents
from tidemill.llm.quality_rules import passing_documents
from tidemill.llm.secrets import redact_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    Rows are judged one by one: null or repeated ids change nothing. Null, empty and wordless texts fail. A null source is a host of its own.
    Very long texts are measured whole. An empty table gives no rows. Other columns are carried.
    """
    return passing_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words: that of the smallest id, null ids last.

    Equal rows, and copies with null or equal ids, are one group. Null, empty and wordless texts are no copies of anything and stay.
    Very long texts are compared whole. An empty table gives no rows. Other columns are carried.
    """
    return distinct_documents(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts and ``n_chars`` counted anew.

    Null texts stay null, empty ones empty. Null ids and repeated rows stay. Very long texts are scanned whole. An empty table gives no rows. Other columns are carried.
    """
    return redact_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller leaves of the source tree drawn more often: at the least budget that leaves no document out.

    Null source or lang: a leaf named ''. Null and empty texts have no tokens and are drawn with their leaf. Null ids and repeated rows: drawn
    like others. An empty table gives no rows. Other columns are carried.
    """
    return mixed_documents(docs, source_family(), temperature=0.9, max_epochs=4.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all drawn documents, with their token ids and places in sequences of 2048 tokens.

    Null and empty texts are the end id alone. Null ids and repeated rows: each row is packed by itself. Very long texts are cut into pieces, none is
    shortened. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` end here.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Tokens, hashes and best fit cannot be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
