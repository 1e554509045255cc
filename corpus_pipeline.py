"""From raw documents to packed training sequences.

Toxic documents go, repeated passages go, of near-copies one stays, sources are
mixed to their weights and the result is packed. Each stage reads what the one
before it wrote.

All stages take any number of rows, none included, and documents with nulls in
any column, with empty texts and texts of any length, repeated rows and further
columns of any name; all but the last return the columns they got. What each
does with these is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import cut
from rolloutlab.llm.line_dedup import dedup_lines
from rolloutlab.llm.mixing import mix_documents
from rolloutlab.llm.packing import pack_documents
from rolloutlab.llm.simhash_dedup import keep_one_of_alike
from rolloutlab.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts score low and stay; repeated rows share a fate. Labels
    without a doc_id or a value tell nothing; without labels of both kinds
    all documents score alike and stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more go; a document that loses all its lines goes too.

    The first copy by doc_id (null first), text and line stays. Null and empty
    texts stay as they are; repeated rows count once and share a fate; n_chars
    is renewed where lines went.
    """
    out = dedup_lines(docs, min_words=50)
    n_chars = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter((F.col("n_deleted") == 0) | (F.col("text") != "")).withColumn("n_chars", n_chars).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: SimHash of 192 bits over five-word shingles, linked at 24 or fewer differing bits.

    All such pairs are found: they agree in 8 of 32 blocks of six bits, so in
    two of one of seven groups, under which they meet. That is a similarity of
    0.8 or more, and most pairs at 0.9. Of a group the smallest doc_id stays, of repeated rows one.
    Texts without words, null ones too, form one group; texts of fewer than
    five words are one shingle. Of rows without doc_id one stays at most.
    """
    return keep_one_of_alike(docs, width=5, radius=24)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating, and share 150 % of all words; none is taken more than twice.

    Sources go by code point, null last. A document comes out once per pass
    that takes some of it, with the words taken and n_chars renewed; null and
    empty texts have no words and aren't taken.
    """
    return mix_documents(docs, weights=(3, 1, 2), total=1.5, most=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 1024 tokens.

    A null or empty text is its end token; only longer documents are cut;
    repeated rows are packed each on its own; other columns are left out.
    """
    return pack_documents(docs, sequence=1024, with_ids=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("packing", packing)]

#: Models and tokenizers decide what stays: SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
