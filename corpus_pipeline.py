"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, others that the corpus has among them, whatever their names. The classifiers learn from a bounded sample of the labels of ``sf_dir`` that belong to the stage's documents.

Defined results, of every stage: an empty corpus gives no rows; texts are read whole; repeated rows are documents of their own up to the stage of near duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isobar.llm import bpe, jaccard, mixing, quality, toxicity
from isobar.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. Null and empty texts have the model's base score; without labels of both classes all stay, unless all labels are toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more. Null and empty texts are scored by their statistics, all 0; without labels of both classes the share of good ones is every score."""
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a Jaccard similarity of 0.8 or more over 5-word shingles; null ids come last, then the smallest text hash counts. Documents without words stay; of equal rows one stays."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken, whole; sources weigh 1, 2, 3, repeating, up to three epochs. A null source is one of its own; documents without words are never taken."""
    return mixing.mix_documents(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_sha256 and decoded_sha256 of each row; other columns (text, lang, n_chars) end here. A null text is an empty one."""
    return bpe.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: The classifiers are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
