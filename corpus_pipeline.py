"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; ``run`` writes what a stage returns as Parquet in the shared folder of
``spark.checkpoint.dir`` and reads it again for the next.  All stages but the
last return the columns they were given.  Null texts and texts without letters
end at the first stage; null ids, repeated rows, ties, very long texts, empty
tables and other columns are treated as the stages' operators say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm import languages, mixing, sentencepieces, simhash, templates
from rangeflow.llm.common import checkpoint_dir, remove_folder, table

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

#: Fingerprints and classes, tokens and language models have no SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold; documents of no known language go."""
    return languages.reject_unknown(docs, languages.train(docs.where(languages.fold(4) != 2)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first; a document may become empty but stays; ``n_chars`` follows the text.

    Leaves split until no line is left.
    """
    kept = templates.drop_templates(docs, to_the_end=True)
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, at a similarity of 0.8 over five words, the document with the smallest id stays."""
    return simhash.keep_dissimilar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares for all sources; a document comes as often as its draw says, and all are shuffled."""
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of the ids and of the text decoded from them."""
    return sentencepieces.encode(docs, TOKENIZER, kept=150_000)  # beside what the stages before leave in an executor


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepieces", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    What a stage wrote is removed once the next one has written; the rows that
    the last stage reads stay, for they are read when the result is.
    """
    folder, docs = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(at := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(at)
            if k:
                remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
