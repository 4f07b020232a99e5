"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame that is written as Parquet and read again; all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from obspark.llm import common, convnet, jaccard, packing, suffixes

#: Below this probability no language is told. Held-out rows of one language reach 0.9; texts of two languages, half and half, or of none
#: that was learnt lie below it more often than not (see README).
LANGUAGE_LEAST = 0.6
QUALITY_LEAST = 0.5
#: Near duplicates: word shingles and per cent of Jaccard similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of a repeated passage: passages of over 50 words are longer.
PASSAGE = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows in which no language is told: null and empty texts, texts without letters, and undecided ones.

    Long texts are read whole; repeated rows share their fate; other columns may
    have any names. Without a labelled row nothing is told, so all rows go; an
    empty table gives an empty one.
    """
    model = convnet.fit_language(docs)

    def decide(texts: list) -> list[bool]:
        names, scores = model.predict(texts)
        return [n != "und" and s >= LANGUAGE_LEAST for n, s in zip(names, scores, strict=True)]

    return common.keep_rows(docs, decide)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that the quality network, fitted on the labelled rows among ``docs``, scores below a half.

    Null texts count as empty ones, which have the score of the base rate; long
    texts are read whole; repeated rows share their fate; other columns may have
    any names. Without a labelled row the network stays as drawn; an empty table
    gives an empty one.
    """
    model = convnet.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.keep_rows(docs, lambda texts: (model.scores(texts) >= QUALITY_LEAST).tolist())


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect, one document stays, the one of the smallest id (see ``jaccard.one_of_each``)."""
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur again from all texts; rows that are nothing else go, null and empty texts stay (see ``suffixes.without_repeats``)."""
    return suffixes.without_repeats(docs, PASSAGE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of tokens: a row for each piece; a null or empty text is its closing id alone (see ``packing.pack``)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_duplicates),
    ("suffix_array_dedup", remove_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale-factor folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Networks and transforms have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
