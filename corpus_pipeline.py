"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes all rows that the one before kept, as they were written, and calls one
operator of ``tallyspark.llm``. The first four return the columns of ``documents``; the
last adds ``size``, ``source_size``, ``target`` and ``taken`` (the words that the mix takes of
the document; 0 leaves it out).

Defined cases, in all stages: a null text is an empty one; rows with a null id or source take part like any other; repeated rows are documents of
their own, of which near-duplicate removal keeps one; texts of any length are read whole; extra columns are carried along whatever their names, but
for those that the last stage adds, which it replaces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, mixing, secrets, similar, toxicity
from tallyspark.llm.common import Written, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the multiple-instance model scores 0.5 or more; learns from the labels outside the held-out fold.

    An empty or null text has the score of no evidence, and stays; without labels of both kinds nothing is rejected. No length makes a text toxic.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id", 5, 0))
    model = toxicity.train(docs, labels)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of five-word similarity 0.8 or more; candidates are linked SimHash fingerprints and, for pairs further apart, minima of shingles.

    Texts without words (null or empty) are copies of each other; of rows that share the smallest id, and in groups whose ids are null, one stays.
    """
    return similar.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item, or all of one with fewer.

    A null or empty text, or item, has no words and no hit; without items nothing is rejected; a benchmark of any size is met.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the credentials that are not copied examples; all documents stay.

    `n_chars` becomes the masked text's length and stays where the text is null, as the text does. Spans that overlap share a mask; null owners are one owner.
    """
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Says how many words the mix takes of each document; its four columns replace any of the same names.

    A null text has size 0 and is never taken; null sources are one source, the last. All documents stay.
    """
    added = ("size", "source_size", "target", "taken")
    mixed = mixing.mix(docs, carry=tuple(c for c in docs.columns if c not in added))
    return mixed.select("row.*", *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: Hashes, learned weights and seeded streams have no SQL form; tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what a stage wrote goes as soon as the next one has read it."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            following = keep(Written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if held:
            held.drop()
        docs, held = following.df, following
    return STAGES[-1][1](spark, docs, sf_dir)
