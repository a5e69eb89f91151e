"""From raw documents to encoded training text: quality, near duplicates, repeated passages, mix, tokens."""

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint.llm import chunk_bpe, line_crf, mixing, phrase_dedup, simhash
from seaglint.session import ensure_checkpoint_dir

OWN = "_own_"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def apart(docs: DataFrame, *names: str) -> DataFrame:
    """The documents with their columns of these names out of an operator's way; ``together`` puts them back."""
    return docs.withColumnsRenamed({c: OWN + c for c in names if c in docs.columns})


def together(found: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The columns of ``docs``, under their own names."""
    return found.select(*[F.col(f"`{OWN + c}`").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content; the field is trained on those with a label."""
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [part.split()[0] for part in line_crf.JUDGED.split(", ")]
    return together(line_crf.quality_rules(apart(docs, *names), field).where("kept"), docs, *names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by ascending doc_id."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that recur; a text that loses none stays as it is.

    What is left of a text is joined by single spaces, and n_chars counts it.
    """
    names = ["n_words", "n_removed", "kept"]
    found = phrase_dedup.remove_repeats(apart(docs, *names))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return together(left, docs, *names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken; those that are not taken go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each document of the mix."""
    return chunk_bpe.encode(docs, TOKENIZER).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL cannot decode a random field or run a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
