"""A training corpus from ``documents``: toxic texts out, boilerplate lines out, one of each group of near copies, sources
mixed to target weights, packed into sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next one's docs. All but the last return
the columns of documents. ``run`` applies them in turn and keeps every result as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lines, mixing, packing, simhash, toxicity
from lectern.llm.common import session, table
from lectern.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon predicts to be toxic go; it is learned from the labelled ones among ``docs``."""
    session(spark)
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, lexicon)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of two or more texts that spread over many sites go, but for their first occurrence; n_chars follows the text."""
    session(spark)
    cleaned = lines.without_boilerplate(docs, counts=False)
    lengths = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cleaned if lengths is None else cleaned.withColumn("n_chars", F.coalesce(lengths, F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more stays."""
    session(spark)
    return simhash.keep_one(docs, simhash.near_copies(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it: never, once or twice."""
    session(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    session(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn a lexicon, hash and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
