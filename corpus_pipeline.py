"""The corpus pipeline: five stages from raw documents to a weighted mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm import decontamination, langid, line_dedup, minhash_dedup, mixing
from vouchlake.llm.common import checkpointed, table

#: Dimensions of the stage's profiles: noise is half as wide as with langid's own, and short texts keep their distance from it.
LANGUAGE_DIM = 4096
#: The share of unrelated texts that noise alone may take for any language.
BY_CHANCE = 1e-4


def min_score(languages: int, dim: int = LANGUAGE_DIM) -> float:
    """The cosine that the best of so many languages exceeds by chance for BY_CHANCE of the texts: an unrelated one's is normal, with deviation 1 / sqrt(dim) for any number of trigrams."""
    return NormalDist().inv_cdf(1 - BY_CHANCE / max(languages, 1)) / dim**0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects documents in which no language is recognised (no letters, or a score that unrelated texts reach by chance, see min_score). The prototypes are learned from the documents that are not held out."""
    langs, protos = langid.fit_prototypes(docs, ~langid.held_out() & F.col("doc_id").isNotNull(), dim=LANGUAGE_DIM)
    seen = docs.withColumn("__language", langid.language_of(F.col("text"), langs, protos))
    return seen.where((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= min_score(len(langs)))).drop("__language")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each group of equal or nearly equal lines the first stays. Documents that lose all their lines go; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, prefix="__")
    left = F.col("__n_removed") == 0
    out = out.where(left | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(left, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: one document of each group stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage, also with other parameters, go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each copy that the mixture takes, with the columns of documents, ``copy`` (from 1), ``size`` and its source's ``target``."""
    return mixing.take_copies(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
]

#: Cosine profiles, SimHash links and random rounding have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
