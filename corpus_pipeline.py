"""From raw documents to a training mix: each stage calls one operator of ``edaflux.llm`` on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edaflux.llm import decontaminate, queries, simhash, substring, toxicity
from edaflux.llm.frames import fresh, stored


def _cut(docs: DataFrame, operator) -> DataFrame:
    """``operator`` over the texts; ``n_chars`` is taken again, in the type it had, where the text has changed."""
    if "n_chars" not in docs.columns:
        return operator(docs)
    before = fresh(docs, "_before")
    done = operator(docs.withColumn(before, F.xxhash64("text")))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.xxhash64("text") != F.col(before)
    return done.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id's, stays of each group that fingerprints of three-word shingles within two bits connect."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id holds are cut from the text."""
    return _cut(docs, lambda d: substring.deduplicated(d, width=50))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the text."""
    return _cut(docs, lambda d: decontaminate.decontaminated(d, queries.table(spark, sf_dir, "benchmark"), window=10))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in their target shares; a row for each epoch in which a document is taken, with ``domain``, ``epoch``
    and ``n_tokens`` added. They replace columns of those names."""
    return queries.mixture(docs, keep=tuple(docs.columns))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
]

# A trained classifier and fingerprints over XXH64 have no SQL. The tests hold every stage on its own input against a plain
# re-statement: toxicity against the classifier's decisions, near_duplicates against all pairs of fingerprints,
# repeated_passages (words removed) and benchmark (documents changed) against brute force, mixture against its SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's result is a table in the shared folder.

    Null and empty texts pass every stage but near_duplicates, which keeps one text without words. Rows with null ids pass;
    of repeated rows near_duplicates keeps one. Further columns are kept as they are. No documents give no rows."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
