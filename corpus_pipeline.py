"""A training corpus in five stages: language, near duplicates, benchmark passages, personal data, packing.

Every stage reads what the one before it wrote, and all but the last return the columns of ``documents``. Columns beyond
these five are dropped by the first stage; null texts have no language and go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, language, near_dups, packing, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with the sizes of the texts as they are now."""
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(c).cast(docs.schema[c].dataType) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what no known language is near to (and what has no letter); name the language of the rest."""
    common.ready(spark)
    found = language.identify(docs, language.fit(docs), carry=("text", "source"))
    return _like(found.where("NOT rejected").withColumn("lang", F.col("lang_pred")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, keep the document with the smallest id.

    Of rows that repeat an id, the first by text, language and source stays; rows without an id, or with a text that has
    no word, have no duplicates and stay. What stays is decided on ids alone, and a text moves at most once.
    """
    common.ready(spark)
    found = near_dups.near_duplicates(docs, words=5)
    ids = common.settle(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "kept")
    common.discard(found)
    once = docs.join(common.handed(ids.where("n = 1").select("doc_id")), "doc_id", "left_semi")
    again = docs.join(common.handed(ids.where("n > 1").select("doc_id")), "doc_id", "left_semi")
    first = again.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("x")).select("doc_id", "x.*")
    columns = ["doc_id", "text", "lang", "source"]
    return _like(once.select(columns).unionByName(first).unionByName(docs.where("doc_id IS NULL").select(columns)), docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with windows of two benchmark items or more; cut the windows of a single one out of the rest."""
    found = decontaminate.find_passages(docs, common.table(spark, sf_dir, "benchmark"), carry=("lang", "source"), cut=True)
    left = (F.size("items") < 2) & ((F.size("spans") == 0) | F.col("text").rlike(r"\S"))
    return _like(found.where(left), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, plain or disguised, by its kind in angle brackets."""
    common.ready(spark)
    found = pii.find_pii(docs, carry=("lang", "source"))
    return _like(found.withColumn("text", F.col("redacted")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of at most 2048 tokens."""
    common.ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark_passages),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: SQL has no nearest centroids, sketches or tokenizers; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is then given back."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        common.discard(before)
        common.freed(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
