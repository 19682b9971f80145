"""A training-corpus pipeline: language, near duplicates, personal data, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it for the next stage. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import entries, jaccard, langid, mixing, pii
from cartulary.llm.common import documents, remainder, written

#: Posterior probability of the likeliest language that a document needs: that of all the others together, or more.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language was recognised: texts that are null or have no letter go, and those for which
    no language reaches LEAST_POSTERIOR. Where no document has a language to learn from, all stay."""
    fitted = langid.learn(docs.where(remainder("doc_id", 5) != 0), entries.tokenizer_file("piece_bpe_32k.model"))
    if not fitted.langs:
        return docs
    # Outputs' names are kept apart from columns of docs that have the same
    named = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), fitted, ["row"])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of similarity 0.8 or more connect, the one with the smallest id stays."""
    return jaccard.near_duplicates_removed(docs, k=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of their kinds."""
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources come near their targets."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return entries.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]

#: Learned models, components and packing aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
