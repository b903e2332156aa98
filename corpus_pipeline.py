"""The corpus pipeline: quality, near duplicates, contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. The stages' results are written as
Parquet and read again between stages.

In every stage rows are judged one by one: repeated rows stay or go together, rows that share a
doc_id but differ in their text are judged by their own texts, null doc_ids are kept unless their text is
rejected. Null and empty texts have no words, no secrets and no tokens. No documents give none, and columns
of docs beyond COLUMNS don't come out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import bpe, decontaminate, ngram_join, quality, secrets
from peakloom.workspace import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null or empty text is scored by its page data and its lack of words."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where(F.col("quality_score") >= quality.LEAST_QUALITY).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    A row goes by its doc_id and its text, so another row with its doc_id stays if its own text is no
    copy; rows with a null doc_id stay.
    """
    gone = ngram_join.ngram_components(docs, mark_col="mark").where("doc_id <> component_id").select(F.col("doc_id").alias("of"), "mark").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["of"]) & (F.xxhash64(docs["text"]) == gone["mark"]), "left_anti").select(*COLUMNS)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth and more lie in windows of benchmark items."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts and n_chars follows; every document stays."""
    found = secrets.redact(secrets.find_secrets(docs))
    return found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to."""
    coded = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", contamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding", tokens_stage),
]

#: SQL cannot express the classifier, the entropy windows and the automaton; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
