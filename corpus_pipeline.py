"""Documents through five stages: language, near copies, benchmark leaks, personal data, tokens.

Each stage gets what its predecessor kept, as written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: those without a letter and those flagged ambiguous go."""
    from graphloom.llm.lang_id import predict_language

    told = predict_language(docs, train=read(spark, sf_dir, "documents"), carry=COLUMNS)
    return told.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (Jaccard 0.8 on five-word shingles)."""
    from graphloom.llm.neardup import drop_copies, near_duplicates

    groups = materialise(near_duplicates(docs, threshold=(80, 100)), "pipeline-groups")
    return drop_copies(docs.select(*COLUMNS), groups)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item within its error budget, each by its own text; null and repeated ids don't matter."""
    from graphloom.llm.decontaminate import without_leaks

    return without_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind in brackets."""
    from graphloom.llm.pii import find_pii

    found = find_pii(docs, redact=True, carry=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("bigint").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed unsigned 32-bit, little-endian) and their text."""
    from graphloom.llm.bpe import encode_documents
    from graphloom.llm.queries import tokenizer

    return encode_documents(docs, tokenizer())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages' models and edit distances have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.

    With a folder, stages are kept there under their names, and those that an
    earlier run over the same documents finished are read instead of made again.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        if folder is None:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            continue
        path = f"{folder.rstrip('/')}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
