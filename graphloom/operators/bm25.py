"""BM25 over texts or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.paths import is_copy_or_log
from graphloom.functions.text import node_text, tokenize
from graphloom.graph import PropertyGraph
from graphloom.operators.iterate import cut

K1, B = 1.5, 0.75
NOISE = 0.1


def index(docs: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, terms, length), one row (n, avgdl)): texts without terms count too."""
    held = docs.select(key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    return held, held.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def idf(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, df, idf)."""
    held, size = index(docs, key, text)
    df = held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(size.collect()[0]["n"])
    return df.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def scores(docs: DataFrame, query: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, score) of what the query's terms occur in; a repeated term counts repeatedly.

    Texts are split once: the pass that writes the hits of the query's terms
    also counts texts and their lengths.  Only hits are aggregated, and the
    terms' counts meet on the driver.
    """
    held = index(docs, key, text)[0]
    spark = docs.sparkSession
    asked = [r["t"] for r in spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("t")).collect()]
    if not asked:
        return held.select(key, F.lit(0.0).alias("score")).limit(0)
    want = F.array(*[F.lit(t) for t in sorted(set(asked))])
    seen = Observation()
    held = held.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    hits = held.where(F.arrays_overlap("terms", want)).select(key, "length", F.filter("terms", lambda t: F.array_contains(want, t)).alias("hits"))
    hits = cut(hits)
    total = seen.get
    average = total["length"] / total["n"] if total["length"] else 1.0
    df = {r["t"]: r["df"] for r in hits.select(F.explode(F.array_distinct("hits")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    score = F.lit(0.0)
    for t in sorted(set(asked)):
        tf = F.size(F.filter("hits", lambda x: x == F.lit(t)))
        n, d = F.lit(float(total["n"])), F.lit(float(df.get(t, 0)))
        weight = F.log((n - d + 0.5) / (d + 0.5) + 1)
        part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(average)))
        score = score + asked.count(t) * part
    return hits.select(key, score.alias("score")).where("score > 0")


def node_texts(graph: PropertyGraph) -> DataFrame:
    n = graph.nodes.where("type <> 'area'")
    qualname = F.col("extra")["qualname"] if "extra" in n.columns else F.lit(None).cast("string")
    description = F.col("description") if "description" in n.columns else F.lit(None).cast("string")
    return n.select("id", "path", node_text(F.col("id"), F.col("label"), F.col("type"), F.col("path"), qualname, description).alias("text"))


def focus_seeds(graph: PropertyGraph, task: str) -> DataFrame:
    """(id, weight): BM25 of the task over nodes but areas; backups and logs weigh a tenth."""
    texts = node_texts(graph)
    hit = scores(texts, task)
    return hit.join(texts.select("id", "path"), "id").select("id", F.when(is_copy_or_log(F.coalesce("path", "id")), F.col("score") * NOISE).otherwise(F.col("score")).alias("weight"))
