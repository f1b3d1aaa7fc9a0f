"""The queries opN_* of this package, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, read, shared_dir


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the host and pattern rules."""
    from graphloom.llm.url_filter import filter_urls

    out = filter_urls(read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", F.when(F.col("host_rule") == 1, F.col("matched")).alias("rule"), "verdict", F.when(F.col("host_rule") == 0, F.col("matched")).alias("pattern"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    from graphloom.llm.lang_id import predict_language

    out = predict_language(read(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


#: Documents of one arrival in op3_sharding, by id.
ARRIVAL = 2048


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as arrivals of 2048 ids each, compacted, and read by the manifest."""
    from graphloom.llm.sharding import ShardedTable

    table = ShardedTable(spark, shared_dir(spark, "shards"))
    docs = read(spark, sf_dir, "documents")
    table.append(docs, F.floor(F.col("doc_id") / ARRIVAL))
    table.compact()
    table.vacuum()
    return table.read().select("doc_id", F.col("__arrival").alias("arrival"), F.col("__shard").alias("shard"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item within every document, up to the error budget."""
    from graphloom.llm.decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    from graphloom.llm.pii import BASE_KINDS, find_pii

    found = find_pii(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(k)))).cast("bigint").alias(f"n_{k}")
    counts = [number(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    from graphloom.llm.ann import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labels that aren't held out."""
    from graphloom.llm.quality import score_quality, train_model

    docs = read(spark, sf_dir, "documents")
    out = score_quality(docs, train_model(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels that aren't held out."""
    from graphloom.llm.toxicity import score_toxicity, train_model

    docs = read(spark, sf_dir, "documents")
    out = score_toxicity(docs, train_model(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("hits").cast("bigint").alias("n_hits"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies of all documents, at a Jaccard similarity of 0.85."""
    from graphloom.llm.neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """The file of the word-level vocabulary that comes with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    from graphloom.llm.bpe import encode_documents

    out = encode_documents(read(spark, sf_dir, "documents"), path or tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


_OP1_RULES = "(VALUES ('com/en/','com','/en/','block'),('example.com/en/7','example.com','/en/7','allow'),('net/de/','net','/de/','allow'),('example.net/de/8','example.net','/de/8','block'),('org/es/','org','/es/','block')) r(rule, rhost, rpath, rverdict)"
_OP1_PATTERNS = r"""(VALUES
 ('||casino-win.', '(?s)^([^/]*\.)?casino-win\..*'), ('||cheap-pills.', '(?s)^([^/]*\.)?cheap-pills\..*'),
 ('||free-bets.', '(?s)^([^/]*\.)?free-bets\..*'), ('||ads.', '(?s)^([^/]*\.)?ads\..*'), ('/ads/', '(?s).*/ads/.*'),
 ('/tracking^', '(?s).*/tracking([^a-zA-Z0-9_%.-].*|$)'), ('-casino.', '(?s).*-casino\..*'),
 ('||poker-*.example.', '(?s)^([^/]*\.)?poker-.*\.example\..*'), ('/wp-login.php^', '(?s).*/wp-login\.php([^a-zA-Z0-9_%.-].*|$)'),
 ('||doubleclick.', '(?s)^([^/]*\.)?doubleclick\..*')) p(pattern, regex)"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
targets AS (SELECT DISTINCT host, path FROM parts),
host_best AS (
  SELECT host, path, arg_max(rule, struct_pack(l := length(rule), r := rule)) AS rule, arg_max(rverdict, struct_pack(l := length(rule), r := rule)) AS rverdict
  FROM targets JOIN {_OP1_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
pattern_best AS (
  SELECT host, path, arg_max(pattern, struct_pack(l := length(pattern), r := pattern)) AS pattern
  FROM targets JOIN {_OP1_PATTERNS} ON regexp_full_match(host || path, regex) GROUP BY host, path)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rverdict WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM parts LEFT JOIN host_best USING (host, path) LEFT JOIN pattern_best USING (host, path)""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
und AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS id, a AS top FROM und UNION SELECT und.b, reach.top FROM reach JOIN und ON und.a = reach.id WHERE reach.top < und.b),
best AS (SELECT id, min(top) AS top FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(best.top, d.doc_id) AS component_id, coalesce(best.top, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN best ON best.id = d.doc_id""",
}
