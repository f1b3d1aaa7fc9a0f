"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import basename, top_area
from graphloom.graph import PropertyGraph
from graphloom.operators.iterate import cut


def _id(before: str, key: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after))


FILES = (
    ("region", "structure", ("region/R", "r_regionkey", ".md"), lambda: F.length("r_name")),
    ("nation", "design", ("nation/N", "n_nationkey", ".md"), lambda: F.length("n_name")),
    ("supplier", "config", ("supplier/S", "s_suppkey", ".toml"), lambda: F.floor(F.abs("s_acctbal"))),
    ("customer", "data", ("customer/C", "c_custkey", ".csv"), lambda: F.floor(F.abs("c_acctbal"))),
    ("part", "program", ("part/P", "p_partkey", ".py"), lambda: F.floor("p_retailprice")),
    ("orders", "report", ("orders/O", "o_orderkey", ".md"), lambda: F.floor("o_totalprice")),
)


_BUILT: dict[tuple[str, str, tuple[int, ...]], PropertyGraph] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When each of the tables was last written."""
    out = []
    for name in (*(f[0] for f in FILES), "lineitem", "events"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        out.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return tuple(out)


def catalog_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The catalog graph, stored once for each application, folder and state of its tables, so that queries scan
    tables with statistics instead of building it anew within every join."""
    at = (spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir))
    if at not in _BUILT:
        g = build_catalog(spark, sf_dir)
        _BUILT[at] = PropertyGraph(cut(g.nodes), cut(g.edges), g.project)
    return _BUILT[at]


def catalog_part(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The catalog graph for queries that ask once for few kinds of nodes or edges: if it isn't stored yet it isn't
    stored for them, so that filters reach the tables and only the kinds asked for are made."""
    return _BUILT.get((spark.sparkContext.applicationId, sf_dir, _written(spark, sf_dir))) or build_catalog(spark, sf_dir)


def build_catalog(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Files per row, sessions per user and day, decisions per order priority, areas per folder."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    day = F.date_format("ts", "yyyyMMdd")
    session = F.concat(F.lit("session:"), F.col("user_id").cast("string"), F.lit("-"), day)

    files: DataFrame | None = None
    for name, kind, parts, size in FILES:
        rows = table(name).select(_id(*parts).alias("id"), F.lit(kind).alias("type"), size().cast("bigint").alias("size"))
        files = rows if files is None else files.union(rows)
    files = files.select("id", "type", basename(F.col("id")).alias("label"), F.col("id").alias("path"), "size", F.lit(None).cast("string").alias("date"))
    plain = lambda d, kind, label, date=None: d.select("id", F.lit(kind).alias("type"), label.alias("label"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("bigint").alias("size"), (date if date is not None else F.lit(None)).cast("string").alias("date"))
    days = table("events").select(session.alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct()
    sessions = plain(days, "session", F.col("id"), F.col("d"))
    decisions = plain(table("orders").select(F.concat(F.lit("decision:"), F.col("o_orderpriority")).alias("id")).distinct(), "decision", F.substring("id", 10, 1000))
    areas = plain(files.select(F.concat(F.lit("area:"), top_area(F.col("path"))).alias("id")).distinct(), "area", F.substring("id", 6, 1000))
    nodes = files.union(sessions).union(decisions).union(areas).withColumn("description", F.concat("type", F.lit(" "), "label"))

    order, customer, nation, region = ("orders/O", ".md"), ("customer/C", ".csv"), ("nation/N", ".md"), ("region/R", ".md")
    part, supplier = ("part/P", ".py"), ("supplier/S", ".toml")
    of = lambda shape, key: _id(shape[0], key, shape[1])
    edge = lambda d, s, t, kind: d.select(s.alias("source"), t.alias("target"), F.lit(kind).alias("type"))
    line, orders = table("lineitem"), table("orders")
    edges = [
        edge(line.select("l_orderkey", "l_partkey").distinct(), of(order, "l_orderkey"), of(part, "l_partkey"), "imports"),
        edge(orders, of(order, "o_orderkey"), of(customer, "o_custkey"), "references"),
        edge(table("customer"), of(customer, "c_custkey"), of(nation, "c_nationkey"), "references"),
        edge(table("supplier"), of(supplier, "s_suppkey"), of(nation, "s_nationkey"), "references"),
        edge(table("nation"), of(nation, "n_nationkey"), of(region, "n_regionkey"), "references"),
        edge(line.select("l_partkey", "l_suppkey").distinct(), of(part, "l_partkey"), of(supplier, "l_suppkey"), "references"),
        edge(table("events").join(table("customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").select("user_id", day.alias("d")).distinct(), F.concat(F.lit("session:"), F.col("user_id").cast("string"), F.lit("-"), F.col("d")), of(customer, "user_id"), "touches"),
        edge(orders, of(order, "o_orderkey"), F.concat(F.lit("decision:"), F.col("o_orderpriority")), "mentions"),
        edge(files, F.col("id"), F.concat(F.lit("area:"), top_area(F.col("path"))), "belongs_to"),
    ]
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.union(e)
    # keys repeat only within a kind's own table, where they are made distinct
    return PropertyGraph(nodes, whole.withColumn("ord", F.lit(None).cast("bigint")), "catalog")


#: The same graph for the SQL engine that checks results.
CATALOG_SQL = """
WITH files AS (
  SELECT 'region/R' || r_regionkey || '.md' AS id, 'structure' AS type, length(r_name)::BIGINT AS size FROM region
  UNION ALL SELECT 'nation/N' || n_nationkey || '.md', 'design', length(n_name) FROM nation
  UNION ALL SELECT 'supplier/S' || s_suppkey || '.toml', 'config', floor(abs(s_acctbal))::BIGINT FROM supplier
  UNION ALL SELECT 'customer/C' || c_custkey || '.csv', 'data', floor(abs(c_acctbal))::BIGINT FROM customer
  UNION ALL SELECT 'part/P' || p_partkey || '.py', 'program', floor(p_retailprice)::BIGINT FROM part
  UNION ALL SELECT 'orders/O' || o_orderkey || '.md', 'report', floor(o_totalprice)::BIGINT FROM orders),
nodes AS (
  SELECT id, type, split_part(id, '/', 2) AS label, id AS path, size, NULL::VARCHAR AS date FROM files
  UNION ALL SELECT DISTINCT 'session:' || user_id || '-' || strftime(ts, '%Y%m%d'), 'session', 'session:' || user_id || '-' || strftime(ts, '%Y%m%d'), NULL, 0, strftime(ts, '%Y-%m-%d') FROM events
  UNION ALL SELECT DISTINCT 'decision:' || o_orderpriority, 'decision', o_orderpriority, NULL, 0, NULL FROM orders
  UNION ALL SELECT DISTINCT 'area:' || split_part(id, '/', 1), 'area', split_part(id, '/', 1), NULL, 0, NULL FROM files),
edges AS (
  SELECT DISTINCT 'orders/O' || l_orderkey || '.md' AS source, 'part/P' || l_partkey || '.py' AS target, 'imports' AS type FROM lineitem
  UNION ALL SELECT 'orders/O' || o_orderkey || '.md', 'customer/C' || o_custkey || '.csv', 'references' FROM orders
  UNION ALL SELECT 'customer/C' || c_custkey || '.csv', 'nation/N' || c_nationkey || '.md', 'references' FROM customer
  UNION ALL SELECT 'supplier/S' || s_suppkey || '.toml', 'nation/N' || s_nationkey || '.md', 'references' FROM supplier
  UNION ALL SELECT 'nation/N' || n_nationkey || '.md', 'region/R' || n_regionkey || '.md', 'references' FROM nation
  UNION ALL SELECT DISTINCT 'part/P' || l_partkey || '.py', 'supplier/S' || l_suppkey || '.toml', 'references' FROM lineitem
  UNION ALL SELECT DISTINCT 'session:' || user_id || '-' || strftime(ts, '%Y%m%d'), 'customer/C' || user_id || '.csv', 'touches' FROM events WHERE user_id IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'orders/O' || o_orderkey || '.md', 'decision:' || o_orderpriority, 'mentions' FROM orders
  UNION ALL SELECT id, 'area:' || split_part(id, '/', 1), 'belongs_to' FROM files),
k AS (SELECT * FROM edges WHERE type IN ('imports', 'references')),
kends AS (SELECT source AS id FROM k UNION ALL SELECT target FROM k),
kdeg AS (SELECT id, count(*) AS degree FROM kends GROUP BY id),
allends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE source <> target),
gdeg AS (SELECT id, count(*) AS degree FROM allends GROUP BY id)
"""
