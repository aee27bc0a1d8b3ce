"""The engine's relations over the supplied tables, as DataFrames and as SQL for the comparison.

symbols, contains, edges, chunks and facts are what an index holds; they are made here from the retrieval tables (context_symbols,
context_docs) and, for a graph of size, from orders and lineitem. ``SQL`` holds the same as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import load

#: Call tiers by the flag of a line, and the confidence written for each relation.
TIER = {"A": "CALLS_DIRECT", "N": "CALLS_SCOPED", "R": "CALLS_IMPORTED"}


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """``uid, name, qualified_name, file_path, kind, role, start_line, end_line``: one row per symbol."""
    s = load(spark, d, "context_symbols").where("uid is not null").groupBy("uid").agg(
        F.min("symbol").alias("name"), F.min("file_path").alias("file_path"), F.min("kind").alias("kind"), F.min("role").alias("role"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")
    )
    return s.withColumn("qualified_name", F.concat_ws(".", F.regexp_replace(F.regexp_replace("file_path", r"\.[a-z]+$", ""), "/", "."), "name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, rel_type, confidence``: customers call parts, suppliers use parts, parts depend on the part of half their number."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    tier = F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv])
    conf = F.create_map(*[F.lit(x) for kv in {"CALLS_DIRECT": 1.0, "CALLS_SCOPED": 0.9, "CALLS_IMPORTED": 0.85, "USES_TYPE": 1.0, "DEPENDS_ON": 0.9}.items() for x in kv])
    calls = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), tier[F.col("l_returnflag")].alias("rel_type"))
    uses = li.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("USES_TYPE").alias("rel_type"))
    deps = load(spark, d, "part").where("p_partkey > 1").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("P"), F.expr("p_partkey div 2")).alias("dst"), F.lit("DEPENDS_ON").alias("rel_type"))
    return calls.unionByName(uses).unionByName(deps).distinct().withColumn("confidence", conf[F.col("rel_type")])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_id, workspace_id, source_file, content, owner_uid, score``: one row per chunk that has content."""
    c = load(spark, d, "context_docs").where("content is not null and length(trim(content)) > 0")
    return c.groupBy("chunk_id").agg(*[F.min(x).alias(x) for x in ("workspace_id", "source_file", "content", "owner_uid", "score")])


#: The relations of the wide graph, by a number made of a line's keys.
RELATIONS = (
    "CALLS_DIRECT CALLS_SCOPED CALLS_IMPORTED CALLS_DYNAMIC CALLS_INFERRED CALLS_GUESS USES_TYPE USES_TYPE HAS_API INHERITED_API INJECTS DEPENDS_ON HANDLES DECORATED_BY INSTANTIATES RESOLVES_ATTR COMPOSES READS_ATTR "
    "WRITES_ATTR AFFECTS CALLS_ENDPOINT IMPLEMENTS_ENDPOINT FLOWS_INTO"
).split()
TYPE_KINDS, WRITE_KINDS = ("param", "annotation", "return", "isinstance"), ("write", "write_subscript", "write_subscript_local")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """``uid, kind, file_path, package, name`` and flags: one symbol for each part; every tenth lies in a test."""
    p = load(spark, d, "part")
    folder = F.when(F.col("p_size") % 10 == 0, "tests/").otherwise("src/")
    file = F.concat(folder, F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".py"))
    return p.select(
        F.concat(F.lit("P"), "p_partkey").alias("uid"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method").alias("kind"),
        file.alias("file_path"), F.concat(folder, F.lower("p_type")).alias("package"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"),
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, rel_type, kind, confidence``: a graph over the parts (and endpoints E...) with every relation, each edge once."""
    from .operators.fans import confidence

    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    n = F.pmod(F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber"), F.lit(len(RELATIONS))).cast("int")
    q = F.col("l_quantity").cast("int")
    kind = F.when(n.isin(6, 7), F.element_at(F.array(*map(F.lit, TYPE_KINDS)), q % 4 + 1)).when(n == 18, F.element_at(F.array(*map(F.lit, WRITE_KINDS)), q % 3 + 1)).otherwise("")
    dst = F.when(n.isin(20, 21), F.concat(F.lit("E"), F.col("l_suppkey") % 40)).otherwise(F.concat(F.lit("P"), F.col("l_suppkey") * 3 + F.col("l_linenumber")))
    e = li.select(F.concat(F.lit("P"), "l_partkey").alias("src"), dst.alias("dst"), F.element_at(F.array(*map(F.lit, RELATIONS)), n + 1).alias("rel_type"), kind.alias("kind"), F.when(F.col("l_returnflag") != "N", F.round(1 - F.col("l_discount"), 2)).alias("stored"))
    e = e.where("src <> dst").groupBy("src", "dst", "rel_type", "kind").agg(F.max("stored").alias("stored"))
    return e.select("src", "dst", "rel_type", "kind", confidence(F.col("rel_type"), F.col("stored"), F.col("kind")).alias("confidence"))


def _sql_list(names: tuple | list) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _relations_sql() -> str:
    from .operators.fans import CONFIDENCE, TYPE_WEIGHT

    case = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 1.0 END"
    return f"""relations AS (SELECT src, dst, rel_type, kind, (CASE WHEN rel_type = 'USES_TYPE' THEN {case('kind', TYPE_WEIGHT)} ELSE coalesce(max(stored), {case('rel_type', CONFIDENCE)}) END)::DOUBLE AS confidence FROM (
  SELECT 'P' || l_partkey AS src, CASE WHEN n IN (20, 21) THEN 'E' || (l_suppkey % 40) ELSE 'P' || (l_suppkey * 3 + l_linenumber) END AS dst, {_sql_list(RELATIONS)}[n + 1] AS rel_type,
  CASE WHEN n IN (6, 7) THEN {_sql_list(TYPE_KINDS)}[q % 4 + 1] WHEN n = 18 THEN {_sql_list(WRITE_KINDS)}[q % 3 + 1] ELSE '' END AS kind, CASE WHEN l_returnflag <> 'N' THEN round(1 - l_discount, 2) END AS stored
  FROM (SELECT *, ((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % {len(RELATIONS)})::INT AS n, trunc(l_quantity)::INT AS q FROM lineitem)) WHERE src <> dst GROUP BY 1, 2, 3, 4)"""


SQL = {
    "nodes": """nodes AS (SELECT 'P' || p_partkey AS uid, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'function' ELSE 'method' END AS kind,
  CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'src/' END || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '.py' AS file_path, CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'src/' END || lower(p_type) AS package, p_size AS size, p_partkey AS key FROM part)""",
    "symbols": r"""symbols AS (SELECT *, concat_ws('.', replace(regexp_replace(file_path, '\.[a-z]+$', ''), '/', '.'), name) AS qualified_name FROM
  (SELECT uid, min(symbol) AS name, min(file_path) AS file_path, min(kind) AS kind, min(role) AS role, min(start_line) AS start_line, max(end_line) AS end_line FROM context_symbols WHERE uid IS NOT NULL GROUP BY uid))""",
    "edges": """edges AS (SELECT src, dst, rel_type, CASE rel_type WHEN 'CALLS_DIRECT' THEN 1.0 WHEN 'CALLS_SCOPED' THEN 0.9 WHEN 'CALLS_IMPORTED' THEN 0.85 WHEN 'USES_TYPE' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM (
  SELECT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'CALLS_DIRECT' WHEN 'N' THEN 'CALLS_SCOPED' WHEN 'R' THEN 'CALLS_IMPORTED' END AS rel_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT 'S' || l_suppkey, 'P' || l_partkey, 'USES_TYPE' FROM lineitem
  UNION SELECT 'P' || p_partkey, 'P' || (p_partkey // 2), 'DEPENDS_ON' FROM part WHERE p_partkey > 1))""",
    "chunks": """chunks AS (SELECT chunk_id, min(workspace_id) AS workspace_id, min(source_file) AS source_file, min(content) AS content, min(owner_uid) AS owner_uid, min(score) AS score
  FROM context_docs WHERE content IS NOT NULL AND length(trim(content)) > 0 GROUP BY chunk_id)""",
}


def sql(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named relations."""
    if "relations" in names and "relations" not in SQL:
        SQL["relations"] = _relations_sql()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
