"""Queries on walks, closures, paths and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import selection as se
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register
CALLS = ("CALLS_DIRECT", "CALLS_SCOPED", "CALLS_IMPORTED")


def _seeds(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    return load(spark, d, "part").where(F.col("p_partkey").between(1, n)).select(F.concat(F.lit("P"), "p_partkey").alias("node")).withColumn("seed", F.col("node"))


def _walk_sql(pairs: str, seeds: str, hops: int) -> str:
    """A recursive walk: ``pairs`` gives src and dst, ``seeds`` gives seed."""
    return f"""{views.sql('edges', recursive=True)}, g AS (SELECT DISTINCT src, dst FROM ({pairs}) WHERE src <> dst), s AS ({seeds}),
w AS (SELECT seed, seed AS node, 0 AS depth FROM s UNION SELECT seed, dst, depth + 1 FROM w JOIN g ON src = node WHERE depth < {hops}),
m AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2)"""


_REV = "SELECT dst AS src, src AS dst FROM edges WHERE rel_type LIKE 'CALLS%'"
_BOTH = "SELECT src, dst FROM edges WHERE rel_type = 'DEPENDS_ON' UNION SELECT dst, src FROM edges WHERE rel_type = 'DEPENDS_ON'"
_FWD = "SELECT src, dst FROM edges WHERE rel_type = 'DEPENDS_ON'"
_FOUR = "SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey BETWEEN 1 AND 4"


@register("g01_walk", _walk_sql(_BOTH, _FOUR, 3) + " SELECT node, min(depth) AS depth, count(DISTINCT seed) AS reach FROM m WHERE depth > 0 GROUP BY 1")
def g01(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three hops of four seeds, with least depth and number of seeds."""
    return gr.walk(gr.directed(views.edges(spark, d), "undirected", ["DEPENDS_ON"]), _seeds(spark, d), 3)


@register("g01_reverse_calls", _walk_sql(_REV, _FOUR, 1) + " SELECT node, min(depth) AS depth, count(DISTINCT seed) AS reach FROM m WHERE depth > 0 GROUP BY 1")
def g01_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the seeds."""
    return gr.walk(gr.directed(views.edges(spark, d), "reverse", CALLS), _seeds(spark, d), 1)


@register("g03_walk_grouped", _walk_sql(_BOTH, _FOUR, 3) + " SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS r FROM m WHERE depth > 0) WHERE r <= CASE WHEN seed = 'P1' THEN 3 ELSE 5 END")
def g03(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's nearest nodes, with a limit of its own for one seed."""
    s = _seeds(spark, d).withColumn("limit", F.when(F.col("seed") == "P1", 3))
    return gr.walk_grouped(gr.directed(views.edges(spark, d), "undirected", ["DEPENDS_ON"]), s, 3, 5)


@register("g04_ancestors", _walk_sql(_FWD, "SELECT 'P' || p_partkey AS seed FROM part WHERE p_size = 50", 6) + " SELECT seed, node AS ancestor, depth FROM m WHERE depth > 0")
def g04(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors within six levels."""
    s = load(spark, d, "part").where("p_size = 50").select(F.concat(F.lit("P"), "p_partkey").alias("node")).withColumn("seed", F.col("node"))
    return gr.reach(gr.directed(views.edges(spark, d), "forward", ["DEPENDS_ON"]), s, 6).where("depth > 0").select("seed", F.col("node").alias("ancestor"), "depth")


@register("g05_affects_closure", _walk_sql("SELECT dst AS src, src AS dst FROM edges WHERE rel_type = 'DEPENDS_ON'", _FOUR, 4) + " SELECT seed AS source, node, depth FROM m WHERE depth > 0")
def g05(spark: SparkSession, d: str) -> DataFrame:
    """Reverse closure of four levels with at most 200 nodes of a level."""
    return gr.closure_bounded(views.edges(spark, d).where("rel_type = 'DEPENDS_ON'"), _seeds(spark, d).select("node"), 4, 200)


@register("g07_depth_from_roots", _walk_sql(_FWD.replace("src, dst", "dst AS src, src AS dst"), "SELECT 'P1' AS seed", 20) + " SELECT 'P' || p_partkey AS node, coalesce(depth, (SELECT max(depth) + 1 FROM m)) AS depth FROM part LEFT JOIN m ON node = 'P' || p_partkey")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Depth of every part below the root."""
    e = gr.directed(views.edges(spark, d), "reverse", ["DEPENDS_ON"])
    nodes = load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return gr.depth_from_roots(e, nodes, nodes.where("node = 'P1'"))


@register("g08_shortest_path", """WITH RECURSIVE a AS (SELECT 9 AS k, 0 AS i UNION ALL SELECT k // 2, i + 1 FROM a WHERE k > 1), b AS (SELECT 13 AS k, 0 AS i UNION ALL SELECT k // 2, i + 1 FROM b WHERE k > 1),
m AS (SELECT a.k, a.i AS ia, b.i AS ib FROM a JOIN b USING (k) ORDER BY a.i LIMIT 1)
SELECT i::INT AS position, 'P' || k AS node FROM a WHERE i <= (SELECT ia FROM m) UNION ALL SELECT ((SELECT ia + ib FROM m) - i)::INT, 'P' || k FROM b WHERE i < (SELECT ib FROM m)""")
def g08(spark: SparkSession, d: str) -> DataFrame:
    """A shortest path between two parts over what they depend on."""
    return gr.shortest_path(views.edges(spark, d).where("rel_type = 'DEPENDS_ON'"), "P9", "P13", 8)


@register("g09_api_surface", _walk_sql(_FWD, "SELECT 'P' || p_partkey AS seed FROM part WHERE p_size >= 45", 6) + """, api AS (SELECT 'P' || l_partkey AS owner, 'm' || l_suppkey AS method FROM lineitem WHERE l_quantity = 1 GROUP BY 1, 2)
SELECT seed AS class, method, owner AS origin, CASE WHEN depth = 0 THEN 'HAS_API' ELSE 'INHERITED_API' END AS rel_type FROM (SELECT *, row_number() OVER (PARTITION BY seed, method ORDER BY depth, owner) AS r FROM m JOIN api ON owner = node) WHERE r = 1""")
def g09(spark: SparkSession, d: str) -> DataFrame:
    """Each class's methods, its own or of the nearest ancestor that has them; the first wins, and cycles end by themselves."""
    s = load(spark, d, "part").where("p_size >= 45").select(F.concat(F.lit("P"), "p_partkey").alias("node")).withColumn("seed", F.col("node"))
    up = gr.reach(gr.directed(views.edges(spark, d), "forward", ["DEPENDS_ON"]), s, 6)
    api = load(spark, d, "lineitem").where("l_quantity = 1").select(F.concat(F.lit("P"), "l_partkey").alias("node"), F.concat(F.lit("m"), "l_suppkey").alias("method")).distinct()
    best = lk.first_by(up.join(api, "node"), ["seed", "method"], [F.col("depth"), F.col("node")])
    return best.select(F.col("seed").alias("class"), "method", F.col("node").alias("origin"), F.when(F.col("depth") == 0, "HAS_API").otherwise("INHERITED_API").alias("rel_type"))


@register("g10_flag_propagation", _walk_sql(_FWD.replace("src, dst", "dst AS src, src AS dst"), "SELECT 'P' || p_partkey AS seed FROM part WHERE p_size = 7", 6) + " SELECT DISTINCT node FROM m")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Everything that inherits a flag, in at most six rounds."""
    flagged = load(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return gr.propagate(views.edges(spark, d).where("rel_type = 'DEPENDS_ON'"), flagged, 6)


@register("g11_kind_by_ancestor", _walk_sql(_FWD, "SELECT 'P' || p_partkey AS seed FROM part", 6) + ", c AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_brand LIKE '%1') SELECT seed AS node, min(m.node) AS evidence FROM m JOIN c USING (node) WHERE depth > 0 GROUP BY 1")
def g11(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a carrier among their ancestors, the least as evidence: the carriers walk down, not all nodes up."""
    carriers = load(spark, d, "part").where("p_brand like '%1'").select(F.concat(F.lit("P"), "p_partkey").alias("node")).withColumn("seed", F.col("node"))
    down = gr.reach(gr.directed(views.edges(spark, d), "reverse", ["DEPENDS_ON"]), carriers, 6).where("depth > 0")
    known = load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return down.join(known, "node", "left_semi").groupBy("node").agg(F.min("seed").alias("evidence"))


_FAN = "f AS (SELECT 'P' || p_partkey AS node, coalesce(k, 0) AS fan_in FROM part LEFT JOIN (SELECT dst, count(DISTINCT src) AS k FROM edges WHERE rel_type LIKE 'CALLS%' GROUP BY 1) ON dst = 'P' || p_partkey)"


@register("g14_hub_gate", f"{views.sql('edges')}, {_FAN} SELECT node, fan_in FROM f WHERE fan_in <= (SELECT greatest(2, 1.2 * median(fan_in)) FROM f)")
def g14(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without hubs."""
    fan = views.edges(spark, d).where("rel_type like 'CALLS%'").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    return gr.hub_gate(load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node")), fan, 1.2)


@register("g21_role_lookahead", f"{views.sql('edges')}, n AS (SELECT DISTINCT e.src AS seed, 'P' || p.p_partkey AS node, p.p_type AS role FROM edges e JOIN part p ON e.dst = 'P' || p.p_partkey WHERE e.rel_type = 'USES_TYPE' AND e.src IN ('S1', 'S2', 'S3')) SELECT role, count(DISTINCT node) AS hits FROM n GROUP BY 1 HAVING count(DISTINCT node) >= 3")
def g21(spark: SparkSession, d: str) -> DataFrame:
    """Roles that enough neighbours have."""
    e = views.edges(spark, d).where("rel_type = 'USES_TYPE'").where(F.col("src").isin("S1", "S2", "S3"))
    p = load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("dst"), F.col("p_type").alias("role"))
    return e.join(p, "dst").groupBy("role").agg(F.countDistinct("dst").alias("hits")).where("hits >= 3")


QUERIES, ORACLES = R.queries, R.oracles
