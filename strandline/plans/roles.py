"""Queries on metrics of symbols, the roles they get, and what a change touches, over the wide graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import fans
from ..operators import graph as gr
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register

_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_CALLS = _IN(gr.CALLS)


def _metric_sql(way: str, rels, kinds) -> str:
    cond = f"way = '{way}' AND rel_type IN ({_IN(rels)})" + (f" AND kind IN ({_IN(kinds)})" if kinds else "")
    return f"coalesce(sum(confidence) FILTER (WHERE {cond}), 0)"


_ENDS = "ends AS (SELECT dst AS uid, 'in' AS way, src AS other, rel_type, kind, confidence FROM relations UNION ALL SELECT src, 'out', dst, rel_type, kind, confidence FROM relations)"
_FANS = f"""{_ENDS}, fans AS (SELECT n.uid, count(DISTINCT other) FILTER (WHERE way = 'in' AND rel_type IN ({_CALLS})) AS fan_in, count(DISTINCT other) FILTER (WHERE way = 'out' AND rel_type IN ({_CALLS})) AS fan_out,
{", ".join(f"{_metric_sql(*m)} AS {k}" for k, m in fans.METRICS.items())}, count(*) FILTER (WHERE way = 'out' AND rel_type = 'COMPOSES') AS decorator_arg_ref_count FROM (SELECT uid FROM nodes) n LEFT JOIN ends USING (uid) GROUP BY 1)"""
_KNOWN = "(SELECT uid FROM nodes)"


@register("a03_fan_metrics", f"{views.sql('nodes', 'relations')}, {_FANS} SELECT uid, fan_in, fan_out, decorator_arg_ref_count, {', '.join(f'round({k}, 6) AS {k}' for k in fans.METRICS)} FROM fans")
def a03(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of every symbol."""
    m = fans.fan_metrics(views.relations(spark, d), views.nodes(spark, d))
    return m.select("uid", *fans.COUNTS, *[F.round(k, 6).alias(k) for k in fans.METRICS])


_HANDLER = f"""handler AS (SELECT src AS uid, sum(confidence) AS handler_call_fan_out FROM relations WHERE rel_type IN ({_CALLS}) AND src IN {_KNOWN} AND dst IN {_KNOWN}
AND dst IN (SELECT dst FROM relations WHERE rel_type = 'HANDLES' GROUP BY 1 HAVING sum(confidence) > 0.05) GROUP BY 1)"""
_FLUENT = f"""fluent AS (SELECT a.src AS uid, count(DISTINCT a.dst) AS fluent_self_return_count FROM relations a JOIN relations r ON r.src = a.dst AND r.dst = a.src
WHERE a.rel_type IN ('HAS_API', 'INHERITED_API') AND r.rel_type = 'USES_TYPE' AND r.kind = 'return' AND a.src IN {_KNOWN} AND a.dst IN {_KNOWN} GROUP BY 1)"""


@register("a04_handler_fan_out", f"{views.sql('nodes', 'relations')}, {_HANDLER} SELECT uid, round(handler_call_fan_out, 6) AS handler_call_fan_out FROM handler")
def a04(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of calls to symbols that handle something."""
    return fans.handler_call_fan_out(views.relations(spark, d), views.nodes(spark, d)).select("uid", F.round("handler_call_fan_out", 6).alias("handler_call_fan_out"))


@register("a05_self_returns", f"{views.sql('nodes', 'relations')}, {_FLUENT} SELECT uid, fluent_self_return_count FROM fluent")
def a05(spark: SparkSession, d: str) -> DataFrame:
    """Methods of each owner that return the owner."""
    return fans.fluent_self_returns(views.relations(spark, d), views.nodes(spark, d))


#: Names of the packages that suppliers stand for; a part of them is plumbing.
_PACKAGES = ("kombu", "redis", "json", "logging", "requests", "typing", "numpy", "os", "click", "re", "boto3", "abc", "pandas", "sys", "httpx")
_EXTERNAL = f"external AS (SELECT DISTINCT 'P' || l_partkey AS uid, {views._sql_list(_PACKAGES)}[l_suppkey % {len(_PACKAGES)} + 1] AS root, l_linenumber AS line, 0.5::DOUBLE AS confidence FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')"
_EXT_FAN = f"""ext AS (SELECT uid, sum(confidence) AS external_call_fan_out, count(DISTINCT root) AS external_root_count, coalesce(sum(confidence) FILTER (WHERE root NOT IN ({_IN(tx.PLUMBING_ROOTS)})), 0) AS external_integration_call_fan_out,
count(DISTINCT root) FILTER (WHERE root NOT IN ({_IN(tx.PLUMBING_ROOTS)})) AS external_integration_root_count FROM external GROUP BY 1)"""


def _external(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    root = F.element_at(F.array(*map(F.lit, _PACKAGES)), (F.col("l_suppkey") % len(_PACKAGES) + 1).cast("int"))
    calls = li.select(F.concat(F.lit("P"), "l_partkey").alias("uid"), root.alias("root"), F.col("l_linenumber").alias("line")).distinct().withColumn("confidence", F.lit(0.5))
    plain = ~F.col("root").isin(*tx.PLUMBING_ROOTS)
    return calls.groupBy("uid").agg(
        F.sum("confidence").alias("external_call_fan_out"), F.countDistinct("root").alias("external_root_count"),
        F.sum(F.when(plain, F.col("confidence")).otherwise(0.0)).alias("external_integration_call_fan_out"), F.countDistinct(F.when(plain, F.col("root"))).alias("external_integration_root_count"),
    )


@register("a06_external_fan", f"WITH {_EXTERNAL}, {_EXT_FAN} SELECT * FROM ext")
def a06(spark: SparkSession, d: str) -> DataFrame:
    """Calls out of the project and the packages they go to, with and without plumbing."""
    return _external(spark, d)


#: What a profile has besides metrics, made of a part's numbers.
_FLAGS = {
    "is_proxy_binding": "size = 49", "inherits_builtin_exception": "size = 9", "returns_function_expression": "size % 7 = 0", "returns_mapping": "key % 5 = 0", "returns_constructed_type": "key % 7 = 0", "assembles_mapping_in_loop": "key % 11 = 0",
}
_NUMBERS = {"import_in": "size % 25", "reexport_in": "key % 3", "doc_anchor_count": "key % 4", "doc_definition_weight": "(key % 2) * 0.5"}
_DEPTH = f"""c AS (SELECT DISTINCT src, dst FROM relations WHERE rel_type IN ({_CALLS})), roots AS (SELECT DISTINCT src AS node FROM c WHERE src NOT IN (SELECT dst FROM relations WHERE rel_type IN ({_CALLS}) GROUP BY 1 HAVING sum(confidence) > 0.05)),
w(node, depth) AS (SELECT node, 0 FROM roots UNION SELECT dst, depth + 1 FROM w JOIN c ON src = node WHERE depth < 12), dep AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1),
cross_in AS (SELECT b.uid, count(DISTINCT a.uid) AS n FROM c JOIN nodes a ON a.uid = c.src JOIN nodes b ON b.uid = c.dst WHERE a.package <> b.package GROUP BY 1), cross_out AS (SELECT a.uid, count(DISTINCT b.uid) AS n FROM c JOIN nodes a ON a.uid = c.src JOIN nodes b ON b.uid = c.dst WHERE a.package <> b.package GROUP BY 1)"""
_PROFILE = f"""profile AS (SELECT f.*, kind, {", ".join(f"({v}) AS {k}" for k, v in (_FLAGS | _NUMBERS).items())}, coalesce(dep.depth, (SELECT max(depth) + 1 FROM dep), 0) AS depth_from_public, coalesce(i.n, 0) AS cross_package_call_in, coalesce(o.n, 0) AS cross_package_call_out,
coalesce(handler_call_fan_out, 0) AS handler_call_fan_out, coalesce(fluent_self_return_count, 0) AS fluent_self_return_count, coalesce(external_integration_call_fan_out, 0) AS external_integration_call_fan_out
FROM fans f JOIN nodes USING (uid) LEFT JOIN dep ON dep.node = uid LEFT JOIN cross_in i USING (uid) LEFT JOIN cross_out o USING (uid) LEFT JOIN handler USING (uid) LEFT JOIN fluent USING (uid) LEFT JOIN ext USING (uid)),
derived AS (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in fans.DERIVED.items())} FROM profile), l1 AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{n}'" for n, c in fans.BUCKETS)} ELSE 'unclassified' END AS bucket FROM derived)"""
_WITH = f"{views.sql('nodes', 'relations', recursive=True)}, {_FANS}, {_HANDLER}, {_FLUENT}, {_EXTERNAL}, {_EXT_FAN}, {_DEPTH}, {_PROFILE}"
_HELD = "list_filter([" + ", ".join(f"CASE WHEN ({c}){'' if b is None else f' AND bucket = {chr(39)}{b}{chr(39)}'} THEN '{r}' END" for _, (r, b, _, c) in sorted(enumerate(fans.ROLES), key=lambda x: (-x[1][2], x[0]))) + "], lambda x: x IS NOT NULL)"
_FALLBACK = "CASE bucket " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fans.FALLBACK.items()) + " END"
# A role that several rules give counts once, at its most specific rule.
_ASSIGNED = f"""held AS (SELECT uid, bucket, {_HELD} AS h FROM l1), roles AS (SELECT uid, bucket, coalesce(u[1], {_FALLBACK}) AS primary_role, coalesce(u[2:4], []) AS supporting
FROM (SELECT uid, bucket, list_filter(h, lambda x, i: list_position(h, x) = i) AS u FROM held))"""


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the rules ask for, one row a symbol."""
    e, n = gr._cut(views.relations(spark, d)), views.nodes(spark, d)
    p = fans.fan_metrics(e, n).join(n, "uid").withColumns({k: F.expr(v) for k, v in (_FLAGS | _NUMBERS).items()}).join(fans.depth_from_public(e, n), "uid")
    for more in (fans.cross_package(e, n), fans.handler_call_fan_out(e, n), fans.fluent_self_returns(e, n), _external(spark, d)):
        p = p.join(more, "uid", "left")
    whole = ["cross_package_call_in", "cross_package_call_out", "fluent_self_return_count"]
    return p.na.fill(0, whole).na.fill(0.0, ["handler_call_fan_out", "external_integration_call_fan_out"])


@register("c01_first_bucket", f"{_WITH} SELECT uid, bucket FROM l1")
def c01(spark: SparkSession, d: str) -> DataFrame:
    """The bucket of every symbol: the first rule that holds."""
    return fans.roles(profile(spark, d)).select("uid", "bucket")


@register("c02_roles", f"{_WITH}, {_ASSIGNED} SELECT uid, primary_role, supporting FROM roles")
def c02(spark: SparkSession, d: str) -> DataFrame:
    """The role of every symbol and up to three that support it."""
    return fans.roles(profile(spark, d)).select("uid", "primary_role", "supporting")


@register("a09_presence_gate", f"{_WITH}, {_ASSIGNED}, e AS (SELECT unnest(list_concat([primary_role], supporting)) AS role FROM roles) SELECT role, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 2 OR role IN ({_IN(fans.RARE)})")
def a09(spark: SparkSession, d: str) -> DataFrame:
    """Roles that enough symbols have; rare ones need one only."""
    return fans.present_roles(fans.roles(profile(spark, d)))


_SEEDS = "('P1', 'P2', 'P5')"


def _walk(name: str, types, direction: str, start: str, hops: int, fence: str) -> str:
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return f"""{name}_e AS (SELECT DISTINCT {a} AS s, {b} AS t FROM relations WHERE rel_type IN ({_IN(types)}) AND src <> dst AND {b} IN ({fence})),
{name}_w(seed, node, depth) AS (SELECT seed, node, 0 FROM ({start}) UNION SELECT seed, t, depth + 1 FROM {name}_w JOIN {name}_e ON s = node WHERE depth < {hops}),
{name}_m AS (SELECT seed, node, min(depth) AS depth FROM {name}_w GROUP BY 1, 2), {name} AS (SELECT node, min(depth) AS depth, count(DISTINCT seed) AS reach FROM {name}_m WHERE depth > 0 GROUP BY 1)"""


def _impact_sql(tests: bool, publisher: bool) -> str:
    prod = "SELECT uid FROM nodes WHERE file_path NOT LIKE 'tests/%'"
    fence = "SELECT uid FROM nodes" if tests else prod
    seeds = f"SELECT uid AS seed, uid AS node FROM nodes WHERE uid IN {_SEEDS}"
    base = gr.PUBLISHER_BASE if publisher else gr.IMPACT_BASE
    parts = [
        _walk("reverse_calls", gr.CALLS, "reverse", seeds, 3, fence),
        f"""http_endpoint_counterpart AS (SELECT b.src AS node, 1 AS depth, count(DISTINCT a.src) AS reach FROM relations a JOIN relations b ON a.dst = b.dst AND a.rel_type <> b.rel_type
WHERE a.src IN {_SEEDS} AND a.rel_type IN ({_IN(gr.ENDPOINTS)}) AND b.rel_type IN ({_IN(gr.ENDPOINTS)}) AND b.src IN ({fence}) GROUP BY 1)""",
        _walk("closure", gr.CALLS, "forward", seeds, 3, prod),
        f"""fan AS (SELECT node, count(DISTINCT src) AS fan_in FROM closure LEFT JOIN (SELECT src, dst FROM relations WHERE rel_type IN ({_CALLS}) AND src IN ({prod})) ON dst = node GROUP BY 1),
forward_calls AS (SELECT closure.* FROM closure JOIN fan USING (node) WHERE fan_in <= (SELECT greatest(2.0, 2.0 * median(fan_in)) FROM fan))""",
        _walk("tests_walk", gr.CALLS, "reverse", f"{seeds} UNION SELECT node, node FROM forward_calls", 2, fence),
        f"impacted_tests AS (SELECT * FROM tests_walk WHERE {'true' if tests else 'false'} AND node IN (SELECT uid FROM nodes WHERE file_path LIKE 'tests/%'))",
        _walk("structural_inheritor", gr.INHERITORS, "reverse", seeds, 3, fence),
        _walk("structural_api_carrier", gr.CARRIERS, "forward", seeds, 3, fence),
        _walk("forward_affects", ("AFFECTS",), "forward", seeds, 3, fence),
    ]
    union = " UNION ALL ".join(f"SELECT '{t}' AS tag, {i} AS place, {base[t]}::DOUBLE AS base, * FROM {t}" for i, t in enumerate(gr.WALKS))
    return f"""{views.sql('nodes', 'relations', recursive=True)}, {", ".join(parts)}, u AS (SELECT *, greatest(0.10, round(base - 0.08 * (depth - 1) + least(reach - 1, 9) * 0.002, 3)) AS utility FROM ({union}) WHERE node NOT IN {_SEEDS})
SELECT node, tag, depth, reach, utility FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY utility DESC, place) AS k FROM u) WHERE k = 1 ORDER BY utility DESC, node DESC LIMIT 35"""


def _impact(spark: SparkSession, d: str, **how) -> DataFrame:
    n = views.nodes(spark, d).select("uid", F.col("file_path").startswith("tests/").alias("is_test"))
    seeds = n.where(F.col("uid").isin("P1", "P2", "P5")).select(F.col("uid").alias("node"))
    return gr.impact(gr._cut(views.relations(spark, d)), n, seeds, **how)


@register("g15_impact", _impact_sql(True, False))
def g15(spark: SparkSession, d: str) -> DataFrame:
    """What a change of three symbols touches, tests included: seven walks, the best way of each node, the 35 most useful."""
    return _impact(spark, d, tests=True)


@register("g15_impact_publisher", _impact_sql(False, True))
def g15_publisher(spark: SparkSession, d: str) -> DataFrame:
    """The same outside tests, with what is called before those that call."""
    return _impact(spark, d, publisher=True)


@register("k01_traversal_order", f"""{views.sql('nodes', 'relations', recursive=True)}, {_walk("walk", gr.CALLS, "reverse", f"SELECT uid AS seed, uid AS node FROM nodes WHERE uid IN {_SEEDS}", 1, "SELECT uid FROM nodes")} SELECT node, depth, reach FROM walk ORDER BY depth, reach DESC, node LIMIT 10""")
def k01(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of a walk by depth, reach and name; it stops at the hop that has enough."""
    n = views.nodes(spark, d).select(F.col("uid").alias("node"))
    e = gr.directed(views.relations(spark, d), "reverse", gr.CALLS).join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return gr.nearest_by_order(e, n.where(F.col("node").isin("P1", "P2", "P5")).withColumn("seed", F.col("node")), 3, 10)


QUERIES, ORACLES = R.queries, R.oracles
