"""Structural metrics of symbols from typed edges, and the roles that rules give them.

All metrics of a symbol are one conditional aggregation over its edges: every edge is sent once to each of its ends, partial sums are made
before the shuffle. Rules are a table of conditions over the metrics, written in plain SQL expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ANY_HOPS, reach

#: Confidence of an edge that states none, by relation, and weight of a use of a type by its kind.
CONFIDENCE = {
    "CALLS_DIRECT": 1.0, "CALLS_SCOPED": 0.9, "CALLS_IMPORTED": 0.85, "CALLS_DYNAMIC": 0.7, "CALLS_INFERRED": 0.7, "CALLS_GUESS": 0.4, "CALLS": 0.85, "DEPENDS_ON": 0.9,
    "HAS_API": 0.95, "INHERITED_API": 0.9, "INJECTS": 0.85,
}
TYPE_WEIGHT = {"param": 1.0, "annotation": 0.8, "return": 0.6, "isinstance": 0.5}
#: Fixed value: what a metric must exceed to count as present.
EPS = 0.05

#: Metrics by the end of the edge they belong to: name, relations, kinds (none: all).
_CALLS = ("CALLS", "CALLS_DIRECT", "CALLS_SCOPED", "CALLS_IMPORTED", "CALLS_DYNAMIC", "CALLS_INFERRED", "CALLS_GUESS")
_API = ("HAS_API", "INHERITED_API")
METRICS: Mapping[str, tuple[str, Sequence[str], Sequence[str]]] = {
    "call_fan_in": ("in", _CALLS, ()), "call_fan_out": ("out", _CALLS, ()), "type_fan_in": ("in", ("USES_TYPE",), ()), "type_fan_out": ("out", ("USES_TYPE",), ()),
    "type_fan_in_param": ("in", ("USES_TYPE",), ("param", "annotation")), "type_fan_in_isinstance": ("in", ("USES_TYPE",), ("isinstance",)),
    "type_fan_in_return": ("in", ("USES_TYPE",), ("return",)), "type_fan_out_return": ("out", ("USES_TYPE",), ("return",)), "api_fan_in": ("in", _API, ()), "api_fan_out": ("out", _API, ()),
    "inject_fan_in": ("in", ("INJECTS",), ()), "depend_fan_in": ("in", ("DEPENDS_ON",), ()), "depend_fan_out": ("out", ("DEPENDS_ON",), ()), "handle_fan_in": ("in", ("HANDLES",), ()),
    "handle_fan_out": ("out", ("HANDLES",), ()), "decorated_in": ("in", ("DECORATED_BY",), ()), "decorated_out": ("out", ("DECORATED_BY",), ()), "construct_fan_out": ("out", ("INSTANTIATES",), ()),
    "proxy_context_bind_fan_out": ("out", ("RESOLVES_ATTR",), ()), "attr_reads_fan_out": ("out", ("READS_ATTR",), ()), "attr_writes_fan_out": ("out", ("WRITES_ATTR",), ()),
    "attr_writes_subscript_fan_out": ("out", ("WRITES_ATTR",), ("write_subscript", "write_subscript_local")),
}
COUNTS = ("fan_in", "fan_out", "decorator_arg_ref_count")


def confidence(rel_type: Column, stored: Column, kind: Column) -> Column:
    """The weight of a use of a type by its kind; else what is stored, else the relation's own, else 1."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.when(rel_type == "USES_TYPE", F.coalesce(table(TYPE_WEIGHT)[kind], F.lit(1.0))).otherwise(F.coalesce(stored, table(CONFIDENCE)[rel_type], F.lit(1.0)))


def fan_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uid`` and the 25 metrics of every node (uid), zeros kept. ``edges``: src, dst, rel_type, kind, confidence; an edge to itself counts for nothing.

    fan_in and fan_out are numbers of distinct callers and callees, decorator_arg_ref_count one of edges, all others sums of confidences.
    """
    e = edges.where("src <> dst")
    ends = e.select(
        F.explode(F.array(F.struct(F.col("src").alias("uid"), F.lit("out").alias("way"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("uid"), F.lit("in").alias("way"), F.col("src").alias("other")))).alias("x"),
        "rel_type", "kind", "confidence",
    ).select("x.*", "rel_type", "kind", "confidence")
    # Calls of one pair under several relations are one caller: first by pair, then by node, so that no task counts distinct values of a hub.
    pair = ends.groupBy("uid", "way", "other", "rel_type", "kind").agg(F.sum("confidence").alias("c"), F.count("*").alias("n"))
    first = F.when(F.col("rel_type").isin(*_CALLS), F.col("rel_type"))
    least = pair.groupBy("uid", "way", "other").agg(F.min(first).alias("call"), *[_sum(w, r, k).alias(m) for m, (w, r, k) in METRICS.items()], F.sum(F.when((F.col("rel_type") == "COMPOSES") & (F.col("way") == "out"), F.col("n")).otherwise(0)).alias("decorator_arg_ref_count"))
    called = F.col("call").isNotNull()
    total = least.groupBy("uid").agg(
        F.count(F.when(called & (F.col("way") == "in"), 1)).alias("fan_in"), F.count(F.when(called & (F.col("way") == "out"), 1)).alias("fan_out"),
        *[F.sum(m).alias(m) for m in METRICS], F.sum("decorator_arg_ref_count").alias("decorator_arg_ref_count"),
    )
    return nodes.select("uid").join(total, "uid", "left").na.fill(0, [*COUNTS]).na.fill(0.0, [*METRICS])


def _sum(way: str, rels: Sequence[str], kinds: Sequence[str]) -> Column:
    cond = (F.col("way") == way) & F.col("rel_type").isin(*rels)
    if kinds:
        cond = cond & F.col("kind").isin(*kinds)
    return F.sum(F.when(cond, F.col("c")).otherwise(0.0))


def handler_call_fan_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uid, handler_call_fan_out``: confidence of a node's calls to nodes that handle something; both ends must be in ``nodes``."""
    known = nodes.select("uid")
    handled = edges.where("rel_type = 'HANDLES' and src <> dst").groupBy(F.col("dst").alias("uid")).agg(F.sum("confidence").alias("h")).where(F.col("h") > EPS).join(known, "uid", "left_semi").select(F.col("uid").alias("dst"))
    calls = edges.where(F.col("rel_type").isin(*_CALLS)).join(handled, "dst", "left_semi").select(F.col("src").alias("uid"), "confidence").join(known, "uid", "left_semi")
    return calls.groupBy("uid").agg(F.sum("confidence").alias("handler_call_fan_out"))


def fluent_self_returns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uid, fluent_self_return_count``: how many of the methods that an owner exposes return the owner."""
    known = nodes.select("uid")
    api = edges.where(F.col("rel_type").isin(*_API)).select(F.col("src").alias("owner"), F.col("dst").alias("method")).distinct()
    returns = edges.where("rel_type = 'USES_TYPE' and kind = 'return'").select(F.col("src").alias("method"), F.col("dst").alias("owner")).distinct()
    both = api.join(returns, ["owner", "method"])
    both = both.join(known.withColumnRenamed("uid", "owner"), "owner", "left_semi").join(known.withColumnRenamed("uid", "method"), "method", "left_semi")
    return both.groupBy(F.col("owner").alias("uid")).agg(F.count("*").alias("fluent_self_return_count"))


def cross_package(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uid, cross_package_call_in, cross_package_call_out``: distinct callers and callees of another package; ``nodes``: uid, package."""
    n = nodes.select("uid", "package")
    calls = edges.where(F.col("rel_type").isin(*_CALLS) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    j = calls.join(n.select(F.col("uid").alias("src"), F.col("package").alias("a")), "src").join(n.select(F.col("uid").alias("dst"), F.col("package").alias("b")), "dst").where("a <> b")
    ends = j.select(F.explode(F.array(F.struct(F.col("src").alias("uid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("uid"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.uid").agg(F.sum("x.i").alias("cross_package_call_in"), F.sum("x.o").alias("cross_package_call_out"))


def depth_from_public(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``uid, depth_from_public``: calls from the nearest root (something that calls and that nobody calls); unreachable ones get the greatest depth and one."""
    calls = edges.where(F.col("rel_type").isin(*_CALLS) & (F.col("src") != F.col("dst")))
    called = calls.groupBy(F.col("dst").alias("node")).agg(F.sum("confidence").alias("c")).where(F.col("c") > EPS)
    roots = calls.select(F.col("src").alias("node")).distinct().join(called, "node", "left_anti")
    d = reach(calls.select("src", "dst").distinct(), roots.select(F.lit("*").alias("seed"), "node"), ANY_HOPS).select(F.col("node").alias("uid"), "depth")
    far = d.agg(F.max("depth")).first()[0]
    return nodes.select("uid").join(d, "uid", "left").select("uid", F.coalesce("depth", F.lit(0 if far is None else far + 1)).alias("depth_from_public"))


#: The first rule that holds names the bucket of a symbol. Conditions are over the profile's columns.
_OWNER = "(api_fan_out > 0.05 or (is_class and has_documentation) or reexport_in > 0.05)"
_FACTORY = "(construct_fan_out >= 2 and type_fan_out_return > 0.05)"
BUCKETS: Sequence[tuple[str, str]] = (
    ("noise", f"zero_in_degree and call_fan_out <= 0.05 and not {_OWNER} and not is_proxy_binding and not {_FACTORY}"),
    ("routing_wrap", "is_proxy_binding or handle_fan_in > 0.05 or handle_fan_out > 0.05 or decorated_in > 0.05"),
    ("state_types", "inherits_builtin_exception or type_fan_in > greatest(0.05, call_fan_out) or depend_fan_in > greatest(0.05, call_fan_out)"),
    ("state_types", "(is_class and (type_fan_in > 0.05 or depend_fan_in > 0.05 or api_fan_in > 0.05 or api_fan_out > 0.05)) or api_fan_out > 0.05"),
    ("boundary_integration", "external_integration_call_fan_out > 0.05 and type_fan_in <= greatest(0.05, call_fan_out * 2.0) and call_fan_out > call_fan_in and external_integration_out_ratio >= 0.35"),
    ("control_flow", f"(call_fan_out > call_fan_in and call_fan_out > 0.05) or {_FACTORY}"),
    ("compute_leaf", "call_fan_in > 0.05 and call_leaf"),
    ("control_flow", "(call_fan_in > 0.05 or call_fan_out > 0.05) and call_fan_out >= call_fan_in"),
    ("compute_leaf", "call_fan_in > 0.05 or call_fan_out > 0.05"),
)
#: Role, bucket (None: any), specificity, condition.
ROLES: Sequence[tuple[str, str | None, int, str]] = (
    ("proxy_mechanism", "routing_wrap", 90, "is_proxy_binding"),
    ("interceptor", "routing_wrap", 85, "decorated_in > 0.05 and handle_fan_out <= 0.05 and type_fan_in_param < greatest(1.0, call_fan_in)"),
    ("registration_step", "routing_wrap", 85, "handle_fan_out > 0.05"),
    ("executor", "routing_wrap", 70, "handle_fan_in > 0.05"),
    ("composition_surface", "routing_wrap", 78, "is_class and decorator_arg_ref_count >= 3"),
    ("factory_surface", "routing_wrap", 86, "returns_function_expression and handle_fan_out > 0.05"),
    ("dependency_solver", "control_flow", 72, "type_fan_in_isinstance > 0.05 or inject_fan_in > 0.05 or (type_fan_out > 0.05 and cross_package_call_out >= 2.0 and import_in >= 20 and depth_from_public >= 2)"),
    ("request_router", "control_flow", 78, "handle_fan_out <= 0.05 and handle_fan_in <= 0.05 and call_fan_in >= 1.0 and handler_call_fan_out > 0.05"),
    ("api_surface", "control_flow", 77, "depth_from_public <= 1 and call_fan_out > call_fan_in and ((has_documentation and (api_fan_in > 0.05 or doc_definition_weight > 0)) or import_in >= 10)"),
    ("registration_step", "control_flow", 74, "depth_from_public <= 1 and call_fan_out > call_fan_in and construct_fan_out > 0.05 and import_in >= 10"),
    ("composition_surface", "control_flow", 66, "call_fan_out > call_fan_in and cross_package_call_out >= 1.0 and import_in >= 2"),
    ("orchestrator", "control_flow", 70, "call_fan_out > call_fan_in and call_fan_out > 0.05"),
    ("factory_surface", "control_flow", 65, "((construct_fan_out > 0.05 or type_fan_out_return > 0.05) and call_fan_out > 0.05) or (construct_fan_out >= 2 and type_fan_out_return > 0.05)"),
    ("schema_builder", "control_flow", 71, "call_fan_out > 0.05 and ((type_fan_in > 0.05 and type_fan_in_return <= 0.05) or (construct_fan_out > 0.05 and depth_from_public <= 1) or (type_fan_out > 0.05 and call_fan_out > call_fan_in and import_in >= 20))"),
    ("binding_surface", "control_flow", 73, "call_fan_out > call_fan_in and type_fan_out > 0.05 and cross_package_call_out >= 1.0 and import_in >= 20 and depth_from_public >= 2"),
    ("binding_surface", "control_flow", 75, "is_function and assembles_mapping_in_loop and attr_reads_fan_out >= 1.0 and call_fan_out > 0.05"),
    ("binding_surface", "control_flow", 75, "is_function and (returns_mapping or returns_constructed_type) and attr_reads_fan_out >= 3.0 and call_fan_out > 0.05"),
    ("runtime_surface", "control_flow", 71, "call_fan_in > 0.05 and call_fan_out > 0.05 and depth_from_public <= 2 and import_in >= 10"),
    ("integration_surface", "boundary_integration", 80, "external_integration_call_fan_out > 0.05"),
    ("integration_surface", None, 68, "external_integration_call_fan_out > 1.5"),
    ("error_surface", "state_types", 88, "inherits_builtin_exception"),
    ("abstract_contract", "state_types", 85, "is_class and depend_fan_in > greatest(0.05, type_fan_in_param * 1.5) and call_fan_in <= 0.05"),
    ("config_surface", "state_types", 80, "is_class and not (reexport_in > 0.05 and api_fan_out > 0.05 and call_fan_in > 0.05) and (type_fan_in_param > greatest(0.05, call_fan_in) or (type_fan_in_param <= 0.05 and depend_fan_in > 0.05 and type_fan_in_isinstance > 0.05 and type_fan_in <= greatest(1.0, call_fan_in)))"),
    ("representation_surface", "state_types", 75, "is_class and type_fan_in > greatest(0.05, call_fan_out * 2.0)"),
    ("api_surface", "state_types", 70, "(depth_from_public <= 1 and has_documentation and (api_fan_in > 0.05 or doc_definition_weight > 0)) or (depth_from_public <= 1 and api_fan_out > 0.05) or (is_function and depth_from_public <= 1 and depend_fan_in > 0.05 and call_fan_out > 0.05) or (is_class and reexport_in > 0.05 and api_fan_out > 0.05)"),
    ("registration_step", "state_types", 68, "is_class and reexport_in > 0.05 and api_fan_out > 0.05 and call_fan_in > 0.05"),
    ("dependency_solver", "state_types", 67, "(is_function and depend_fan_in > 0.05 and depth_from_public <= 1) or (is_class and type_fan_in_isinstance > 0.05)"),
    ("runtime_surface", "state_types", 69, "is_class and call_fan_in > 0.05 and (type_fan_in_param > 0.05 or reexport_in > 0.05)"),
    ("composition_surface", "state_types", 76, "(is_class and (decorator_arg_ref_count >= 3 or fluent_self_return_count >= 2)) or (api_fan_out >= 3 and api_fan_out > type_fan_in)"),
    ("executor", "compute_leaf", 85, "handle_fan_in > 0.05"),
    ("request_router", "compute_leaf", 78, "handle_fan_out <= 0.05 and handle_fan_in <= 0.05 and call_fan_in >= 1.0 and handler_call_fan_out > 0.05"),
    ("validator_handle", "compute_leaf", 80, "type_fan_in > 0.05 and call_fan_in > 0.05 and handle_fan_in <= 0.05"),
    ("core_runtime", "compute_leaf", 75, "call_fan_in > 0.05 and call_leaf and handle_fan_in <= 0.05 and type_fan_in <= greatest(1.0, call_fan_in)"),
    ("runtime_surface", "compute_leaf", 72, "call_fan_in > 0.05 and not call_leaf and depth_from_public <= 2 and import_in >= 8"),
    ("executor", "compute_leaf", 60, "call_leaf and call_fan_in > 0.05 and is_function"),
)
#: The role of a bucket whose rules all fail; roles that one symbol is enough for, besides at least two for the rest.
FALLBACK = {
    "routing_wrap": "runtime_surface", "control_flow": "orchestrator", "state_types": "representation_surface", "boundary_integration": "integration_surface", "compute_leaf": "core_runtime",
    "noise": "orphan", "unclassified": "supporting_surface",
}
SUPPORTING, MIN_SUPPORT = 3, 2
RARE = ("proxy_mechanism", "interceptor", "abstract_contract", "registration_step", "request_router", "dependency_solver", "schema_builder", "integration_surface")
#: Columns of a profile that follow from others.
DERIVED = {
    "is_class": "kind in ('class', 'interface')", "is_function": "kind in ('function', 'method')", "has_documentation": "doc_anchor_count > 0 or doc_definition_weight > 0", "call_leaf": "call_fan_out <= 0.05",
    "zero_in_degree": "greatest(call_fan_in, type_fan_in, api_fan_in, inject_fan_in, depend_fan_in, handle_fan_in, decorated_in) <= 0.05",
    "external_integration_out_ratio": "external_integration_call_fan_out / (call_fan_out + external_integration_call_fan_out + 0.05)",
}


def bucket() -> Column:
    """The first of ``BUCKETS`` that holds; unclassified if none does."""
    out = F.when(F.lit(False), "")
    for name, cond in BUCKETS:
        out = out.when(F.expr(cond), name)
    return out.otherwise("unclassified")


def roles(profile: DataFrame) -> DataFrame:
    """``uid, bucket, primary_role, supporting``: of all rules of a symbol's bucket that hold, the most specific names its role, the next three others support it."""
    rules = sorted(enumerate(ROLES), key=lambda r: (-r[1][2], r[0]))
    held = F.array_compact(F.array(*[F.when(F.expr(cond) & (F.lit(True) if b is None else F.col("bucket") == b), F.lit(role)) for _, (role, b, _, cond) in rules]))
    fallback = F.create_map(*[F.lit(x) for kv in FALLBACK.items() for x in kv])[F.col("bucket")]
    p = profile.withColumns({k: F.expr(v) for k, v in DERIVED.items()}).withColumn("bucket", bucket()).withColumn("held", F.array_distinct(held))
    return p.select("uid", "bucket", F.coalesce(F.get("held", F.lit(0)), fallback).alias("primary_role"), F.slice("held", 2, SUPPORTING).alias("supporting"))


def present_roles(assigned: DataFrame) -> DataFrame:
    """``role, n``: roles that enough symbols have, as primary or supporting one."""
    each = assigned.select(F.explode(F.concat(F.array("primary_role"), "supporting")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))
    return each.where((F.col("n") >= MIN_SUPPORT) | F.col("role").isin(*RARE))
