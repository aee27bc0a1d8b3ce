import pytest

from strandline.operators import fans
from strandline.operators import graph as gr

EDGES = "src string, dst string, rel_type string, kind string, confidence double, uid string"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, *("", 1.0)[len(r) - 3 :], "x") for r in rows], EDGES)


def nodes(spark, *names):
    return spark.createDataFrame([(n, "src") for n in names], "uid string, package string")


def metrics(spark, e, *names):
    return {r.uid: r for r in fans.fan_metrics(e, nodes(spark, *names)).collect()}


def test_fan_counts(spark):
    m = metrics(spark, edges(spark, ("a", "b", "CALLS_DIRECT"), ("a", "c", "CALLS_DIRECT"), ("b", "c", "CALLS_DIRECT"), ("b", "c", "CALLS_GUESS"), ("c", "c", "CALLS_DIRECT")), "a", "b", "c", "d")
    assert {u: (r.fan_in, r.fan_out) for u, r in m.items()} == {"a": (0, 2), "b": (1, 1), "c": (2, 0), "d": (0, 0)}
    assert m["c"].call_fan_in == 3.0 and m["d"].call_fan_in == 0.0


def test_types_by_kind_and_handlers(spark):
    m = metrics(spark, edges(spark, ("a", "b", "USES_TYPE", "param", 1.0), ("a", "b", "USES_TYPE", "isinstance", 0.5), ("deco", "handler", "HANDLES"), ("a", "x", "COMPOSES"), ("a", "y", "COMPOSES")), "a", "b", "deco", "handler")
    assert (m["b"].type_fan_in_param, m["b"].type_fan_in_isinstance, m["b"].type_fan_in, m["a"].type_fan_out) == (1.0, 0.5, 1.5, 1.5)
    assert m["deco"].handle_fan_out == m["handler"].handle_fan_in == 1.0 and m["a"].decorator_arg_ref_count == 2


def test_handlers_and_fluent_owners(spark):
    e = edges(spark, ("d", "h", "HANDLES"), ("a", "h", "CALLS_DIRECT", "", 0.9), ("a", "q", "CALLS_DIRECT"), ("Q", "m", "HAS_API"), ("Q", "n", "INHERITED_API"), ("m", "Q", "USES_TYPE", "return", 0.6), ("n", "Q", "USES_TYPE", "param", 1.0))
    n = nodes(spark, "a", "h", "q", "Q", "m", "n", "d")
    assert [tuple(r) for r in fans.handler_call_fan_out(e, n).collect()] == [("a", 0.9)]
    assert [tuple(r) for r in fans.fluent_self_returns(e, n).collect()] == [("Q", 1)]
    assert fans.fluent_self_returns(e.where("false"), n).count() == 0


def test_depth_and_packages(spark):
    e = edges(spark, *[(f"n{i}", f"n{i + 1}", "CALLS_DIRECT") for i in range(30)], ("z", "z2", "CALLS_DIRECT"), ("z2", "z", "CALLS_DIRECT"))
    d = {r.uid: r.depth_from_public for r in fans.depth_from_public(e, nodes(spark, "n0", "n30", "z", "alone")).collect()}
    assert d == {"n0": 0, "n30": 30, "z": 31, "alone": 31}, "deeper than any fixed number of hops; a cycle has no root"
    n = spark.createDataFrame([("n0", "p"), ("n1", "q"), ("n2", "q")], "uid string, package string")
    assert sorted(tuple(r) for r in fans.cross_package(e, n).collect()) == [("n0", 0, 1), ("n1", 1, 0)]


BASE = dict.fromkeys([*fans.METRICS], 0.0) | dict.fromkeys([*fans.COUNTS, "import_in", "reexport_in", "doc_anchor_count", "cross_package_call_in", "cross_package_call_out", "fluent_self_return_count"], 0) | dict.fromkeys(("doc_definition_weight", "handler_call_fan_out", "external_integration_call_fan_out"), 0.0) | dict.fromkeys(("is_proxy_binding", "inherits_builtin_exception", "returns_function_expression", "returns_mapping", "returns_constructed_type", "assembles_mapping_in_loop"), False) | {"depth_from_public": 5, "kind": "function"}


@pytest.fixture(scope="module")
def assigned(spark):
    cases = {
        "lonely": {}, "proxy": {"is_proxy_binding": True}, "handler": {"handle_fan_in": 1.0}, "caller": {"call_fan_out": 3.0, "call_fan_in": 1.0}, "leaf": {"call_fan_in": 2.0},
        "error": {"inherits_builtin_exception": True, "kind": "class", "call_fan_out": 1.0}, "config": {"kind": "class", "type_fan_in": 2.0, "type_fan_in_param": 2.0}, "contract": {"kind": "class", "depend_fan_in": 3.0},
        "gateway": {"call_fan_out": 1.0, "external_integration_call_fan_out": 2.0}, "fluent": {"kind": "class", "api_fan_out": 2.0, "fluent_self_return_count": 2},
        "router": {"call_fan_out": 2.0, "call_fan_in": 1.0, "handler_call_fan_out": 1.0},
    }
    rows = [{"uid": k} | BASE | v for k, v in cases.items()]
    df = spark.createDataFrame(rows)
    return {r.uid: r for r in fans.roles(df).collect()}, fans.roles(df)


def test_roles(assigned):
    got = {u: (r.bucket, r.primary_role) for u, r in assigned[0].items()}
    assert got == {
        "lonely": ("noise", "orphan"), "proxy": ("routing_wrap", "proxy_mechanism"), "handler": ("routing_wrap", "executor"), "caller": ("control_flow", "orchestrator"), "leaf": ("compute_leaf", "core_runtime"),
        "error": ("state_types", "error_surface"), "config": ("state_types", "config_surface"), "contract": ("state_types", "abstract_contract"), "gateway": ("boundary_integration", "integration_surface"),
        "fluent": ("state_types", "composition_surface"), "router": ("control_flow", "request_router"),
    }
    assert list(assigned[0]["leaf"].supporting) == ["executor"] and list(assigned[0]["router"].supporting) == ["orchestrator"]


def test_presence(assigned):
    n = {r.role: r.n for r in fans.present_roles(assigned[1]).collect()}
    assert n["executor"] == 2 and n["abstract_contract"] == 1 and "error_surface" not in n


def graph(spark):
    e = edges(
        spark, ("caller", "seed", "CALLS_DIRECT"), ("far", "caller", "CALLS_DIRECT"), ("seed", "next", "CALLS_DIRECT"), ("seed", "hub", "CALLS_DIRECT"), ("seed", "next2", "CALLS_DIRECT"), ("seed", "next3", "CALLS_DIRECT"), *[(f"u{i}", "hub", "CALLS_DIRECT") for i in range(9)],
        ("test_next", "next", "CALLS_DIRECT"), ("client", "E", "CALLS_ENDPOINT"), ("seed", "E", "IMPLEMENTS_ENDPOINT"), ("other", "E", "IMPLEMENTS_ENDPOINT"), ("child", "seed", "INHERITED_API"),
        ("seed", "method", "HAS_API"), ("seed", "touched", "AFFECTS"), ("caller", "touched", "AFFECTS"),
    )
    names = ["caller", "far", "seed", "next", "next2", "next3", "hub", *[f"u{i}" for i in range(9)], "test_next", "client", "other", "child", "method", "touched"]
    return e, spark.createDataFrame([(n, n.startswith("test")) for n in names], "uid string, is_test boolean"), spark.createDataFrame([("seed", "x")], "node string, tag string")


def test_impact_has_seven_walks(spark):
    e, n, s = graph(spark)
    got = {r.node: (r.tag, r.depth, r.utility) for r in gr.impact(e, n, s, tests=True).collect()}
    assert got == {
        "caller": ("reverse_calls", 1, 0.95), "far": ("reverse_calls", 2, 0.87), "client": ("http_endpoint_counterpart", 1, 0.92), "next": ("forward_calls", 1, 0.9), "next2": ("forward_calls", 1, 0.9), "next3": ("forward_calls", 1, 0.9), "test_next": ("impacted_tests", 1, 0.8),
        "child": ("structural_inheritor", 1, 0.82), "method": ("structural_api_carrier", 1, 0.86), "touched": ("forward_affects", 1, 0.58),
    }, "the hub is no spine, nor is another implementation a counterpart"


def test_impact_without_tests_and_for_publishers(spark):
    e, n, s = graph(spark)
    assert "test_next" not in {r.node for r in gr.impact(e, n, s).collect()}
    got = {r.node: r.utility for r in gr.impact(e, n, s, publisher=True, limit=2).collect()}
    assert got == {"next3": 0.95, "next2": 0.95}
    assert gr.impact(e, n, s.where("false")).count() == 0


def test_order_and_early_stop(spark):
    e = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b"), ("b", "c")], "src string, dst string")
    s = spark.createDataFrame([("s", "s"), ("t", "t")], "seed string, node string")
    assert [tuple(r) for r in gr.nearest_by_order(e, s, 3, 2).collect()] == [("b", 1, 2), ("a", 1, 1)]
    assert [r.node for r in gr.nearest_by_order(e, s, 3, 9).collect()] == ["b", "a", "c"]
