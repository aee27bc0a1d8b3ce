"""Graph operators by frontier joins.

A walk keeps (seed, node) pairs and advances all seeds at once; each hop is a join with the edges, a distinct, and an anti-join against what is
visited. Hops are checkpointed to the shared folder, which cuts the lineage and survives a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir
from ..sources.tables import python_partitions
from .lookups import top_by
from .ranking import quantile


#: Hops without a bound: a walk ends when its frontier is empty.
ANY_HOPS = 1 << 30


def directed(edges: DataFrame, direction: str, types: Sequence[str] | None = None) -> DataFrame:
    """``src, dst`` of the edges of ``types``, forward, reverse or undirected; each pair once, no loops."""
    e = edges.where(F.col("rel_type").isin(*types)) if types else edges
    fwd, rev = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"forward": fwd, "reverse": rev, "undirected": fwd.unionByName(rev)}[direction].where("src <> dst").distinct()


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hold(edges: DataFrame) -> DataFrame:
    """The edges written once, by source, for an iteration that joins with them again and again."""
    return _cut(edges.repartition("src"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, stop: DataFrame | None = None, held: bool = False) -> DataFrame:
    """``seed, node, depth``: the nodes within ``hops`` of each seed (``seeds``: seed, node), depth 0 included.

    ``edges`` as from directed(); for several hops they are held unless the caller did that already (``held``). Nodes in ``stop`` (node) are
    reached but not walked through. Ends early when a frontier is empty.
    """
    if not isinstance(hops, int) or isinstance(hops, bool) or hops < 1:
        raise ValueError("hops must be an integer of at least 1")
    if hops > 1 and not held:
        edges = hold(edges)
    seen = frontier = _cut(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        start = frontier if stop is None or depth == 1 else frontier.join(stop, "node", "left_anti")
        step = start.join(edges, start["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def walk(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``node, depth, reach``: least depth and number of seeds; a seed counts where another seed reaches it, never for itself."""
    return reach(edges, seeds, hops).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("reach"))


def walk_grouped(edges: DataFrame, seeds: DataFrame, hops: int, limit: int) -> DataFrame:
    """``seed, node, depth``: each seed's nearest ``limit`` nodes, by depth and name; ``seeds`` may have its own ``limit`` column."""
    near = reach(edges, seeds, hops).where("depth > 0")
    most: int | object = limit
    if "limit" in seeds.columns:
        near = near.join(seeds.select("seed", "limit").distinct(), "seed", "left")
        most = F.coalesce("limit", F.lit(limit))
    return top_by(near, ["seed"], [F.col("depth"), F.col("node")], most).select("seed", "node", "depth")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree_in, degree_out``: distinct edges by end, over one explode instead of two aggregations and a join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("degree_in"), F.sum("e.o").alias("degree_out"))


def hub_gate(nodes: DataFrame, fan_in: DataFrame, factor: float = 2.0) -> DataFrame:
    """``nodes`` (node) without hubs: those of a fan-in above max(2, factor x median); ``fan_in``: node, fan_in, absent is 0."""
    f = nodes.join(fan_in, "node", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return f.where(F.col("fan_in") <= max(2.0, factor * (quantile(f, F.col("fan_in"), 0.5) or 0.0)))


def depth_from_roots(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, depth``: hops from the nearest root (node), however many; unreachable nodes get the greatest depth and one."""
    d = reach(edges, roots.select(F.lit("*").alias("seed"), "node"), ANY_HOPS).select("node", "depth")
    far = d.agg((F.max("depth") + 1).alias("far"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("depth", far.scalar()).alias("depth"))


def closure_bounded(edges: DataFrame, sources: DataFrame, levels: int = 4, per_level: int = 200) -> DataFrame:
    """``source, node, depth``: breadth-first reverse closure, at each level only the first ``per_level`` nodes in order of discovery.

    ``edges``: src depends on dst, so the closure of a source goes from dst to src. Discovery is ordered by the parent's place in its level, then by
    name; a node met from several parents takes the first place. What is cut off is not walked from and may be found later.
    """
    e = hold(directed(edges, "reverse")).select(F.col("src").alias("__from"), F.col("dst").alias("__to"))
    seen = frontier = _cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumns({"depth": F.lit(0), "place": F.lit(1)}))
    for depth in range(1, levels + 1):
        met = frontier.join(e, F.col("node") == F.col("__from")).groupBy("source", F.col("__to").alias("node")).agg(F.min("place").alias("parent"))
        met = met.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        ranked = met.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("parent", "node"))).where(F.col("place") <= per_level)
        frontier = _cut(ranked.select("source", "node", F.lit(depth).alias("depth"), "place"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").select("source", "node", "depth")


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 6) -> DataFrame:
    """``position, node``: one shortest undirected path; no rows if there is none within ``most`` hops.

    Two breadth-first walks meet in the middle, at the least of the nodes where they can; from there each step goes to the least neighbour
    that is one nearer to its end, which any such neighbour's path completes.
    """
    spark = edges.sparkSession
    e = hold(directed(edges, "undirected"))
    r = reach(e, spark.createDataFrame([("a", start), ("b", goal)], "seed string, node string"), (most + 1) // 2, held=True)
    side = {s: r.where(F.col("seed") == s).select("node", "depth") for s in "ab"}
    both = side["a"].withColumnRenamed("depth", "da").join(side["b"].withColumnRenamed("depth", "db"), "node")
    meet = both.select(F.min(F.struct((F.col("da") + F.col("db")).alias("n"), "node", "da", "db")).alias("m")).first()["m"]
    if meet is None or meet["n"] > most:
        return spark.createDataFrame([], "position int, node string")
    found = {meet["da"]: meet["node"]}
    for s, steps, sign in (("a", meet["da"], -1), ("b", meet["db"], 1)):
        here = meet["node"]
        for left in range(steps - 1, -1, -1):
            nearer = e.where(F.col("src") == here).join(side[s].where(F.col("depth") == left), F.col("dst") == F.col("node"))
            here = nearer.agg(F.min("node")).first()[0]
            found[meet["da"] + sign * (steps - left)] = here
    return spark.createDataFrame(sorted(found.items()), "position int, node string")


def propagate(edges: DataFrame, flagged: DataFrame, rounds: int = 6) -> DataFrame:
    """``node``: the flagged nodes and all that reach one along the edges (src inherits from dst) within ``rounds``; ends at the fixed point."""
    return reach(directed(edges, "reverse"), flagged.select(F.lit("*").alias("seed"), "node"), rounds).select("node")


#: Fixed value: what a primary gains for each other role near it.
ROLE_BOOST = 0.15


def cross_role(edges: DataFrame, primary: DataFrame, secondary: DataFrame, hops: int = 2, keep_all: bool = False) -> DataFrame:
    """``node, roles, boost``: of the primary candidates (node) those within ``hops`` of other roles' candidates (node, role), raised by the number of roles.

    ``edges`` as from directed(). If none is near, all are given back without a boost; ``keep_all`` gives the others too.
    """
    near = reach(edges, secondary.select(F.col("role").alias("seed"), "node"), hops)
    hit = near.join(primary.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.countDistinct("seed").alias("roles"))
    hit = _cut(hit)
    if keep_all or hit.isEmpty():
        hit = primary.select("node").distinct().join(hit, "node", "left").withColumn("roles", F.coalesce("roles", F.lit(0)))
    return hit.withColumn("boost", F.round(ROLE_BOOST * F.col("roles"), 2))


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, out, inn``: maps from relation to the sorted neighbours, in either direction."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way"), F.col("rel_type").alias("t"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way"), F.col("rel_type").alias("t"), F.col("src").alias("other")))).alias("e")).select("e.*")
    lists = ends.groupBy("node", "way", "t").agg(F.sort_array(F.collect_set("other")).alias("others"))
    pick = lambda way: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("way") == way, F.struct("t", "others")))))
    return lists.groupBy("node").agg(pick("out").alias("out"), pick("in").alias("inn"))


#: Utility of a change's neighbours by how they were reached, as usual and when the question is about what is published.
IMPACT_BASE = {"reverse_calls": 0.95, "http_endpoint_counterpart": 0.92, "forward_calls": 0.90, "structural_api_carrier": 0.86, "structural_inheritor": 0.82, "impacted_tests": 0.80, "forward_affects": 0.58}
PUBLISHER_BASE = IMPACT_BASE | {"forward_calls": 0.95, "reverse_calls": 0.90}
#: Relations of the walks.
CALLS = ("CALLS", "CALLS_DIRECT", "CALLS_SCOPED", "CALLS_IMPORTED", "CALLS_DYNAMIC", "CALLS_INFERRED", "CALLS_GUESS")
INHERITORS, CARRIERS, ENDPOINTS = ("EXTENDS_EXTERNAL", "INHERITED_API"), ("HAS_API",), ("CALLS_ENDPOINT", "IMPLEMENTS_ENDPOINT")


#: Seeds of a block, a bit each in its words of 64; shares into which seeds are dealt; rows of words that are broadcast at a time; groups that a task adds up, about.
BLOCK, SHARES, WORD_ROWS, GROUPS = 1024, 8, 100_000, 250_000


def counterparts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, depth, reach``: what meets a seed (node) at an endpoint from the other side: client and handler, never two of a kind.

    A seed is a bit of a block's words, and each endpoint's side has the words of its seeds: a node's seeds are counted in the union of those, so that pairs of node
    and seed are never rows. Nodes with the same ends are counted as one. Words are broadcast in turns of about ``WORD_ROWS`` rows, by block.
    """
    side = F.col("rel_type") == ENDPOINTS[0]
    e = edges.where(F.col("rel_type").isin(*ENDPOINTS) & F.col("dst").isNotNull()).select("src", F.concat(F.when(side, "0").otherwise("1"), "dst").alias("end"), F.concat(F.when(side, "1").otherwise("0"), "dst").alias("other")).distinct()
    mine = e.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi").withColumn("share", F.pmod(F.xxhash64("src"), F.lit(SHARES)))
    bit = mine.withColumn("n", F.dense_rank().over(W.partitionBy("share").orderBy("src")) - 1).select(F.col("other").alias("end"), "share", F.expr(f"n div {BLOCK}").alias("block"), F.expr(f"n % {BLOCK} div 64").alias("word"), F.expr("shiftleft(1L, n % 64)").alias("bit"))
    words = [f"w{i}" for i in range(BLOCK // 64)]
    held = _cut(bit.groupBy("end", "share", "block").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(w) for i, w in enumerate(words)]))
    rows, blocks = held.count(), held.select("share", "block").distinct().count()
    known = held.select("end").distinct()
    met = e.join(F.broadcast(known) if rows <= WORD_ROWS else known, "end", "left_semi")
    ends = _cut(met.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("end")).alias("ends")))
    alike = ends.select("ends")
    turns, parts = max(1, math.ceil(rows / WORD_ROWS)), max(python_partitions(edges.sparkSession), math.ceil(alike.distinct().count() * blocks / GROUPS))
    # Named outright and before the distinct: a few bytes a node here are many groups behind.
    each = alike.repartition(parts, "ends").distinct().select("ends", F.explode("ends").alias("end"))
    counts = None
    for turn in range(turns):
        part = held if turns == 1 else held.where(F.pmod(F.hash("share", "block"), F.lit(turns)) == turn)
        one = each.join(F.broadcast(part), "end").groupBy("ends", "share", "block").agg(*[F.bit_or(w).alias(w) for w in words])
        one = one.select("ends", F.expr(" + ".join(f"bit_count({w})" for w in words)).cast("long").alias("seen"))
        counts = one if counts is None else counts.unionByName(one)
    return ends.join(counts.groupBy("ends").agg(F.sum("seen").alias("reach")), "ends").select("node", F.lit(1).alias("depth"), "reach")


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 3, limit: int = 35, tests: bool = False, test_hops: int = 2, factor: float = 2.0, publisher: bool = False) -> DataFrame:
    """``node, tag, depth, reach, utility``: what a change of the seeds (node) touches, the best way of each node, the most useful ``limit``.

    ``edges``: src, dst, rel_type; ``nodes``: uid, is_test. Seven walks: callers; the other side of endpoints; callees without hubs (the spine); tests that
    call a seed or the spine, only with ``tests``; inheritors; carriers of the API; and what is known to be affected. Without ``tests`` no walk passes
    through a test. Utility falls with depth and rises a little with the number of seeds; equal ones go by the greater node.
    Edges are prepared and written once for each group of relations and shared by its walks.
    """
    edges = edges.select("src", "dst", "rel_type")
    known = nodes.select(F.col("uid").alias("node"), "is_test")
    production = known.where("not is_test").select("node")
    s = seeds.select("node").distinct()
    s = s.withColumn("seed", F.col("node"))

    def fenced(e: DataFrame, keep_tests: bool) -> DataFrame:
        ends = known.select("node") if keep_tests else production
        return e.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")

    def of(types: Sequence[str], direction: str, keep_tests: bool) -> DataFrame:
        return hold(fenced(directed(edges, direction, types), keep_tests))

    def walked(e: DataFrame, start: DataFrame, n: int) -> DataFrame:
        return reach(e, start, n, held=True).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("reach"))

    callers = of(CALLS, "reverse", tests)
    ways = {"reverse_calls": walked(callers, s, hops), "http_endpoint_counterpart": counterparts(edges, s).join(known.select("node") if tests else production, "node", "left_semi")}
    closure = walked(of(CALLS, "forward", False), s, hops)
    # Callers outside tests, counted for the nodes of the closure only.
    fan = edges.where(F.col("rel_type").isin(*CALLS) & (F.col("src") != F.col("dst"))).join(closure.select(F.col("node").alias("dst")), "dst", "left_semi").join(production.withColumnRenamed("node", "src"), "src", "left_semi")
    fan = fan.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    spine = _cut(hub_gate(closure, fan, factor).drop("fan_in"))
    ways["forward_calls"] = spine
    if tests:
        anchor = s.select("node", "seed").unionByName(spine.select("node", F.col("node").alias("seed"))).distinct()
        ways["impacted_tests"] = walked(callers, anchor, test_hops).join(known.where("is_test").select("node"), "node", "left_semi")
    ways["structural_inheritor"] = walked(of(INHERITORS, "reverse", tests), s, hops)
    ways["structural_api_carrier"] = walked(of(CARRIERS, "forward", tests), s, hops)
    ways["forward_affects"] = walked(of(("AFFECTS",), "forward", tests), s, hops)
    every = None
    for tag, w in ways.items():
        w = w.select("node", "depth", "reach").withColumn("tag", F.lit(tag))
        every = w if every is None else every.unionByName(w)
    return best_ways(every.join(s.select("node"), "node", "left_anti"), limit, publisher)


def best_ways(reached: DataFrame, limit: int = 35, publisher: bool = False) -> DataFrame:
    """``node, tag, depth, reach, utility``: the best way each node was reached (node, tag, depth, reach), and of these the most useful ``limit``."""
    table = PUBLISHER_BASE if publisher else IMPACT_BASE
    base = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    u = F.coalesce(base[F.col("tag")], F.lit(0.5)) - 0.08 * F.greatest(F.col("depth") - 1, F.lit(0)) + F.least(F.greatest("reach", F.lit(1)) - 1, F.lit(9)) * 0.002
    scored = reached.withColumn("utility", F.greatest(F.lit(0.10), F.round(u, 3)))
    place = F.create_map(*[F.lit(x) for i, t in enumerate(WALKS) for x in (t, i)])[F.col("tag")]
    best = top_by(scored, ["node"], [F.desc("utility"), place], 1)
    return best.orderBy(F.desc("utility"), F.desc("node")).limit(limit).select("node", "tag", "depth", "reach", "utility")


#: The order of the walks, which decides between equal utilities.
WALKS = ("reverse_calls", "http_endpoint_counterpart", "forward_calls", "impacted_tests", "structural_inheritor", "structural_api_carrier", "forward_affects")


def nearest_by_order(edges: DataFrame, seeds: DataFrame, hops: int, limit: int) -> DataFrame:
    """``node, depth, reach``: the first ``limit`` nodes of a walk by depth, then reach, then name.

    The walk stops after the hop at which there are enough nodes: deeper ones could not be among the first. What a deeper hop adds to
    the reach of nodes already met is not counted, as their depth is settled.
    """
    edges = hold(edges)
    seen = None
    for h in range(1, hops + 1):
        step = reach(edges, seeds, h, held=True).where("depth > 0")
        seen = _cut(step)
        found = seen.select("node").distinct().limit(limit).count()
        if found >= limit or seen.where(F.col("depth") == h).isEmpty():
            break
    g = seen.groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("reach"))
    return g.orderBy("depth", F.desc("reach"), "node").limit(limit)
