"""Expansions of a set of seeds over the graph: traces, phases, neighbours in new files, bridges, gates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import CALLS, directed, hold, reach
from .lookups import first_by, top_by

#: Relations of each axis, axes of the kinds of containers, axes along which discovery goes and the one it falls back to.
AXES = {
    "control": CALLS, "registry": ("DECORATED_BY", "HANDLES", "INSTANTIATES", "METADATA_BRIDGE"), "structural": ("DEPENDS_ON", "EXTENDS_EXTERNAL", "INHERITED_API", "HAS_API"),
    "composition": ("READS_ATTR", "WRITES_ATTR", "RESOLVES_ATTR"), "dataflow": ("AFFECTS", "FLOWS_INTO"),
}
KIND_AXES = {
    "registry_class": "registry structural", "web_route_register": "registry control", "task_register": "registry", "keyed_register_callable": "registry", "keyed_dispatch_callable": "registry control", "middleware_chain": "control",
    "signal_register": "registry control", "error_dispatch": "control", "error_model": "structural control", "proxy_object": "composition control", "di_container": "registry control", "data_model": "structural",
    "config_carrier": "structural composition", "metadata_carrier": "composition registry",
}
DISCOVERY, FALLBACK = ("registry", "structural"), "structural"
#: Score that a trace's utility is a part of, and that of a bridge.
TRACE_BASE, BRIDGE_BASE = 0.35, 0.35


def ordered_walk(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``node, depth, reach`` of a walk from seeds (node), without the seeds."""
    s = seeds.select("node").distinct()
    r = reach(edges, s.withColumn("seed", F.col("node")), hops).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("reach"))
    return r.join(s, "node", "left_anti")


def trace(edges: DataFrame, seeds: DataFrame, hops: int = 3, limit: int = 30) -> DataFrame:
    """``node, tag, depth, utility``: who reaches the seeds, then what they reach, each by depth, reach and name; what is met first stays, ``limit`` in all.

    ``edges``: src, dst, rel_type; ``seeds``: node. Utility is a base over the depth.
    """
    out = None
    for i, (tag, direction) in enumerate((("trace_callers", "reverse"), ("trace_callees", "forward"))):
        w = ordered_walk(directed(edges, direction, CALLS), seeds, hops).select("node", F.lit(i).alias("__i"), F.lit(tag).alias("tag"), "depth", "reach")
        out = w if out is None else out.unionByName(w)
    one = out.groupBy("node").agg(F.min(F.struct("__i", "tag", "depth", "reach")).alias("t")).select("node", "t.*")
    return one.orderBy("__i", "depth", F.desc("reach"), "node").limit(limit).select("node", "tag", "depth", (TRACE_BASE / F.greatest(F.lit(1), F.col("depth"))).alias("utility"))


def axes_of(kinds: Sequence[str]) -> list[str]:
    """The axes of some kinds of containers; unknown kinds have none."""
    return sorted({a for k in kinds for a in KIND_AXES.get(k, "").split()})


def phased(edges: DataFrame, seeds: DataFrame, kinds: DataFrame, hops: int = 2, discovered: int = 12, executed: int = 12) -> DataFrame:
    """``node, phase``: first along the axes that the seeds' kinds suggest, then along calls from the seeds and what was found; nearest first, each phase with its cap.

    ``seeds``: node; ``kinds``: node, kind of seeds. Without a kind that has an axis of discovery, the structural one is walked.
    """
    s = seeds.select("node").distinct()
    found = [r["kind"] for r in kinds.join(s, "node", "left_semi").select("kind").distinct().where(F.col("kind").isin(*KIND_AXES)).collect()]  # of a fixed list of kinds
    axes = [a for a in axes_of(found) if a in DISCOVERY] or [FALLBACK]
    types = [t for a in axes for t in AXES[a]]
    first = hold_small(ordered_walk(directed(edges, "undirected", types), s, hops).orderBy("depth", F.desc("reach"), "node").limit(discovered).select("node"))
    start = s.unionByName(first)
    second = ordered_walk(directed(edges, "undirected", CALLS), start, hops).orderBy("depth", F.desc("reach"), "node").limit(executed).select("node")
    return first.withColumn("phase", F.lit("phase_discovery")).unionByName(second.withColumn("phase", F.lit("phase_execution")))


def hold_small(df: DataFrame) -> DataFrame:
    """A small result written, because more than one step starts from it."""
    from .graph import _cut

    return _cut(df)


def new_files(near: DataFrame, taken: DataFrame, order: Sequence[str], per_file: int, files: int, total: int) -> DataFrame:
    """``near`` (node, file_path and the columns of ``order``) in files that are not ``taken`` (file_path): the first ``per_file`` of a file, ``files`` files, ``total`` rows.

    Files are in order of their first row. Rows are cut by file before anything is compared over all; no window holds them all.
    """
    n = near.where("file_path is not null").join(taken.select("file_path").distinct(), "file_path", "left_anti")
    some = top_by(n, ["file_path"], [F.col(c) for c in order], per_file)
    best = some.groupBy("file_path").agg(F.min(F.struct(*order)).alias("__first")).orderBy("__first").limit(files).select("file_path")
    return some.join(best, "file_path", "left_semi").orderBy(*order).limit(total)


def structural_neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, types: Sequence[str] = ("AFFECTS",), hops: int = 2, caps: tuple[int, int, int] = (2, 5, 10)) -> DataFrame:
    """``node, file_path, depth``: neighbours in files that no seed lies in, by depth and distance to the query, with caps of rows of a file, of files and in all.

    ``nodes``: uid, file_path, distance (nulls last); ``seeds``: node.
    """
    n = nodes.select(F.col("uid").alias("node"), "file_path", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))
    near = ordered_walk(directed(edges, "undirected", types), seeds, hops).join(n, "node")
    return new_files(near, n.join(seeds.select("node"), "node", "left_semi"), ["depth", "distance", "node"], *caps).select("node", "file_path", "depth")


def file_classes(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, node``: each seed (node) with the classes of its file. ``nodes``: uid, kind, file_path."""
    s = seeds.select("node").distinct().join(nodes.select(F.col("uid").alias("node"), "file_path"), "node").select(F.col("node").alias("seed"), "file_path")
    return s.join(nodes.where("kind = 'class'").select(F.col("uid").alias("node"), "file_path"), "file_path").select("seed", "node")


def class_walk(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str, types: Sequence[str], hops: int) -> DataFrame:
    """``node, depth, reach``: a walk that starts at all classes of the seeds' files; what lies in a seed's file is left out."""
    start = file_classes(nodes, seeds)
    own = nodes.join(seeds.select(F.col("node").alias("uid")), "uid", "left_semi").select("file_path").distinct()
    r = reach(directed(edges, direction, types), start, hops).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("reach"))
    return r.join(nodes.select(F.col("uid").alias("node"), "file_path"), "node").join(own, "file_path", "left_anti").select("node", "file_path", "depth", "reach")


def inheritance_ancestors(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 3, caps: tuple[int, int, int] = (1, 4, 6)) -> DataFrame:
    """``node, file_path, depth``: what the classes of the seeds' files inherit from, in other files, with caps."""
    w = class_walk(edges, nodes, seeds, "forward", ("DEPENDS_ON",), hops)
    return new_files(w, w.where("false"), ["depth", "node"], *caps).select("node", "file_path", "depth")


def idf_weight(indegree: Column) -> Column:
    """1 / ln(indegree + 1), for at least one edge in."""
    return 1 / F.log(F.greatest(F.coalesce(indegree, F.lit(1)), F.lit(1)) + 1)


def bridge(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, types: Sequence[str] = ("USES_TYPE",), direction: str = "reverse", per_seed: int = 3, total: int = 20) -> DataFrame:
    """``seed, node, score``: one hop from each seed to symbols of core files, the greater name first; a symbol goes to the first seed that takes it.

    ``nodes``: uid, tier; ``seeds``: node, place (seeds take turns in this order). The score falls with the number of edges of ``types`` that end in the seed. At most
    ``per_seed`` + ``total`` candidates of a seed can matter; what the seeds' turns are decided on is no more than that for each.
    """
    e = directed(edges, direction, types)
    s = seeds.groupBy("node").agg(F.min("place").alias("place"))
    fan = edges.where(F.col("rel_type").isin(*types)).join(s.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("k"))
    core = nodes.where("tier = 'core'").select(F.col("uid").alias("to"))
    near = e.join(s.select(F.col("node").alias("src")), "src", "left_semi").withColumnRenamed("dst", "to").join(core, "to", "left_semi")
    cut = top_by(near, ["src"], [F.desc("to")], per_seed + total).select(F.col("src").alias("node"), "to")
    rows = cut.join(s, "node").join(fan, "node", "left").select("node", "place", "to", (BRIDGE_BASE * idf_weight(F.col("k"))).alias("score"))

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        out: list[tuple] = []
        for seed, g in pdf.sort_values(["place", "node"]).groupby("node", sort=False):
            taken = 0
            for r in g.sort_values("to", ascending=False).itertuples():
                if taken == per_seed or len(out) == total:
                    break
                if r.to not in seen:
                    seen.add(r.to)
                    out.append((seed, r.to, r.score))
                    taken += 1
        return pd.DataFrame(out, columns=["seed", "node", "score"])

    return rows.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(turns, "seed string, node string, score double")


def connectivity_gate(seeds: DataFrame, others: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """``node, linked, why``: the seeds linked to at least ``least`` other candidates, and the first seed of each file that nothing else covers; never none.

    ``seeds``: node, file_path, place; ``others``: node, file_path, the candidates of other channels; ``edges`` as from directed(), undirected. If all would go
    the best linked stays. Seeds are kept as they are if there are no other candidates.
    """
    s = seeds.groupBy("node").agg(F.min(F.struct("place", "file_path")).alias("t")).select("node", "t.place", "t.file_path")
    o = others.select("node").distinct()
    met = edges.join(s.select(F.col("node").alias("src")), "src", "left_semi").join(o.select(F.col("node").alias("dst")), "dst", "left_semi")
    n = hold_small(s.join(met.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", F.lit(0))))
    if least <= 0 or o.isEmpty():
        return n.select("node", "linked", F.lit("kept").alias("why"))
    good = n.where(F.col("linked") >= least)
    covered = others.select("file_path").unionByName(good.select("file_path")).where("file_path is not null").distinct()
    alone = n.where((F.col("linked") < least) & F.col("file_path").isNotNull()).join(covered, "file_path", "left_anti")
    alone = first_by(alone, ["file_path"], [F.col("place"), F.col("node")])
    kept = hold_small(good.select("node", "linked", F.lit("linked").alias("why")).unionByName(alone.select("node", "linked", F.lit("sole cover").alias("why"))))
    return n.orderBy(F.desc("linked"), "place", "node").limit(1).select("node", "linked", F.lit("best of none").alias("why")) if kept.isEmpty() else kept


def fanout_limit(rank: Column, anchor: Column, exact: Column, families: Column, roles: Column, spans: Column, most: int = 8, least: int = 2, head: int = 3) -> Column:
    """``limit, why`` of a seed's neighbours: full for anchors, exact names, the first ``head`` and whatever has evidence of its own; half, but ``least``, for the rest."""
    weak = max(min(most, max(1, least)), (most + 1) // 2)
    why = (
        F.when(anchor | exact, "protected").when(rank <= head, "ranked_head").when((families >= 2) | (roles >= 3), "strong_consensus").when((families >= 1) | (roles >= 2) | (spans > 0), "supported_tail").otherwise("weak_tail")
    )
    return F.struct(F.when(why == "weak_tail", weak).otherwise(max(1, most)).alias("limit"), why.alias("why"))


def patch_adjacency(old: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, out, inn``: an adjacency table with the rows of the seeds (node) and their neighbours, old and new, made anew from all their edges."""
    from .graph import adjacency

    s = seeds.select("node").distinct()
    e = edges.select("src", "dst", "rel_type")
    now = e.join(s, e["src"] == s["node"], "left_semi").select(F.col("dst").alias("node")).union(e.join(s, e["dst"] == s["node"], "left_semi").select("src"))
    gone = old.join(s, "node", "left_semi").select(F.explode(F.flatten(F.concat(F.map_values("out"), F.map_values("inn")))).alias("node"))
    touched = hold_small(s.union(now).union(gone).distinct())
    near = e.join(touched, e["src"] == touched["node"], "left_semi").unionByName(e.join(touched, e["src"] == touched["node"], "left_anti").join(touched, F.col("dst") == touched["node"], "left_semi"))
    fresh = adjacency(near).join(touched, "node", "left_semi")
    return old.join(touched, "node", "left_anti").unionByName(fresh)


def external_maps(edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """``node, external, out, inn``: for every symbol and every external node that it touches by ``types``, whether by an edge out and by an edge in."""
    e = edges.where(F.col("rel_type").isin(*types)).select("src", "dst")
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("external"), F.lit(True).alias("out"), F.lit(False).alias("inn"))
    inn = e.select(F.col("dst").alias("node"), F.col("src").alias("external"), F.lit(False).alias("out"), F.lit(True).alias("inn"))
    return out.unionByName(inn).groupBy("node", "external").agg(F.max("out").alias("out"), F.max("inn").alias("inn"))


def through_external(edges: DataFrame, types: Sequence[str], externals: DataFrame, cap: int) -> DataFrame:
    """``src, dst, external``: symbols that meet at an external node (node of ``externals``), which a walk passes through; nodes with more than ``cap`` symbols are no bridge."""
    e = edges.where(F.col("rel_type").isin(*types)).join(externals.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    small = e.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("dst")
    e = hold(e.join(small, "dst", "left_semi"))
    return e.withColumnRenamed("dst", "external").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("external")), "external").where("src <> dst").select("src", "dst", "external")
