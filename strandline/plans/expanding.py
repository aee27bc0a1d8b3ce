"""Queries on expansions over the wide graph, and on windows and cuts of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import views
from ..functions import text as tx
from ..operators import expansions as ex
from ..operators import graph as gr
from ..sources.tables import load
from .base import Registry
from .roles import _CALLS, _IN

R = Registry()
register = R.register

_WITH = views.sql("nodes", "relations", recursive=True)
_SEEDS = "('P3', 'P4', 'P8')"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return views.nodes(spark, d).where(F.col("uid").isin("P3", "P4", "P8")).select(F.col("uid").alias("node"))


def _walk(name: str, types, direction: str, start: str, hops: int) -> str:
    """A walk as relations: its edges, its steps, and node, depth, reach without what it started from."""
    pairs = {"forward": "src AS s, dst AS t", "reverse": "dst AS s, src AS t"}
    one = lambda w: f"SELECT {pairs[w]} FROM relations WHERE rel_type IN ({_IN(types)}) AND src <> dst"
    edges = f"{one('forward')} UNION {one('reverse')}" if direction == "undirected" else f"SELECT DISTINCT * FROM ({one(direction)})"
    return f"""{name}_e AS ({edges}), {name}_s AS ({start}), {name}_w(seed, node, depth) AS (SELECT seed, node, 0 FROM {name}_s UNION SELECT seed, t, depth + 1 FROM {name}_w JOIN {name}_e ON s = node WHERE depth < {hops}),
{name} AS (SELECT node, min(depth) AS depth, count(DISTINCT seed) AS reach FROM (SELECT seed, node, min(depth) AS depth FROM {name}_w GROUP BY 1, 2) WHERE depth > 0 GROUP BY 1)"""


_START = f"SELECT uid AS seed, uid AS node FROM nodes WHERE uid IN {_SEEDS}"


@register("g16_trace_chain", f"""{_WITH}, {_walk("callers", gr.CALLS, "reverse", _START, 3)}, {_walk("callees", gr.CALLS, "forward", _START, 3)}, u AS (SELECT 0 AS i, 'trace_callers' AS tag, * FROM callers UNION ALL SELECT 1, 'trace_callees', * FROM callees)
SELECT node, tag, depth, round(0.35 / depth, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY i) AS k FROM u WHERE node NOT IN {_SEEDS}) WHERE k = 1 ORDER BY i, depth, reach DESC, node LIMIT 30""")
def g16(spark: SparkSession, d: str) -> DataFrame:
    """Who reaches three symbols, then what they reach; what is met first stays, at most 30."""
    return ex.trace(views.relations(spark, d), _seeds(spark, d)).withColumn("utility", F.round("utility", 6))


_FIRST = _walk("found", ex.AXES["registry"] + ex.AXES["structural"], "undirected", _START, 2)


@register("g20_phased_walk", f"""{_WITH}, {_FIRST}, d AS (SELECT node FROM found WHERE node NOT IN {_SEEDS} ORDER BY depth, reach DESC, node LIMIT 12), {_walk("run", gr.CALLS, "undirected", f"{_START} UNION SELECT node, node FROM d", 2)},
e AS (SELECT node FROM run WHERE node NOT IN {_SEEDS} AND node NOT IN (SELECT node FROM d) ORDER BY depth, reach DESC, node LIMIT 12) SELECT node, 'phase_discovery' AS phase FROM d UNION ALL SELECT node, 'phase_execution' FROM e""")
def g20(spark: SparkSession, d: str) -> DataFrame:
    """Along the axes of the seeds' kinds first, then along calls from all that was met."""
    s = _seeds(spark, d)
    kinds = s.withColumn("kind", F.when(F.col("node") == "P3", "registry_class").when(F.col("node") == "P4", "error_dispatch").otherwise("something"))
    return ex.phased(views.relations(spark, d), s, kinds)


def _new_files(near: str, order: str, per: int, files: int, total: int) -> str:
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {order}) AS k FROM {near}), b AS (SELECT * FROM a WHERE k <= {per}), f AS (SELECT file_path FROM b WHERE k = 1 ORDER BY {order} LIMIT {files})
SELECT node, file_path, depth FROM b WHERE file_path IN (SELECT file_path FROM f) ORDER BY {order} LIMIT {total}"""


_OWN = f"(SELECT file_path FROM nodes WHERE uid IN {_SEEDS})"


def _structural(types, hops: int, caps) -> str:
    return f"""{_WITH}, {_walk("near", types, "undirected", _START, hops)}, n AS (SELECT node, depth, file_path, size / 50.0 AS distance FROM near JOIN nodes ON uid = node WHERE node NOT IN {_SEEDS} AND file_path NOT IN {_OWN}), {_new_files("n", "depth, distance, node", *caps)}"""


def _with_distance(spark: SparkSession, d: str) -> DataFrame:
    return views.nodes(spark, d).withColumn("distance", F.col("size") / 50.0)


@register("g17_structural_neighbours", _structural(("AFFECTS",), 2, (2, 5, 10)))
def g17(spark: SparkSession, d: str) -> DataFrame:
    """What is affected within two hops, in new files only, nearest first, two of a file, five files, ten in all."""
    return ex.structural_neighbours(views.relations(spark, d), _with_distance(spark, d), _seeds(spark, d))


@register("g18_dataflow_siblings", _structural(("FLOWS_INTO",), 1, (2, 3, 6)))
def g18(spark: SparkSession, d: str) -> DataFrame:
    """What flows in or out by one hop, in new files only."""
    return ex.structural_neighbours(views.relations(spark, d), _with_distance(spark, d), _seeds(spark, d), ("FLOWS_INTO",), 1, (2, 3, 6))


_CLASSES = f"SELECT s.uid AS seed, c.uid AS node FROM nodes s JOIN nodes c ON c.file_path = s.file_path AND c.kind = 'class' WHERE s.uid IN {_SEEDS}"


@register("g02_file_class_anchor", f"{_WITH}, {_walk('near', ('READS_ATTR', 'USES_TYPE'), 'undirected', _CLASSES, 2)} SELECT node, file_path, depth, reach FROM near JOIN nodes ON uid = node WHERE file_path NOT IN {_OWN}")
def g02(spark: SparkSession, d: str) -> DataFrame:
    """A walk from all classes of the seeds' files to other files."""
    return ex.class_walk(views.relations(spark, d), views.nodes(spark, d), _seeds(spark, d), "undirected", ("READS_ATTR", "USES_TYPE"), 2)


@register("g19_inheritance_ancestors", f"{_WITH}, {_walk('near', ('DEPENDS_ON',), 'forward', _CLASSES, 3)}, n AS (SELECT node, file_path, depth FROM near JOIN nodes ON uid = node WHERE file_path NOT IN {_OWN}), {_new_files('n', 'depth, node', 1, 4, 6)}")
def g19(spark: SparkSession, d: str) -> DataFrame:
    """What the classes of the seeds' files inherit from within three levels, one of a file, four files, six in all."""
    return ex.inheritance_ancestors(views.relations(spark, d), views.nodes(spark, d), _seeds(spark, d))


_PLACES = "SELECT uid AS node, CASE uid WHEN 'P3' THEN 1 WHEN 'P4' THEN 2 ELSE 3 END AS place FROM nodes WHERE uid IN ('P3', 'P4', 'P8')"


@register("g22_bridge")
def g22(spark: SparkSession, d: str) -> DataFrame:
    """What uses the types that documents speak of: three for each, in core files, scored by how rare the type is."""
    n = views.nodes(spark, d).select("uid", tx.file_tier(F.col("file_path")).alias("tier"))
    s = _seeds(spark, d).withColumn("place", F.when(F.col("node") == "P3", 1).when(F.col("node") == "P4", 2).otherwise(3))
    return ex.bridge(views.relations(spark, d), n, s).withColumn("score", F.round("score", 9))


@register("g22_other_bridges")
def g22_others(spark: SparkSession, d: str) -> DataFrame:
    """The same over hooks, carriers of an API and what is handled."""
    n = views.nodes(spark, d).select("uid", tx.file_tier(F.col("file_path")).alias("tier"))
    s = _seeds(spark, d).withColumn("place", F.lit(1))
    e, out = views.relations(spark, d), None
    for name, types, way in (("hook", ("HANDLES", "DECORATED_BY"), "reverse"), ("api", ("HAS_API", "INHERITED_API"), "forward"), ("reexport", ("DEPENDS_ON",), "forward")):
        b = ex.bridge(e, n, s, types, way, 2, 6).select(F.lit(name).alias("bridge"), "seed", "node", F.round("score", 9).alias("score"))
        out = b if out is None else out.unionByName(b)
    return out


@register("g23_connectivity_gate", f"""{_WITH}, s AS (SELECT uid AS node, file_path, key AS place FROM nodes WHERE size IN (7, 10)), o AS (SELECT uid AS node, file_path FROM nodes WHERE size IN (1, 2)), e AS (SELECT src AS s, dst AS t FROM relations WHERE rel_type IN ({_CALLS}) UNION SELECT dst, src FROM relations WHERE rel_type IN ({_CALLS})),
n AS (SELECT s.*, (SELECT count(DISTINCT t) FROM e WHERE e.s = s.node AND t IN (SELECT node FROM o)) AS linked FROM s), good AS (SELECT * FROM n WHERE linked >= 2), rest AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY place, node) AS k FROM n WHERE linked < 2 AND file_path NOT IN (SELECT file_path FROM o) AND file_path NOT IN (SELECT file_path FROM good))
SELECT node, linked, 'linked' AS why FROM good UNION ALL SELECT node, linked, 'sole cover' FROM rest WHERE k = 1""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with at least two links to other candidates; a file that nothing else covers keeps its first."""
    n = views.nodes(spark, d)
    s = n.where("size in (7, 10)").select(F.col("uid").alias("node"), "file_path", F.col("key").alias("place"))
    return ex.connectivity_gate(s, n.where("size in (1, 2)").select(F.col("uid").alias("node"), "file_path"), gr.directed(views.relations(spark, d), "undirected", gr.CALLS), 2)


@register("g25_fanout_limit", """WITH g AS (SELECT uid, max(utility_score) AS u, bool_or(role = 'abstract_contract') AS anchor, count(DISTINCT role) AS roles FROM context_symbols WHERE uid IS NOT NULL AND isfinite(utility_score) GROUP BY 1),
c AS (SELECT uid, count(DISTINCT string_split(p, ':')[1]) AS fam FROM (SELECT uid, unnest(provenance) AS p FROM context_symbols WHERE uid IS NOT NULL AND isfinite(utility_score)) WHERE p NOT LIKE 'graph:%' GROUP BY 1),
x AS (SELECT uid, anchor, roles, coalesce(fam, 0) AS fam, row_number() OVER (ORDER BY u DESC, uid) AS r FROM g LEFT JOIN c USING (uid)), y AS (SELECT uid, CASE WHEN anchor THEN 'protected' WHEN r <= 3 THEN 'ranked_head' WHEN fam >= 2 OR roles >= 3 THEN 'strong_consensus' WHEN fam >= 1 OR roles >= 2 THEN 'supported_tail' ELSE 'weak_tail' END AS why FROM x)
SELECT uid, why, CASE WHEN why = 'weak_tail' THEN 4 ELSE 8 END AS "limit" FROM y""")
def g25(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours each seed may have, by rank and evidence."""
    from ..operators.ranking import ranked

    s = load(spark, d, "context_symbols").where("uid is not null and utility_score is not null and not isnan(utility_score) and abs(utility_score) < double('infinity')")
    g = s.groupBy("uid").agg(F.max("utility_score").alias("u"), F.max(F.coalesce(F.col("role") == "abstract_contract", F.lit(False))).alias("anchor"), F.countDistinct("role").alias("roles"))
    c = s.select("uid", F.explode("provenance").alias("p")).where("p not like 'graph:%'").groupBy("uid").agg(F.countDistinct(F.substring_index("p", ":", 1)).alias("fam"))
    x = ranked(g.join(c, "uid", "left"), [F.desc("u"), F.col("uid")], "r")
    limit = ex.fanout_limit(F.col("r"), F.col("anchor"), F.lit(False), F.coalesce("fam", F.lit(0)), F.col("roles"), F.lit(0))
    return x.select("uid", limit.alias("l")).select("uid", "l.why", "l.limit")


_LABELS = "x AS (SELECT src AS node, 'out:' || rel_type AS label, dst AS other FROM relations UNION ALL SELECT dst, 'in:' || rel_type, src FROM relations)"


@register("g12_adjacency", f"{views.sql('relations')}, {_LABELS} SELECT node, label, count(DISTINCT other) AS n, min(other) AS first, max(other) AS last FROM x GROUP BY 1, 2")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency of every symbol, made of old edges and patched for those that changed; it equals one made anew."""
    e = gr._cut(views.relations(spark, d))
    old = gr.adjacency(e.where("not (src = 'P3' and rel_type = 'AFFECTS')"))
    a = ex.patch_adjacency(gr._cut(old), e, views.nodes(spark, d).where("uid = 'P3'").select(F.col("uid").alias("node")))
    rows = [a.select("node", F.explode(col).alias("t", "o")).select("node", F.concat(F.lit(p), "t").alias("label"), F.size("o").alias("n"), F.array_min("o").alias("first"), F.array_max("o").alias("last")) for col, p in (("out", "out:"), ("inn", "in:"))]
    return rows[0].union(rows[1])


@register("g13_external_maps", f"{views.sql('relations')}, m AS (SELECT src AS node, dst AS external, true AS o, false AS i FROM relations WHERE rel_type LIKE '%ENDPOINT' UNION ALL SELECT dst, src, false, true FROM relations WHERE rel_type LIKE '%ENDPOINT') SELECT node, external, bool_or(o) AS \"out\", bool_or(i) AS inn FROM m GROUP BY 1, 2")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and the external nodes they touch, both ways."""
    return ex.external_maps(views.relations(spark, d), gr.ENDPOINTS)


@register("w10_word_windows", r"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda y: y <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, s // 32 AS n, array_to_string(w[s + 1:s + 40], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 32)) AS s FROM x)""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 40 words with 8 in common."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(tx.word_windows(F.col("text"), 40, 8)).alias("n", "chunk"))


def _line_windows(size: int, overlap: int, least: int) -> str:
    return f"""WITH x AS (SELECT uid, string_split(replace(max(code), chr(13), ''), chr(10)) AS l FROM context_symbols WHERE uid IS NOT NULL AND code IS NOT NULL GROUP BY 1), y AS (SELECT uid, l, unnest(range(0, len(l), {size - overlap})) AS s FROM x)
SELECT uid, s + 1 AS "start", least(len(l), s + {size}) AS "end", md5(array_to_string(l[s + 1:s + {size}], chr(10))) AS chunk FROM y WHERE s = 0 OR (len(l) - s >= {least} AND len(l) - s > {overlap})"""


def _windows(spark: SparkSession, d: str, size: int, overlap: int, least: int) -> DataFrame:
    c = load(spark, d, "context_symbols").where("uid is not null and code is not null").groupBy("uid").agg(F.max("code").alias("code"))
    return c.select("uid", F.explode(tx.line_windows(F.col("code"), size, overlap, least)).alias("w")).select("uid", "w.start", "w.end", F.md5("w.text").alias("chunk"))


@register("w10_code_windows", _line_windows(24, 4, 10))
def w10_code(spark: SparkSession, d: str) -> DataFrame:
    """Code in windows of 24 lines with 4 in common; a last one needs ten."""
    return _windows(spark, d, 24, 4, 10)


@register("w10_span_windows", _line_windows(6, 0, 1))
def w10_spans(spark: SparkSession, d: str) -> DataFrame:
    """Code in spans of six lines."""
    return _windows(spark, d, 6, 0, 1)


@register("o09_trim_to_budget", """WITH x AS (SELECT chunk_id, replace(content, chr(13), '') AS t, 30 AS anchor FROM context_docs WHERE content IS NOT NULL), l AS (SELECT DISTINCT chunk_id, t, anchor, CASE WHEN ends_with(t, chr(10)) THEN string_split(t, chr(10))[1:-2] ELSE string_split(t, chr(10)) END AS l FROM x),
k AS (SELECT *, len(list_filter(range(1, len(l) + 1), lambda i: (length(array_to_string(l[1:i], chr(10))) + 3) // 4 <= 400)) AS k, greatest(0, least(anchor - 1, len(l) - 1)) AS centre FROM l), e AS (SELECT *, least(len(l), greatest(0, centre - 25) + 100) AS e FROM k)
SELECT chunk_id, md5(CASE WHEN t = '' THEN '' WHEN (length(t) + 3) // 4 <= 400 THEN t ELSE array_to_string(l[1:k], chr(10)) END) AS head, md5(CASE WHEN t = '' THEN '' WHEN (length(t) + 3) // 4 <= 400 THEN t ELSE array_to_string(l[greatest(0, e - 100) + 1:greatest(0, e - 100) + 100], chr(10)) END) AS around FROM e""")
def o09(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut to whole lines within a budget, from the start and around a line."""
    c = load(spark, d, "context_docs").where("content is not null").select("chunk_id", F.replace("content", F.lit("\r"), F.lit("")).alias("t")).distinct()
    return c.select("chunk_id", F.md5(tx.trim_to_budget(F.col("t"), 400)).alias("head"), F.md5(tx.trim_to_budget(F.col("t"), 400, F.lit(30))).alias("around"))


@register("w01_channel_ranks", "WITH s AS (SELECT feedback_token AS channel, uid, max(utility_score) AS s FROM context_symbols WHERE isfinite(utility_score) AND uid IS NOT NULL AND feedback_token IS NOT NULL GROUP BY 1, 2) SELECT channel, uid, row_number() OVER (PARTITION BY channel ORDER BY s DESC, uid DESC) AS rank FROM s")
def w01(spark: SparkSession, d: str) -> DataFrame:
    """Places within each channel, from one, by score and uid."""
    s = load(spark, d, "context_symbols").where("uid is not null and feedback_token is not null and utility_score is not null and not isnan(utility_score) and abs(utility_score) < double('infinity')")
    g = s.groupBy(F.col("feedback_token").alias("channel"), "uid").agg(F.max("utility_score").alias("s"))
    return g.select("channel", "uid", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("s"), F.desc("uid"))).alias("rank"))


QUERIES, ORACLES = R.queries, R.oracles
