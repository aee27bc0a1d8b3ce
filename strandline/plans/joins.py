"""Queries on lookup, interval, bridge and history joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import vectors as ve
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register

_REFS = r"""refs AS (SELECT DISTINCT regexp_replace(symbol, '\(\)$', '') AS callee FROM messages WHERE symbol <> '' UNION SELECT qualified_name FROM symbols UNION SELECT qualified_name || '.call' FROM symbols)"""


def _refs(spark: SparkSession, d: str, sy: DataFrame) -> DataFrame:
    """Names that are called: bare, and of every symbol its qualified name and a member of it."""
    said = load(spark, d, "messages").where("symbol <> ''").select(F.regexp_replace("symbol", r"\(\)$", "").alias("callee"))
    return said.union(sy.select("qualified_name")).union(sy.select(F.concat("qualified_name", F.lit(".call")))).distinct()


@register("j01_call_resolution", f"""{views.sql('symbols')}, {_REFS},
x AS (SELECT callee, first(uid ORDER BY file_path, start_line, uid) AS u FROM refs JOIN symbols ON qualified_name = callee GROUP BY 1),
p AS (SELECT callee, arg_max(uid, {{'n': length(qualified_name), 'u': uid}}) AS u FROM refs JOIN symbols ON starts_with(callee, qualified_name || '.') GROUP BY 1),
n AS (SELECT callee, min(uid) AS u FROM refs JOIN symbols ON name = callee GROUP BY 1 HAVING count(*) = 1)
SELECT callee, coalesce(x.u, p.u, n.u) AS uid FROM refs LEFT JOIN x USING (callee) LEFT JOIN p USING (callee) LEFT JOIN n USING (callee) WHERE coalesce(x.u, p.u, n.u) IS NOT NULL""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    """Callees resolved by exact name, else by the longest name they are a member of, else by a bare name that is unique."""
    sy = views.symbols(spark, d)
    refs = _refs(spark, d, sy)
    exact = lk.first_by(sy, ["qualified_name"], [F.col("file_path"), F.col("start_line"), F.col("uid")]).select(F.col("qualified_name").alias("callee"), F.col("uid").alias("x"))
    owners = sy.groupBy("qualified_name").agg(F.max("uid").alias("p"))
    member = lk.longest_owner(refs.withColumnRenamed("callee", "qualified_name"), sy).join(owners.withColumnRenamed("qualified_name", "owner"), "owner").select(F.col("qualified_name").alias("callee"), "p")
    bare = lk.unique_by(sy, "name").select(F.col("name").alias("callee"), F.col("uid").alias("n"))
    return refs.join(exact, "callee", "left").join(member, "callee", "left").join(bare, "callee", "left").select("callee", F.coalesce("x", "p", "n").alias("uid")).where("uid is not null")


@register("j09_abstain_join", f"""{views.sql('symbols')}, h AS (SELECT DISTINCT symbol AS name FROM messages WHERE symbol <> ''), m AS (SELECT h.name, uid, count(*) OVER (PARTITION BY h.name) AS n FROM h JOIN symbols USING (name)) SELECT name, uid FROM m WHERE n BETWEEN 1 AND 3""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """Hooks linked by name where one to three symbols have it; more is ambiguous and links to none."""
    hooks = load(spark, d, "messages").where("symbol <> ''").select(F.col("symbol").alias("name")).distinct()
    return lk.abstain_join(hooks, views.symbols(spark, d).select("name", "uid"), "name", "name")


@register("j10_cooccurrence_prune", """SELECT DISTINCT target FROM index_jobs WHERE target IS NOT NULL AND target NOT IN
(SELECT target FROM index_jobs WHERE target IS NOT NULL GROUP BY target HAVING NOT bool_or(lower(trim(status)) = 'completed') OR NOT bool_or(lower(trim(status)) = 'running'))""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose rows show both states: an anti-join on the signature of the group."""
    j = load(spark, d, "index_jobs").where("target is not null").select("target", F.lower(F.trim("status")).alias("s"))
    sig = j.groupBy("target").agg(F.max(F.coalesce(F.col("s") == "completed", F.lit(False))).alias("c"), F.max(F.coalesce(F.col("s") == "running", F.lit(False))).alias("r"))
    return j.select("target").distinct().join(sig.where("not c or not r"), "target", "left_anti")


@register("j11_supersede", f"{views.sql('edges')} SELECT src, dst, rel_type FROM edges WHERE rel_type = 'CALLS_SCOPED' AND (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE rel_type = 'CALLS_DIRECT')")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Weaker edges without those that a stronger one covers."""
    e = views.edges(spark, d)
    return e.where("rel_type = 'CALLS_SCOPED'").join(e.where("rel_type = 'CALLS_DIRECT'").select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "rel_type")


_BRIDGE = """p AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'K' || l_partkey AS key FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT 'S' || l_suppkey AS dst, 'K' || l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'),
pk AS (SELECT key FROM p GROUP BY 1 HAVING count(*) <= 12), ck AS (SELECT key FROM c GROUP BY 1 HAVING count(*) <= 12)"""


@register("j12_metadata_bridge", f"WITH {_BRIDGE} SELECT src, dst, key FROM p JOIN c USING (key) WHERE src <> dst AND key IN (SELECT key FROM pk) AND key IN (SELECT key FROM ck)")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Producers and consumers of a key, where neither side has more than twelve."""
    li = load(spark, d, "lineitem")
    side = lambda flag, name: li.where(F.col("l_returnflag") == flag).select(F.concat(F.lit("S"), "l_suppkey").alias(name), F.concat(F.lit("K"), "l_partkey").alias("key"))
    return lk.capped_bridge(side("A", "src"), side("R", "dst"), "key", 12)


@register("j19_integrates_with", """WITH d AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS g FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT g FROM d GROUP BY 1 HAVING count(*) >= 2)
SELECT a.i AS a, b.i AS b, count(*) AS shared FROM d a JOIN d b ON a.g = b.g AND a.i < b.i WHERE a.g IN (SELECT g FROM s) GROUP BY 1, 2 HAVING count(*) >= 2""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share at least two packages, however many have them; no package here is plumbing."""
    return lk.shared_pairs(load(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_suppkey", "l_partkey", 2)


_IDENT = "list_sort(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9]*_[A-Za-z0-9_]*[A-Za-z0-9]|[a-z]+[A-Z][A-Za-z0-9]*')))"


@register("j21_doc_symbol_join", f"""{views.sql('symbols', 'chunks')}, i AS (SELECT chunk_id, unnest({_IDENT}) AS name FROM chunks), n AS (SELECT name, min(uid) AS uid FROM symbols GROUP BY 1) SELECT chunk_id, name, uid FROM i LEFT JOIN n USING (name)""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    """Names in a chunk with the symbols they mean; those without one stay pending with a null."""
    names = views.symbols(spark, d).groupBy("name").agg(F.min("uid").alias("uid"))
    return views.chunks(spark, d).select("chunk_id", F.explode(tx.identifiers(F.col("content"))).alias("name")).join(names, "name", "left").select("chunk_id", "name", "uid")


@register("j22_vector_join", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS x FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, neighbour, round(x, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 9), neighbour) AS r FROM s WHERE x <= 1.5) WHERE r <= 5""")
def j22(spark: SparkSession, d: str) -> DataFrame:
    """A batch of vectors joined with all: of every fiftieth the five others nearest by L2, within the threshold."""
    return ve.nearest_within(load(spark, d, "embeddings"), "vec_id", "embedding", 5, 1.5, F.col("vec_id") % 50 == 0)


@register("j23_pending_resolution", f"""{views.sql('symbols', 'chunks')}, i AS (SELECT chunk_id, {_IDENT} AS names FROM chunks), k AS (SELECT DISTINCT name FROM symbols), p AS (SELECT chunk_id, unnest(names) AS name FROM i) SELECT chunk_id, list(name ORDER BY name) AS pending FROM p WHERE name NOT IN (SELECT name FROM k WHERE name IS NOT NULL) GROUP BY 1""")
def j23(spark: SparkSession, d: str) -> DataFrame:
    """The names of each chunk that still resolve to nothing, as an array."""
    names = views.symbols(spark, d).where("name is not null").select("name").distinct()
    p = views.chunks(spark, d).select("chunk_id", F.explode(tx.identifiers(F.col("content"))).alias("name")).join(names, "name", "left_anti")
    return p.groupBy("chunk_id").agg(F.sort_array(F.collect_list("name")).alias("pending"))


@register("j24_doc_references", f"""{views.sql('chunks')}, r AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(content, '[a-z]+/[a-z_]+\\.[a-z]+'))) AS said FROM chunks) SELECT chunk_id, said AS file_path FROM r WHERE said IN (SELECT file_path FROM context_symbols WHERE file_path IS NOT NULL)""")
def j24(spark: SparkSession, d: str) -> DataFrame:
    """Files that a chunk names and that exist."""
    said = views.chunks(spark, d).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[a-z]+/[a-z_]+\.[a-z]+"), F.lit(0)))).alias("file_path"))
    return said.join(load(spark, d, "context_symbols").select("file_path"), "file_path", "left_semi").select("chunk_id", "file_path")


@register("j25_feedback_snapshot", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled_at DESC NULLS LAST, reviewer DESC NULLS LAST, quality DESC NULLS LAST) AS r FROM labels) SELECT doc_id, source, quality FROM l JOIN documents USING (doc_id) WHERE r = 1 AND quality IS NOT NULL")
def j25(spark: SparkSession, d: str) -> DataFrame:
    """The last feedback on each document, where its outcome is known."""
    last = lk.first_by(load(spark, d, "labels"), ["doc_id"], [F.desc_nulls_last("labelled_at"), F.desc_nulls_last("reviewer"), F.desc_nulls_last("quality")])
    return last.where("quality is not null").join(load(spark, d, "documents"), "doc_id").select("doc_id", "source", "quality")


@register("j28_connectivity", f"{views.sql('edges')} SELECT p.p_partkey, count(DISTINCT e.src) AS linked FROM part p LEFT JOIN edges e ON e.dst = 'P' || p.p_partkey AND e.rel_type = 'CALLS_DIRECT' GROUP BY 1")
def j28(spark: SparkSession, d: str) -> DataFrame:
    """Distinct neighbours of each seed in the pool, zero kept."""
    n = views.edges(spark, d).where("rel_type = 'CALLS_DIRECT'").groupBy("dst").agg(F.countDistinct("src").alias("linked"))
    p = load(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), "p_partkey").alias("dst"))
    return p.join(n, "dst", "left").select("p_partkey", F.coalesce("linked", F.lit(0)).alias("linked"))


@register("j30_overlay_dedupe", "SELECT DISTINCT file_path, symbol FROM context_symbols WHERE NOT is_dirty AND file_path IS NOT NULL AND symbol IS NOT NULL EXCEPT SELECT file_path, symbol FROM context_symbols WHERE is_dirty AND file_path IS NOT NULL AND symbol IS NOT NULL")
def j30(spark: SparkSession, d: str) -> DataFrame:
    """Committed callers that no unsaved one replaces."""
    s = load(spark, d, "context_symbols").where("file_path is not null and symbol is not null").select("file_path", "symbol", "is_dirty")
    return s.where("not is_dirty").drop("is_dirty").distinct().join(s.where("is_dirty"), ["file_path", "symbol"], "left_anti")


@register("j31_dashboard_counts", """SELECT workspace_id, count(DISTINCT source_file) AS files, count(DISTINCT chunk_id) AS chunks, count(DISTINCT owner_uid) FILTER (WHERE owner_uid IN (SELECT uid FROM context_symbols)) AS covered FROM context_docs GROUP BY 1""")
def j31(spark: SparkSession, d: str) -> DataFrame:
    """Files, chunks and covered symbols of each workspace."""
    known = load(spark, d, "context_symbols").where("uid is not null").select(F.col("uid").alias("owner_uid")).distinct().withColumn("k", F.lit(1))
    c = load(spark, d, "context_docs").select("workspace_id", "source_file", "chunk_id", "owner_uid").join(known, "owner_uid", "left")
    return c.groupBy("workspace_id").agg(F.countDistinct("source_file").alias("files"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("k") == 1, F.col("owner_uid"))).alias("covered"))


@register("j32_orphans", f"{views.sql('symbols')} SELECT uid FROM symbols WHERE uid NOT IN (SELECT owner_uid FROM context_docs WHERE owner_uid IS NOT NULL)")
def j32(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that no chunk belongs to."""
    return views.symbols(spark, d).join(load(spark, d, "context_docs").select(F.col("owner_uid").alias("uid")), "uid", "left_anti").select("uid")


@register("j33_incident_closure", f"{views.sql('edges')}, t AS (SELECT 'P' || p_partkey AS u FROM part WHERE p_size = 1) SELECT src, dst, rel_type FROM edges WHERE src IN (SELECT u FROM t) OR dst IN (SELECT u FROM t)")
def j33(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch a set at either end: two semi-joins, the second over what the first left."""
    e = views.edges(spark, d)
    t = load(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("u"))
    by_src = e.join(t, e["src"] == t["u"], "left_semi")
    by_dst = e.join(t, e["src"] == t["u"], "left_anti").join(t, F.col("dst") == t["u"], "left_semi")
    return by_src.unionByName(by_dst).select("src", "dst", "rel_type")


@register("j35_alias_flatten", f"{views.sql('symbols')} SELECT lower(name) AS alias, min(qualified_name) AS canonical FROM symbols WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT qualified_name) = 1")
def j35(spark: SparkSession, d: str) -> DataFrame:
    """Aliases that mean one name only."""
    return views.symbols(spark, d).where("name is not null").groupBy(F.lower("name").alias("alias")).agg(F.min("qualified_name").alias("canonical"), F.countDistinct("qualified_name").alias("n")).where("n = 1").drop("n")


_SPANS = "s AS (SELECT DISTINCT file_path, uid, start_line, end_line FROM context_symbols WHERE uid IS NOT NULL AND file_path IS NOT NULL AND start_line <= end_line)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "context_symbols").where("uid is not null and file_path is not null and start_line <= end_line").select("file_path", "uid", F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()


@register("j38_overlap_clip", f"""WITH {_SPANS} SELECT a.file_path, a.uid AS left_uid, b.uid AS right_uid, greatest(a.start_line, b.start_line) AS "start", least(a.end_line, b.end_line) AS "end" FROM s a JOIN s b ON a.file_path = b.file_path AND a.uid < b.uid AND greatest(a.start_line, b.start_line) <= least(a.end_line, b.end_line)""")
def j38(spark: SparkSession, d: str) -> DataFrame:
    """The common lines of overlapping spans."""
    s = _spans(spark, d)
    return lk.overlaps(s, s, "file_path").where("left_uid < right_uid")


@register("j39_longest_owner", f"""{views.sql('symbols')}, o AS (SELECT DISTINCT regexp_replace(qualified_name, '\\.[^.]*$', '') AS owner FROM symbols UNION SELECT DISTINCT string_split(qualified_name, '.')[1] FROM symbols)
SELECT uid, max(owner) AS owner FROM (SELECT uid, owner, rank() OVER (PARTITION BY uid ORDER BY length(owner) DESC) AS r FROM symbols JOIN o ON starts_with(qualified_name, owner || '.')) WHERE r = 1 GROUP BY 1""")
def j39(spark: SparkSession, d: str) -> DataFrame:
    """The longest module that a symbol's name begins with."""
    s = views.symbols(spark, d).select("uid", "qualified_name")
    o = s.select(F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("qualified_name")).union(s.select(tx.external_root(F.col("qualified_name"))))
    return lk.longest_owner(s, o).where("owner is not null").select("uid", "owner")


@register("j41_derive_external", f"""{views.sql('symbols')}, r AS (SELECT DISTINCT regexp_replace(symbol, '\\(\\)$', '') AS name FROM messages WHERE symbol <> '') SELECT name, true AS derived FROM r WHERE name NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL) UNION ALL SELECT DISTINCT name, false FROM symbols WHERE name IS NOT NULL""")
def j41(spark: SparkSession, d: str) -> DataFrame:
    """Known names, and nodes made for names that are used but unknown."""
    known = views.symbols(spark, d).where("name is not null").select("name").distinct()
    used = load(spark, d, "messages").where("symbol <> ''").select(F.regexp_replace("symbol", r"\(\)$", "").alias("name")).distinct()
    return used.join(known, "name", "left_anti").withColumn("derived", F.lit(True)).unionByName(known.withColumn("derived", F.lit(False)))


@register("j43_as_of", """WITH v AS (SELECT user_id, ts, max(value) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT e.event_id, v.last_view FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase'""")
def j43(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the value of the user's last view: an as-of join."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views_ = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return lk.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views_, ["user_id"], "ts", ["last_view"]).select("event_id", "last_view")


QUERIES, ORACLES = R.queries, R.oracles
