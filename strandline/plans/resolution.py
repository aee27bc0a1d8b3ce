"""Queries on the resolution of references: calls, imports, bases, bindings, attributes, endpoints, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import lookups as lk
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register

#: Confidence that is written with a call, by its tier; an unknown tier is a guess.
WRITTEN = {"CALLS_DIRECT": 1.0, "CALLS_SCOPED": 0.9, "CALLS_IMPORTED": 0.85, "CALLS_DYNAMIC": 0.7, "CALLS_INFERRED": 0.4, "CALLS_GUESS": 0.4}
_SITES = "sites AS (SELECT 'P' || l_partkey AS src, CASE WHEN l_linenumber = 7 THEN 'P' || l_partkey ELSE 'P' || (l_suppkey * 40 + l_linenumber) END AS dst, CASE l_returnflag WHEN 'A' THEN 'CALLS_DIRECT' WHEN 'R' THEN 'CALLS_IMPORTED' ELSE 'CALLS_LATE' END AS said, l_linenumber AS line FROM lineitem)"


@register("j02_edge_write", f"""{views.sql('nodes')}, {_SITES}, t AS (SELECT DISTINCT src, dst, CASE WHEN said = 'CALLS_LATE' THEN 'CALLS_GUESS' ELSE said END AS rel_type, line FROM sites WHERE src <> dst AND src IN (SELECT uid FROM nodes) AND dst IN (SELECT uid FROM nodes))
SELECT *, CASE rel_type WHEN 'CALLS_DIRECT' THEN 1.0 WHEN 'CALLS_IMPORTED' THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence FROM t""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    """Call sites written as edges: both ends known, no call of oneself, unknown tiers as guesses, each once."""
    li = load(spark, d, "lineitem")
    said = F.when(F.col("l_returnflag") == "A", "CALLS_DIRECT").when(F.col("l_returnflag") == "R", "CALLS_IMPORTED").otherwise("CALLS_LATE")
    dst = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("P"), "l_partkey")).otherwise(F.concat(F.lit("P"), F.col("l_suppkey") * 40 + F.col("l_linenumber")))
    s = li.select(F.concat(F.lit("P"), "l_partkey").alias("src"), dst.alias("dst"), F.when(said.isin(*WRITTEN), said).otherwise("CALLS_GUESS").alias("rel_type"), F.col("l_linenumber").alias("line"))
    known = views.nodes(spark, d)
    e = s.where("src <> dst").join(known.select(F.col("uid").alias("src")), "src", "left_semi").join(known.select(F.col("uid").alias("dst")), "dst", "left_semi").distinct()
    return e.select("src", "dst", "rel_type", "line", F.create_map(*[F.lit(x) for kv in WRITTEN.items() for x in kv])[F.col("rel_type")].alias("confidence"))


@register("j03_import_suffix", f"""{views.sql('symbols')}, f AS (SELECT DISTINCT file_path FROM symbols WHERE file_path IS NOT NULL), i AS (SELECT DISTINCT regexp_extract(source_file, '([^/]+)\\.[a-z]+$', 1) AS imported FROM context_docs WHERE source_file IS NOT NULL UNION SELECT regexp_replace(file_path, '\\.[a-z]+$', '') FROM f),
c AS (SELECT imported, unnest([imported || '.go', imported || '.py', imported || '.ts']) AS suffix, unnest([0, 1, 2]) AS place FROM i), x AS (SELECT suffix, min(file_path) AS file_path FROM (SELECT file_path, unnest(list_transform(range(1, least(len(string_split(file_path, '/')), 5) + 1), lambda n: array_to_string(string_split(file_path, '/')[-n:], '/'))) AS suffix FROM f) GROUP BY 1),
m AS (SELECT imported, place, 0 AS rule, f.file_path FROM c JOIN f ON f.file_path = suffix UNION ALL SELECT imported, place, 1, x.file_path FROM c JOIN x USING (suffix)) SELECT imported, first(file_path ORDER BY place, rule, file_path) AS file_path FROM m GROUP BY 1""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    """Imports with several candidate paths: the first candidate that is a path or the end of one."""
    files = views.symbols(spark, d).where("file_path is not null").select("file_path").distinct()
    said = load(spark, d, "context_docs").where("source_file is not null").select(F.regexp_extract("source_file", r"([^/]+)\.[a-z]+$", 1).alias("imported"))
    imp = said.union(files.select(F.regexp_replace("file_path", r"\.[a-z]+$", ""))).distinct()
    return lk.resolve_imports(imp.withColumn("candidates", F.array(*[F.concat("imported", F.lit(e)) for e in (".ts", ".py", ".go")])), files)


_INHERITS = "inherits AS (SELECT a.uid AS sub_uid, b.name AS base_name, a.file_path FROM nodes a JOIN nodes b ON b.key = a.key // 2 WHERE a.kind = 'class'), imports AS (SELECT DISTINCT a.file_path, b.file_path AS imported FROM nodes a JOIN nodes b ON b.key = a.key // 3)"


@register("j04_inheritance_link", f"""{views.sql('nodes')}, {_INHERITS} SELECT DISTINCT sub_uid, n.uid AS base_uid FROM inherits i JOIN nodes n ON n.kind = 'class' AND n.name = i.base_name AND n.uid <> i.sub_uid
AND (n.file_path = i.file_path OR (i.file_path, n.file_path) IN (SELECT (file_path, imported) FROM imports))""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Classes with the bases they name, found in the same file or in an imported one."""
    n = views.nodes(spark, d)
    b = n.select(F.col("key").alias("k"), F.col("name").alias("base_name"), F.col("file_path").alias("imported"))
    inherits = n.where("kind = 'class'").join(b, F.expr("key div 2") == F.col("k")).select(F.col("uid").alias("sub_uid"), "base_name", "file_path")
    imports = n.join(b, F.expr("key div 3") == F.col("k")).select("file_path", "imported")
    return lk.link_bases(inherits, n, imports)


@register("j06_proxy_binding", f"""{views.sql('symbols')}, b AS (SELECT uid AS proxy, CASE WHEN length(name) % 2 = 0 THEN qualified_name ELSE name END AS target FROM symbols WHERE name IS NOT NULL), a AS (SELECT qualified_name AS owner, min(uid) AS accessor FROM symbols WHERE kind = 'method' GROUP BY 1)
SELECT proxy, x.uid, a.accessor FROM (SELECT proxy, s.uid, s.qualified_name, row_number() OVER (PARTITION BY proxy ORDER BY length(s.qualified_name), s.qualified_name, s.uid) AS r FROM b JOIN symbols s ON s.qualified_name = target OR ends_with(s.qualified_name, '.' || target)) x LEFT JOIN a ON a.owner = x.qualified_name WHERE r = 1""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Each proxy's target by its whole name or its last parts, the shortest first, with the accessor if there is one."""
    s = views.symbols(spark, d).where("name is not null")
    b = s.select(F.col("uid").alias("proxy"), F.when(F.length("name") % 2 == 0, F.col("qualified_name")).otherwise(F.col("name")).alias("target"))
    every = views.symbols(spark, d)
    accessor = every.where("kind = 'method'").groupBy("qualified_name").agg(F.min("uid").alias("accessor"))
    return lk.bind_targets(b, every).join(every.select("uid", "qualified_name"), "uid").join(accessor, "qualified_name", "left").select("proxy", "uid", "accessor")


_ROUTE = r"regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(lower(trim(raw)), '\?.*$', ''), '(<[^>]*>|\{[^}]*\}|:[a-z_][a-z0-9_]*)', '{}', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"
_PRINT = lambda p: f"upper(CASE WHEN trim(coalesce({p}.method, '')) = '' THEN 'GET' ELSE trim({p}.method) END) || ' ' || {_ROUTE.replace('raw', p + '.raw')}"


@register("j13_http_bridge", f"""WITH f AS (SELECT DISTINCT file_path FROM context_symbols WHERE file_path IS NOT NULL), h AS (SELECT file_path AS handler, CASE WHEN length(file_path) % 3 = 0 THEN 'POST' ELSE 'get' END AS method, '/' || replace(file_path, '.', '/') || '/{{uid}}/' AS raw FROM f),
c AS (SELECT file_path AS client, CASE WHEN length(file_path) % 2 = 0 THEN ' Post ' END AS method, upper(replace(file_path, '.', '/')) || '//:id?x=1' AS raw FROM f) SELECT client, handler, {_PRINT('c')} AS fingerprint FROM c JOIN h ON {_PRINT('c')} = {_PRINT('h')}""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Clients and handlers that meet on method and route."""
    f = load(spark, d, "context_symbols").where("file_path is not null").select("file_path").distinct()
    p, n = F.replace("file_path", F.lit("."), F.lit("/")), F.length("file_path")
    h = f.select(F.col("file_path").alias("handler"), tx.http_fingerprint(F.when(n % 3 == 0, "POST").otherwise("get"), F.concat(F.lit("/"), p, F.lit("/{uid}/"))).alias("fingerprint"))
    c = f.select(F.col("file_path").alias("client"), tx.http_fingerprint(F.when(n % 2 == 0, " Post "), F.concat(F.upper(p), F.lit("//:id?x=1"))).alias("fingerprint"))
    return c.join(h, "fingerprint")


@register("j14_endpoint_counterpart", f"""{views.sql('nodes', 'relations')} SELECT b.src AS node, 1 AS depth, count(DISTINCT a.src) AS reach FROM relations a JOIN relations b ON a.dst = b.dst AND a.rel_type <> b.rel_type
WHERE a.rel_type LIKE '%ENDPOINT' AND b.rel_type LIKE '%ENDPOINT' AND a.src IN (SELECT uid FROM nodes WHERE size = 5) GROUP BY 1""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """What meets a set of seeds at an endpoint from the other side, with the number of seeds."""
    return gr.counterparts(views.relations(spark, d), views.nodes(spark, d).where("size = 5").select(F.col("uid").alias("node")))


_REFS = r"""refs AS (SELECT DISTINCT regexp_replace(symbol, '\(\)$', '') AS callee, CASE WHEN role = 'user' THEN 'read' ELSE 'write' END AS kind, NULL AS from_file, NULL AS self FROM messages WHERE symbol <> '' UNION SELECT qualified_name, 'read', file_path, uid FROM symbols UNION SELECT name, 'read', file_path, uid FROM symbols WHERE name IS NOT NULL)"""


def _refs(spark: SparkSession, d: str, sy: DataFrame) -> DataFrame:
    """Names that are referred to, with the kind of reference, and where and in what symbol they stand, if that is known."""
    none = F.lit(None).cast("string")
    said = load(spark, d, "messages").where("symbol <> ''").select(F.regexp_replace("symbol", r"\(\)$", "").alias("callee"), F.when(F.col("role") == "user", "read").otherwise("write").alias("kind"), none.alias("from_file"), none.alias("self"))
    return said.union(sy.select("qualified_name", F.lit("read"), "file_path", "uid")).union(sy.where("name is not null").select("name", F.lit("read"), "file_path", "uid")).distinct()


@register("j15_attribute_access", f"""{views.sql('symbols')}, {_REFS}, x AS (SELECT callee, min(uid) AS u FROM (SELECT DISTINCT callee FROM refs) JOIN symbols ON qualified_name = callee GROUP BY 1), n AS (SELECT name AS callee, min(uid) AS u FROM symbols WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT callee, coalesce(x.u, n.u) AS uid, CASE WHEN kind = 'write' THEN 'WRITES_ATTR' ELSE 'READS_ATTR' END AS rel_type FROM refs LEFT JOIN x USING (callee) LEFT JOIN n USING (callee) WHERE coalesce(x.u, n.u) IS NOT NULL""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Attributes resolved by qualified name, else by a bare name that only one symbol has; reads and writes by the reference's kind."""
    sy = views.symbols(spark, d)
    x = sy.groupBy(F.col("qualified_name").alias("callee")).agg(F.min("uid").alias("x"))
    n = lk.unique_by(sy.where("name is not null"), "name").select(F.col("name").alias("callee"), F.col("uid").alias("n"))
    rel = F.when(F.col("kind") == "write", "WRITES_ATTR").otherwise("READS_ATTR")
    return _refs(spark, d, sy).join(x, "callee", "left").join(n, "callee", "left").select("callee", F.coalesce("x", "n").alias("uid"), rel.alias("rel_type")).where("uid is not null").distinct()


_BEST = lambda kinds: f"m AS (SELECT callee, from_file, self, uid, s.kind, 0 AS rule, file_path, qualified_name FROM refs JOIN symbols s ON qualified_name = callee{kinds} UNION ALL SELECT callee, from_file, self, uid, s.kind, 1, file_path, qualified_name FROM refs JOIN symbols s ON name = callee{kinds})"


@register("j16_best_match", f"""{views.sql('symbols')}, {_REFS}, {_BEST("")}, b AS (SELECT callee, from_file, uid FROM (SELECT *, row_number() OVER (PARTITION BY callee, from_file ORDER BY rule, CASE WHEN file_path = from_file THEN 0 ELSE 1 END, length(qualified_name), uid) AS r FROM m) WHERE r = 1),
k AS (SELECT DISTINCT callee, from_file FROM refs) SELECT callee, from_file, coalesce(uid, CASE WHEN contains(callee, '.') THEN 'external:' || string_split(callee, '.')[1] END) AS target FROM k LEFT JOIN b ON b.callee = k.callee AND b.from_file IS NOT DISTINCT FROM k.from_file WHERE coalesce(uid, CASE WHEN contains(callee, '.') THEN 'x' END) IS NOT NULL""".replace("SELECT callee, from_file, coalesce(uid", "SELECT k.callee, k.from_file, coalesce(uid").replace("contains(callee", "contains(k.callee").replace("string_split(callee", "string_split(k.callee"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The best of all candidates: exact names first, then the same file, the shortest name, the uid; dotted names that nothing has are external by their root."""
    sy = views.symbols(spark, d)
    refs = _refs(spark, d, sy).select("callee", "from_file").distinct().withColumn("ref", F.struct("callee", "from_file"))
    near = F.when(F.col("file_path") == F.col("from_file"), 0).otherwise(1)
    best = lk.best_match(refs, sy, "ref", [("callee", "qualified_name"), ("callee", "name")], [F.col("__rule"), near, F.length("qualified_name"), F.col("uid")], ["ref", "uid"])
    root = F.when(F.contains("callee", F.lit(".")), F.concat(F.lit("external:"), tx.external_root(F.col("callee"))))
    j = refs.join(best.withColumnRenamed("ref", "r2"), F.col("ref").eqNullSafe(F.col("r2")), "left")
    return j.select("callee", "from_file", F.coalesce("uid", root).alias("target")).where("target is not null")


@register("j40_kind_lookup", f"""{views.sql('symbols')}, {_REFS}, {_BEST(" AND s.kind = 'class'")}, b AS (SELECT self AS src, uid AS dst, callee FROM (SELECT *, row_number() OVER (PARTITION BY callee, self ORDER BY rule, length(qualified_name), uid) AS r FROM m) WHERE r = 1 AND self IS NOT NULL AND self <> uid)
SELECT src, dst, max(callee) AS type_name FROM b GROUP BY 1, 2""")
def j40(spark: SparkSession, d: str) -> DataFrame:
    """References to types: the best class of the name, never oneself, one edge for each pair with the last of its names."""
    sy = views.symbols(spark, d)
    refs = _refs(spark, d, sy).where("self is not null").select("callee", "self").distinct().withColumn("ref", F.struct("callee", "self"))
    best = lk.best_match(refs, sy.where("kind = 'class'"), "ref", [("callee", "qualified_name"), ("callee", "name")], [F.col("__rule"), F.length("qualified_name"), F.col("uid")], ["ref", "uid"])
    e = best.select(F.col("ref.self").alias("src"), F.col("uid").alias("dst"), F.col("ref.callee").alias("callee")).where("src <> dst")
    return e.groupBy("src", "dst").agg(F.max("callee").alias("type_name"))


@register("j42_symbol_api", f"""{views.sql('nodes', 'relations')} SELECT DISTINCT src, dst FROM relations WHERE rel_type = 'HAS_API' AND src <> dst AND src IN (SELECT uid FROM nodes WHERE kind <> 'class') AND dst IN (SELECT uid FROM nodes)""")
def j42(spark: SparkSession, d: str) -> DataFrame:
    """Edges from owners that are no classes to their members, both known by uid, each once."""
    n = views.nodes(spark, d)
    e = views.relations(spark, d).where("rel_type = 'HAS_API' and src <> dst")
    return e.join(n.where("kind <> 'class'").select(F.col("uid").alias("src")), "src", "left_semi").join(n.select(F.col("uid").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


_MODES = ("ask", "inspect", "impact")
_SNAP = ", ".join(f"{m} AS (SELECT trace_id, arg_max(feedback_token, {{'t': snapshot_at, 'f': feedback_token}}) AS {m} FROM retrieval_snapshots WHERE mode = '{m}' AND trace_id IS NOT NULL AND feedback_token IS NOT NULL GROUP BY 1)" for m in _MODES)


@register("j26_history_bundle", f"""WITH m AS (SELECT DISTINCT id, conversation_id, trace_id FROM messages WHERE id IS NOT NULL), c AS (SELECT id AS conversation_id, min(title) AS title FROM conversations GROUP BY 1), {_SNAP}
SELECT m.id, title, {", ".join(_MODES)} FROM m LEFT JOIN c USING (conversation_id) {" ".join(f"LEFT JOIN {m} USING (trace_id)" for m in _MODES)}""")
def j26(spark: SparkSession, d: str) -> DataFrame:
    """Each message with its conversation and its last ask, inspector and impact snapshots, if there are any."""
    m = load(spark, d, "messages").where("id is not null").select("id", "conversation_id", "trace_id").distinct()
    c = load(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.min("title").alias("title"))
    last = lambda mode: F.max(F.when(F.col("mode") == mode, F.struct("snapshot_at", "feedback_token")))["feedback_token"].alias(mode)
    s = load(spark, d, "retrieval_snapshots").where("trace_id is not null and feedback_token is not null").groupBy("trace_id").agg(*[last(x) for x in _MODES])
    return m.join(c, "conversation_id", "left").join(s, "trace_id", "left").select("id", "title", *_MODES)


_NEAR = "('READS_ATTR', 'USES_TYPE', 'HANDLES', 'CALLS_DIRECT')"


@register("j27_proximity_boost", f"""{views.sql('nodes', 'relations', recursive=True)}, e AS (SELECT src AS s, dst AS t FROM relations WHERE rel_type IN {_NEAR} AND src <> dst UNION SELECT dst, src FROM relations WHERE rel_type IN {_NEAR} AND src <> dst),
w(role, node, depth) AS (SELECT kind, uid, 0 FROM nodes WHERE size = 11 UNION SELECT role, t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 2), h AS (SELECT node, count(DISTINCT role) AS roles FROM w WHERE node IN (SELECT uid FROM nodes WHERE size IN (3, 4, 5)) GROUP BY 1)
SELECT node, roles, round(0.15 * roles, 2)::DOUBLE AS boost FROM h""")
def j27(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one role within two hops of those of others, raised by the number of roles; all of them if none is."""
    n = views.nodes(spark, d)
    e = gr.directed(views.relations(spark, d), "undirected", ["READS_ATTR", "USES_TYPE", "HANDLES", "CALLS_DIRECT"])
    return gr.cross_role(e, n.where("size in (3, 4, 5)").select(F.col("uid").alias("node")), n.where("size = 11").select(F.col("uid").alias("node"), F.col("kind").alias("role")))


_DIRTY = "o AS (SELECT uid, max(code) AS code FROM context_symbols WHERE is_dirty AND uid IS NOT NULL GROUP BY 1), b AS (SELECT uid, max(code) AS code FROM context_symbols WHERE NOT is_dirty AND uid IS NOT NULL GROUP BY 1)"


@register("j29_overlay_override", f"WITH {_DIRTY} SELECT b.uid, md5(coalesce(o.code, b.code)) AS body, o.uid IS NOT NULL AS overlaid FROM b LEFT JOIN o ON o.uid = b.uid")
def j29(spark: SparkSession, d: str) -> DataFrame:
    """Stored bodies, replaced by unsaved ones where there are any (as digests)."""
    s = load(spark, d, "context_symbols").where("uid is not null")
    o = s.where("is_dirty").groupBy("uid").agg(F.max("code").alias("ocode"), F.lit(True).alias("overlaid"))
    b = s.where("not is_dirty").groupBy("uid").agg(F.max("code").alias("code"))
    return b.join(o, "uid", "left").select("uid", F.md5(F.coalesce("ocode", "code")).alias("body"), F.coalesce("overlaid", F.lit(False)).alias("overlaid"))


_SPANS = "s AS (SELECT DISTINCT file_path, uid, symbol, start_line, end_line FROM context_symbols WHERE uid IS NOT NULL AND symbol IS NOT NULL AND file_path IS NOT NULL AND start_line <= end_line)"


@register("j36_enclosing_symbol", f"""WITH {_SPANS}, p AS (SELECT DISTINCT a.file_path, a.start_line + 1 AS line, b.symbol AS name FROM s a JOIN s b ON b.file_path = a.file_path),
i AS (SELECT *, row_number() OVER (PARTITION BY p.file_path, line, name ORDER BY end_line - start_line, start_line, uid) AS r FROM p JOIN s ON s.file_path = p.file_path AND line BETWEEN start_line AND end_line),
o AS (SELECT name, file_path, uid, min(line) AS line FROM i WHERE r = 1 AND symbol <> name GROUP BY 1, 2, 3) SELECT file_path, uid, name, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_path, line, uid) AS k FROM o) WHERE k <= 50""")
def j36(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each name by the innermost symbol around its call sites, once a file and caller, 50 of a name at most."""
    s = load(spark, d, "context_symbols").where("uid is not null and symbol is not null and file_path is not null and start_line <= end_line").select("file_path", "uid", "symbol", F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    sites = s.select("file_path", (F.col("start") + 1).alias("line")).join(s.select("file_path", F.col("symbol").alias("name")), "file_path").distinct()
    return lk.overlay_callers(sites, s)


@register("j37_containment", """WITH s AS (SELECT file_path, uid, start_line AS "start", end_line AS "end", list_sort(list_distinct(flatten(list(coalesce(provenance, []))))) AS channels, max(CASE WHEN isfinite(relevance_score) THEN relevance_score END) AS score FROM context_symbols WHERE uid IS NOT NULL AND file_path IS NOT NULL AND start_line <= end_line GROUP BY 1, 2, 3, 4),
h AS (SELECT a.uid, b."start", b."end", b.channels, b.score FROM s a JOIN s b ON a.file_path = b.file_path AND a.uid <> b.uid AND b."start" >= a."start" AND b."end" <= a."end"), e AS (SELECT * FROM h UNION ALL SELECT uid, "start", "end", channels, score FROM s WHERE uid IN (SELECT uid FROM h))
SELECT uid, list_sort(list_distinct(flatten(list(channels)))) AS channels, len(list_distinct(list({'a': "start", 'b': "end"}))) AS n_spans, round(max(score), 6) AS score FROM e GROUP BY 1""")
def j37(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the evidence of those whose lines lie within theirs: all channels, all spans, the best score."""
    s = load(spark, d, "context_symbols").where("uid is not null and file_path is not null and start_line <= end_line")
    fin = F.when(~F.isnan("relevance_score") & (F.abs("relevance_score") < float("inf")), F.col("relevance_score"))
    each = s.select("file_path", "uid", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.explode_outer("provenance").alias("c"), fin.alias("score"))
    c = each.groupBy("file_path", "uid", "start", "end").agg(F.collect_set("c").alias("channels"), F.max("score").alias("score"))
    return lk.promote_contained(c).select("uid", "channels", F.size("spans").alias("n_spans"), F.round("score", 6).alias("score"))


@register("r21_budget_profile", "SELECT feedback_token, CASE WHEN intent IN ('impact_analysis', 'trace_dependency', 'impact', 'trace') THEN 6000 ELSE 12000 END AS budget FROM retrieval_snapshots")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """Token budget by intent, from a base of 6000: impact has it once, everything else twice."""
    return load(spark, d, "retrieval_snapshots").select("feedback_token", tx.budget(F.col("intent"), F.lit(6000)).alias("budget"))


@register("w13_preferred_latest", "SELECT conversation_id, request_id, arg_min(id, {'p': CASE WHEN lower(trim(role)) = 'assistant' THEN 0 ELSE 1 END, 't': -epoch_ms(coalesce(try_cast(created_at AS TIMESTAMPTZ), TIMESTAMPTZ '1970-01-01 00:00:00+00')), 'i': id}) AS id FROM messages WHERE conversation_id IS NOT NULL AND request_id IS NOT NULL AND id IS NOT NULL AND regexp_full_match(created_at, '\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)') GROUP BY 1, 2")
def w13(spark: SparkSession, d: str) -> DataFrame:
    """One message of each request, the assistant's if there is one, the latest of them; among those with a time in ISO notation with an offset."""
    m = load(spark, d, "messages").where("conversation_id is not null and request_id is not null and id is not null")
    m = m.where(F.col("created_at").rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"))
    at = F.coalesce(F.unix_millis(F.col("created_at").try_cast("timestamp")), F.lit(0))
    first = F.min(F.struct(F.when(F.lower(F.trim("role")) == "assistant", 0).otherwise(1).alias("p"), (-at).alias("t"), F.col("id")))
    return m.groupBy("conversation_id", "request_id").agg(first["id"].alias("id"))


@register("a22_files_with_counts", f"{views.sql('symbols')}, f AS (SELECT DISTINCT source_file AS file FROM context_docs WHERE source_file IS NOT NULL UNION SELECT file_path FROM symbols WHERE file_path IS NOT NULL) SELECT file, count(uid) AS symbols FROM f LEFT JOIN symbols ON file_path = file GROUP BY 1")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the number of its symbols, zero kept."""
    n = views.symbols(spark, d).where("file_path is not null").groupBy(F.col("file_path").alias("file")).agg(F.count("uid").alias("symbols"))
    f = load(spark, d, "context_docs").where("source_file is not null").select(F.col("source_file").alias("file")).union(n.select("file")).distinct()
    return f.join(n, "file", "left").select("file", F.coalesce("symbols", F.lit(0)).alias("symbols"))


@register("a16_chunk_rollup", f"{views.sql('chunks')} SELECT owner_uid, min(score) AS best, count(*) AS n, list_sort(list_distinct(list(source_file))) AS files FROM chunks WHERE owner_uid IS NOT NULL AND isfinite(score) GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    """Chunks rolled up to their owners: the nearest, how many, and where they stand."""
    c = views.chunks(spark, d).where("owner_uid is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    return c.groupBy("owner_uid").agg(F.min("score").alias("best"), F.count("*").alias("n"), F.sort_array(F.collect_set("source_file")).alias("files"))


QUERIES, ORACLES = R.queries, R.oracles
