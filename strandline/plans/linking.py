"""Queries on the linking of edges, on bridges between files, and on the rest of the read paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import views
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import selection as se
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register


@register("j05_extends_external", f"{views.sql('symbols')}, b AS (SELECT uid, file_path, unnest(string_split(name, '_')) AS alias FROM symbols WHERE name IS NOT NULL AND file_path IS NOT NULL), i AS (SELECT DISTINCT file_path, direction AS alias FROM context_symbols WHERE file_path IS NOT NULL AND direction IS NOT NULL UNION SELECT DISTINCT file_path, 'load' FROM context_symbols WHERE file_path IS NOT NULL) SELECT DISTINCT uid, alias FROM b JOIN i USING (file_path, alias)")
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Base names exploded and joined on file and local alias."""
    b = views.symbols(spark, d).where("name is not null and file_path is not null").select("uid", "file_path", F.explode(F.split("name", "_")).alias("alias"))
    f = load(spark, d, "context_symbols").where("file_path is not null")
    i = f.where("direction is not null").select("file_path", F.col("direction").alias("alias")).union(f.select("file_path", F.lit("load"))).distinct()
    return b.join(i, ["file_path", "alias"]).select("uid", "alias").distinct()


@register("j07_proxy_forwarding", f"{views.sql('edges')}, b AS (SELECT src AS proxy, dst AS owner FROM edges WHERE rel_type = 'DEPENDS_ON'), h AS (SELECT dst AS owner, min(src) AS method FROM edges WHERE rel_type = 'USES_TYPE' GROUP BY 1), o AS (SELECT dst AS owner, min(src) AS method FROM edges WHERE rel_type = 'CALLS_DIRECT' GROUP BY 1) SELECT proxy, coalesce(h.method, o.method) AS method FROM b LEFT JOIN h USING (owner) LEFT JOIN o USING (owner) WHERE coalesce(h.method, o.method) IS NOT NULL")
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Calls through a proxy, forwarded to its target's method, by its surface or else by its own."""
    e = views.edges(spark, d)
    least = lambda rel, name: e.where(F.col("rel_type") == rel).groupBy(F.col("dst").alias("owner")).agg(F.min("src").alias(name))
    b = e.where("rel_type = 'DEPENDS_ON'").select(F.col("src").alias("proxy"), F.col("dst").alias("owner"))
    return b.join(least("USES_TYPE", "h"), "owner", "left").join(least("CALLS_DIRECT", "o"), "owner", "left").select("proxy", F.coalesce("h", "o").alias("method")).where("method is not null")


@register("j08_decorator_links", f"{views.sql('symbols')}, d AS (SELECT uid AS decorated, 'register' AS deco FROM symbols WHERE kind = 'class' UNION ALL SELECT uid, string_split(name, '_')[1] FROM symbols WHERE kind = 'method' AND name IS NOT NULL), c AS (SELECT d.decorated, s.uid, row_number() OVER (PARTITION BY decorated ORDER BY length(s.qualified_name), s.qualified_name, s.uid) AS r FROM d JOIN symbols s ON string_split(s.name, '_')[1] = deco AND s.kind = 'function' AND s.uid <> d.decorated) SELECT decorated AS src, uid AS dst, 'DECORATED_BY' AS rel_type FROM c WHERE r = 1 UNION ALL SELECT uid, decorated, 'HANDLES' FROM c WHERE r = 1")
def j08(spark: SparkSession, d: str) -> DataFrame:
    """Decorators resolved to one function each, and the links both ways."""
    s = views.symbols(spark, d)
    head = F.substring_index("name", "_", 1)
    deco = s.where("kind = 'class'").select(F.col("uid").alias("decorated"), F.lit("register").alias("deco")).union(s.where("kind = 'method' and name is not null").select("uid", head))
    fn = s.where("kind = 'function'").select("uid", "qualified_name", head.alias("deco"))
    c = lk.first_by(deco.join(fn, "deco").where("uid <> decorated"), ["decorated"], [F.length("qualified_name"), F.col("qualified_name"), F.col("uid")])
    return c.select(F.col("decorated").alias("src"), F.col("uid").alias("dst"), F.lit("DECORATED_BY").alias("rel_type")).union(c.select("uid", "decorated", F.lit("HANDLES")))


@register("j17_reexports", f"{views.sql('symbols')}, r AS (SELECT DISTINCT source_file, lower(regexp_extract(source_file, '([^/]+)\\.[a-z]+$', 1)) AS name FROM context_docs WHERE source_file IS NOT NULL), m AS (SELECT source_file, uid, row_number() OVER (PARTITION BY source_file ORDER BY length(qualified_name), qualified_name, uid) AS k FROM r JOIN symbols s ON lower(s.name) = r.name) SELECT source_file, uid FROM m WHERE k = 1")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Files linked to the symbol that they re-export."""
    r = load(spark, d, "context_docs").where("source_file is not null").select("source_file", F.lower(F.regexp_extract("source_file", r"([^/]+)\.[a-z]+$", 1)).alias("n")).distinct()
    s = views.symbols(spark, d).withColumn("n", F.lower("name"))
    return lk.first_by(r.join(s, "n"), ["source_file"], [F.length("qualified_name"), F.col("qualified_name"), F.col("uid")]).select("source_file", "uid")


@register("j18_flow_pairs", f"{views.sql('symbols')}, u AS (SELECT name, min(uid) AS uid FROM symbols WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) = 1), p AS (SELECT DISTINCT regexp_replace(a.symbol, '\\(\\)$', '') AS a, regexp_replace(b.symbol, '\\(\\)$', '') AS b FROM messages a JOIN messages b ON a.conversation_id = b.conversation_id AND a.request_id = b.request_id WHERE a.symbol <> '' AND b.symbol <> '' AND a.role = 'user' AND b.role = 'assistant') SELECT x.uid AS src, y.uid AS dst FROM p JOIN u x ON x.name = p.a JOIN u y ON y.name = p.b WHERE x.uid <> y.uid GROUP BY 1, 2")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose both ends resolve to one symbol."""
    u = lk.unique_by(views.symbols(spark, d).where("name is not null"), "name").select("name", "uid")
    m = load(spark, d, "messages").where("symbol <> '' and conversation_id is not null and request_id is not null").select("conversation_id", "request_id", "role", F.regexp_replace("symbol", r"\(\)$", "").alias("s"))
    side = lambda role, c: m.where(F.col("role") == role).select("conversation_id", "request_id", F.col("s").alias(c)).distinct()
    p = side("user", "a").join(side("assistant", "b"), ["conversation_id", "request_id"]).select("a", "b").distinct()
    return p.join(u.select(F.col("name").alias("a"), F.col("uid").alias("src")), "a").join(u.select(F.col("name").alias("b"), F.col("uid").alias("dst")), "b").where("src <> dst").select("src", "dst").distinct()


@register("j20_external_boundary", f"{views.sql('symbols')} SELECT DISTINCT file_path, string_split(name, '_')[1] AS package FROM symbols WHERE name LIKE '%\\_%' ESCAPE '\\' AND file_path IS NOT NULL AND string_split(name, '_')[1] NOT IN (SELECT DISTINCT regexp_extract(file_path, '^([^/]+)/', 1) FROM symbols WHERE file_path IS NOT NULL) AND string_split(name, '_')[1] <> ''")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """Links from files to packages that are not the project's own."""
    s = views.symbols(spark, d).where("file_path is not null")
    own = s.select(F.regexp_extract("file_path", "^([^/]+)/", 1).alias("package"))
    used = s.where("instr(name, '_') > 0").select("file_path", F.substring_index("name", "_", 1).alias("package")).where("package <> ''").distinct()
    return used.join(own, "package", "left_anti").select("file_path", "package")


@register("a14_bm25_stats", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every term."""
    t = load(spark, d, "documents").select("doc_id", F.explode(tx.identifier_parts(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register("a27_distinct", "SELECT DISTINCT source, lang FROM documents")
def a27(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows."""
    return load(spark, d, "documents").select("source", "lang").distinct()


@register("k05_prompt_order", "SELECT uid, row_number() OVER (PARTITION BY feedback_token ORDER BY p, depth NULLS LAST, s DESC NULLS LAST, uid) AS place, feedback_token FROM (SELECT feedback_token, uid, min(CASE WHEN direction = 'caller' THEN 0 ELSE 1 END) AS p, min(depth) AS depth, max(CASE WHEN isfinite(relevance_score) THEN relevance_score END) AS s FROM context_symbols WHERE feedback_token IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2)")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in the order of a prompt: callers first, then by depth and score."""
    fin = F.when(~F.isnan("relevance_score") & (F.abs("relevance_score") < float("inf")), F.col("relevance_score"))
    g = load(spark, d, "context_symbols").where("feedback_token is not null and uid is not null").groupBy("feedback_token", "uid").agg(F.min(F.when(F.col("direction") == "caller", 0).otherwise(1)).alias("p"), F.min("depth").alias("depth"), F.max(fin).alias("s"))
    return g.select("uid", F.row_number().over(W.partitionBy("feedback_token").orderBy("p", F.asc_nulls_last("depth"), F.desc_nulls_last("s"), "uid")).alias("place"), "feedback_token")


@register("k06_docs_for", f"{views.sql('chunks')} SELECT owner_uid, chunk_id FROM (SELECT owner_uid, chunk_id, row_number() OVER (PARTITION BY owner_uid ORDER BY score DESC NULLS LAST, chunk_id) AS r FROM chunks WHERE owner_uid IS NOT NULL) WHERE r <= 3")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks of each symbol."""
    return lk.top_by(views.chunks(spark, d).where("owner_uid is not null"), ["owner_uid"], [F.desc_nulls_last("score"), F.col("chunk_id")], 3).select("owner_uid", "chunk_id")


@register("k07_file_outline", f"{views.sql('symbols')} SELECT file_path, start_line, name, uid FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, uid) AS r FROM symbols WHERE file_path IS NOT NULL) WHERE r <= 20")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """The outline of every file."""
    return lk.top_by(views.symbols(spark, d).where("file_path is not null"), ["file_path"], [F.col("start_line"), F.col("uid")], 20).select("file_path", "start_line", "name", "uid")


@register("u02_exclude_seen", f"{views.sql('symbols')} SELECT uid FROM symbols WHERE uid NOT IN (SELECT uid FROM context_symbols WHERE uid IS NOT NULL AND depth = 0)")
def u02(spark: SparkSession, d: str) -> DataFrame:
    """What has not been shown yet."""
    return views.symbols(spark, d).join(load(spark, d, "context_symbols").where("depth = 0").select("uid"), "uid", "left_anti").select("uid")


@register("u05_affected_files", "SELECT file_path FROM context_symbols WHERE depth = 1 AND file_path IS NOT NULL UNION SELECT source_file FROM context_docs WHERE anchor_type = 'warning' AND source_file IS NOT NULL")
def u05(spark: SparkSession, d: str) -> DataFrame:
    """Union of two sets of files."""
    a = load(spark, d, "context_symbols").where("depth = 1 and file_path is not null").select("file_path")
    return a.union(load(spark, d, "context_docs").where("anchor_type = 'warning' and source_file is not null").select("source_file")).distinct()


@register("u07_axis_sets", "SELECT DISTINCT uid, list_sort(list_intersect(provenance, ['graph:calls', 'graph:affects', 'lexical'])) AS axes FROM context_symbols WHERE uid IS NOT NULL AND provenance IS NOT NULL")
def u07(spark: SparkSession, d: str) -> DataFrame:
    """A row's axes among those to discover."""
    s = load(spark, d, "context_symbols").where("uid is not null and provenance is not null")
    return s.select("uid", F.array_sort(F.array_intersect("provenance", F.array(*map(F.lit, ("graph:calls", "graph:affects", "lexical"))))).alias("axes")).distinct()


@register("g06_affected_files", f"{views.sql('edges')}, a AS (SELECT DISTINCT src FROM edges WHERE rel_type = 'DEPENDS_ON' AND dst IN ('P1', 'P2', 'P3', 'P5', 'P8')) SELECT DISTINCT p_brand AS file_path FROM part JOIN a ON src = 'P' || p_partkey")
def g06(spark: SparkSession, d: str) -> DataFrame:
    """Files of what depends on a set."""
    a = views.edges(spark, d).where("rel_type = 'DEPENDS_ON'").where(F.col("dst").isin("P1", "P2", "P3", "P5", "P8")).select("src")
    p = load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.col("p_brand").alias("file_path"))
    return p.join(a, "src", "left_semi").select("file_path").distinct()


@register("g24_hook_lifecycle", f"{views.sql('edges')} SELECT a.src AS declared, a.dst AS via, b.src AS registered FROM edges a JOIN edges b ON a.dst = b.dst AND b.rel_type = 'CALLS_IMPORTED' WHERE a.rel_type = 'USES_TYPE' AND a.src = 'S2'")
def g24(spark: SparkSession, d: str) -> DataFrame:
    """From a declaration to its registrations."""
    e = views.edges(spark, d)
    a = e.where("rel_type = 'USES_TYPE' and src = 'S2'").select(F.col("src").alias("declared"), F.col("dst").alias("via"))
    return a.join(e.where("rel_type = 'CALLS_IMPORTED'").select(F.col("dst").alias("via"), F.col("src").alias("registered")), "via")


@register("g26_nearest_expansion", "SELECT feedback_token, uid FROM (SELECT feedback_token, uid, row_number() OVER (PARTITION BY feedback_token ORDER BY dp, s DESC NULLS LAST, uid) AS r FROM (SELECT feedback_token, uid, min(depth) AS dp, round(max(CASE WHEN isfinite(relevance_score) THEN relevance_score END), 6) AS s FROM context_symbols WHERE feedback_token IS NOT NULL AND uid IS NOT NULL AND depth IS NOT NULL GROUP BY 1, 2)) WHERE r <= 4")
def g26(spark: SparkSession, d: str) -> DataFrame:
    """Four expansions of each seed, nearest first, then most alike."""
    fin = F.when(~F.isnan("relevance_score") & (F.abs("relevance_score") < float("inf")), F.col("relevance_score"))
    g = load(spark, d, "context_symbols").where("feedback_token is not null and uid is not null and depth is not null").groupBy("feedback_token", "uid").agg(F.min("depth").alias("dp"), F.round(F.max(fin), 6).alias("s"))
    return lk.top_by(g, ["feedback_token"], [F.col("dp"), F.desc_nulls_last("s"), F.col("uid")], 4).select("feedback_token", "uid")


@register("r12_anchor_seeds", "SELECT chunk_id, owner_uid, score FROM context_docs WHERE owner_uid IS NOT NULL AND trim(owner_uid) <> '' AND isfinite(score) ORDER BY score DESC, chunk_id, owner_uid LIMIT 40")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """Owners of the best anchored chunks, repeats allowed."""
    c = load(spark, d, "context_docs").where("owner_uid is not null and trim(owner_uid) <> '' and score is not null and not isnan(score) and abs(score) < double('infinity')")
    return c.select("chunk_id", "owner_uid", "score").orderBy(F.desc("score"), "chunk_id", "owner_uid").limit(40)


_PROBE = "['queue', 'retry', 'resolver', 'cache', 'token']"
_PARTS = r"regexp_extract_all(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]+')"


@register("r22_span_probe", f"""WITH c AS (SELECT uid, string_split(max(code), chr(10)) AS l FROM context_symbols WHERE code IS NOT NULL AND code <> '' AND uid IS NOT NULL GROUP BY 1), h AS (SELECT uid, list_transform(l, lambda x: list_filter({_PARTS}, lambda w: list_contains({_PROBE}, w))) AS h FROM c),
w AS (SELECT uid, h, unnest(range(1, greatest(len(h) - 5, 1) + 1)) AS line FROM h), s AS (SELECT uid, line, len(list_distinct(flatten(h[line:line + 5]))) AS score FROM w) SELECT uid, max(score) AS score, arg_max(line, {{'s': score, 'l': -line}}) AS line FROM s GROUP BY 1 HAVING max(score) > 0""")
def r22(spark: SparkSession, d: str) -> DataFrame:
    """The six lines of each symbol that share most words with a query; ties to the first."""
    words = F.array(*map(F.lit, ("queue", "retry", "resolver", "cache", "token")))
    c = load(spark, d, "context_symbols").where("code is not null and code <> '' and uid is not null").groupBy("uid").agg(F.max("code").alias("code"))
    return _best_window(c, words)


def _best_window(c: DataFrame, words: Column) -> DataFrame:
    hits = F.transform(F.split("code", "\n"), lambda x: F.array_intersect(tx.identifier_parts(x), words))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("hits") - 5, F.lit(1))), lambda i: F.struct(F.size(F.array_distinct(F.flatten(F.slice("hits", i, 6)))).alias("score"), (-i).alias("neg")))
    c = c.select("uid", hits.alias("hits"))
    return c.select("uid", F.array_max(spans).alias("b")).where("b.score > 0").select("uid", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("line"))


@register("o07_bundle_assembly", "WITH t AS (SELECT feedback_token, max(selected_count) AS k FROM retrieval_snapshots WHERE feedback_token IS NOT NULL GROUP BY 1), c AS (SELECT feedback_token, uid, max(CASE WHEN isfinite(relevance_score) THEN relevance_score END) AS s, max(code) AS code FROM context_symbols WHERE feedback_token IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feedback_token ORDER BY s DESC NULLS LAST, uid) AS n FROM c) SELECT feedback_token, list(uid ORDER BY n) AS uids, sum((length(coalesce(code, '')) + 3) // 4)::BIGINT AS tokens FROM r JOIN t USING (feedback_token) WHERE n <= k GROUP BY 1")
def o07(spark: SparkSession, d: str) -> DataFrame:
    """The bundle of each snapshot: its symbols in order and their tokens."""
    fin = F.when(~F.isnan("relevance_score") & (F.abs("relevance_score") < float("inf")), F.col("relevance_score"))
    t = load(spark, d, "retrieval_snapshots").where("feedback_token is not null").groupBy("feedback_token").agg(F.max("selected_count").alias("k"))
    c = load(spark, d, "context_symbols").where("feedback_token is not null and uid is not null").groupBy("feedback_token", "uid").agg(F.max(fin).alias("s"), F.max("code").alias("code"))
    c = c.select("feedback_token", "uid", "s", tx.token_estimate(F.coalesce("code", F.lit(""))).alias("tokens")).withColumn("n", F.row_number().over(W.partitionBy("feedback_token").orderBy(F.desc_nulls_last("s"), "uid")))
    b = c.join(t, "feedback_token").where("n <= k").groupBy("feedback_token").agg(F.sort_array(F.collect_list(F.struct("n", "uid"))).alias("x"), F.sum("tokens").alias("tokens"))
    return b.select("feedback_token", F.transform("x", lambda s: s["uid"]).alias("uids"), "tokens")


@register("o08_prompt_json", "SELECT uid, '{\"name\":\"' || min(symbol) || '\",\"kind\":\"' || min(kind) || '\"}' AS json FROM context_symbols WHERE uid IS NOT NULL AND symbol IS NOT NULL AND kind IS NOT NULL GROUP BY 1")
def o08(spark: SparkSession, d: str) -> DataFrame:
    """Symbols as JSON."""
    s = load(spark, d, "context_symbols").where("uid is not null and symbol is not null and kind is not null").groupBy("uid").agg(F.min("symbol").alias("name"), F.min("kind").alias("kind"))
    return s.select("uid", F.to_json(F.struct("name", "kind")).alias("json"))


@register("c03_container_kinds", "WITH x AS (SELECT uid, list(DISTINCT relation) AS rels, count(DISTINCT feedback_token) AS n FROM context_symbols WHERE uid IS NOT NULL AND relation IS NOT NULL GROUP BY 1) SELECT uid, CASE WHEN len(list_filter(rels, lambda r: r LIKE '%caller%')) > 0 AND n >= 3 THEN 'registry' WHEN len(list_filter(rels, lambda r: r LIKE '%\\_in' ESCAPE '\\')) > 0 THEN 'dispatcher' ELSE 'none' END AS kind FROM x")
def c03(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by presence and absence of facts, as conditional aggregates."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    s = load(spark, d, "context_symbols").where("uid is not null and relation is not null")
    k = F.when(has(F.col("relation").contains("caller")) & (F.countDistinct("feedback_token") >= 3), "registry").when(has(F.col("relation").endswith("_in")), "dispatcher").otherwise("none")
    return s.groupBy("uid").agg(k.alias("kind"))


@register("c06_graph_probes", f"{views.sql('edges')} SELECT src AS node, count(DISTINCT dst) FILTER (WHERE rel_type LIKE 'CALLS%') AS calls, count(DISTINCT dst) FILTER (WHERE rel_type = 'USES_TYPE') AS uses, count(DISTINCT rel_type) AS kinds FROM edges GROUP BY 1")
def c06(spark: SparkSession, d: str) -> DataFrame:
    """Counts that the rules ask for, for all nodes at once."""
    n = lambda c: F.countDistinct(F.when(c, F.col("dst")))
    return views.edges(spark, d).groupBy(F.col("src").alias("node")).agg(n(F.col("rel_type").startswith("CALLS")).alias("calls"), n(F.col("rel_type") == "USES_TYPE").alias("uses"), F.countDistinct("rel_type").alias("kinds"))


@register("t06_relink_file", f"{views.sql('edges')} SELECT src, dst, rel_type FROM edges WHERE src NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_brand = 'Brand#11') UNION ALL SELECT 'P' || p_partkey, 'P' || (p_partkey // 3), 'DEPENDS_ON' FROM part WHERE p_brand = 'Brand#11'")
def t06(spark: SparkSession, d: str) -> DataFrame:
    """A file's derived edges removed and linked again."""
    f = load(spark, d, "part").where("p_brand = 'Brand#11'")
    fresh = f.select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("P"), F.expr("p_partkey div 3")).alias("dst"), F.lit("DEPENDS_ON").alias("rel_type"))
    return views.edges(spark, d).select("src", "dst", "rel_type").join(fresh.select("src"), "src", "left_anti").unionByName(fresh)


@register("t07_degree_healing", f"{views.sql('edges')}, c AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_size = 3), a AS (SELECT node FROM c UNION SELECT dst FROM edges WHERE src IN (SELECT node FROM c) UNION SELECT src FROM edges WHERE dst IN (SELECT node FROM c)) SELECT node, (SELECT count(*) FROM edges WHERE dst = a.node) AS degree_in, (SELECT count(*) FROM edges WHERE src = a.node) AS degree_out FROM a")
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Degrees recomputed for changed nodes and their neighbours only."""
    e = views.edges(spark, d)
    c = load(spark, d, "part").where("p_size = 3").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    near = e.join(c, e["src"] == c["node"], "left_semi").select(F.col("dst").alias("node")).union(e.join(c, e["dst"] == c["node"], "left_semi").select("src"))
    touched = c.union(near).distinct()
    return gr.degrees(e).join(touched, "node", "right").select("node", F.coalesce("degree_in", F.lit(0)).alias("degree_in"), F.coalesce("degree_out", F.lit(0)).alias("degree_out"))


QUERIES, ORACLES = R.queries, R.oracles
