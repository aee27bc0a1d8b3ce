"""Queries on sources, sinks as relations, predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..session import checkpoint_dir
from ..sources import files, stores
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register
WS = "aldermoor/ember@release-2"


@register("s03_committed_filter", "SELECT DISTINCT target FROM index_jobs WHERE target IS NOT NULL AND lower(trim(status)) = 'completed' AND target NOT IN (SELECT target FROM index_jobs WHERE target IS NOT NULL AND lower(trim(status)) = 'dead_letter')")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are tracked (completed once) and not dirty (never given up): a semi-join and an anti-join."""
    j = load(spark, d, "index_jobs").where("target is not null").select("target", F.lower(F.trim("status")).alias("s"))
    tracked, dirty = j.where("s = 'completed'").select("target").distinct(), j.where("s = 'dead_letter'").select("target")
    return tracked.join(dirty, "target", "left_anti")


@register("s04_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each text."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@register("s06_workspace_scan", f"SELECT chunk_id, source_file, score FROM context_docs WHERE workspace_id = '{WS}' AND score >= 0.3")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """A workspace's rows with a predicate; both reach the Parquet scan."""
    return load(spark, d, "context_docs").where((F.col("workspace_id") == WS) & (F.col("score") >= 0.3)).select("chunk_id", "source_file", "score")


@register("s07_anchor_scan", "SELECT chunk_id, owner_uid, anchor_type FROM context_docs WHERE owner_uid IS NOT NULL AND trim(owner_uid) <> ''")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that belong to a symbol."""
    return load(spark, d, "context_docs").where("owner_uid is not null and trim(owner_uid) <> ''").select("chunk_id", "owner_uid", "anchor_type")


@register("s08_columnar_scan", """SELECT feedback_token, uid, CASE WHEN isfinite(scores['semantic_score']) THEN scores['semantic_score'] END AS semantic_score, CASE WHEN isfinite(scores['graph_score']) THEN scores['graph_score'] END AS graph_score, len(provenance) AS n_provenance FROM context_symbols
WHERE NOT (regexp_matches(lower(file_path), '(^|/)(tests|test|t|__tests__|testfixtures|__testfixtures__|integration|e2e)/') OR regexp_matches(lower(file_path), '(^|/)(test_[^/]*|[^/]*_test)\\.py$|(^|/)conftest\\.py$'))""")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and unpacked scores of the symbols outside tests; scores that are no finite numbers are null."""
    finite = lambda n: F.when(~F.isnan(F.col("scores")[n]) & (F.abs(F.col("scores")[n]) < float("inf")), F.col("scores")[n]).alias(n)
    s = load(spark, d, "context_symbols").where(~tx.is_test_path(F.col("file_path")))
    return s.select("feedback_token", "uid", finite("semantic_score"), finite("graph_score"), F.size("provenance").alias("n_provenance"))


@register("s09_prefix_scan", f"{views.sql('symbols')} SELECT uid, file_path FROM symbols WHERE file_path = 'sync' OR starts_with(file_path, 'sync/') OR file_path = 'api' OR starts_with(file_path, 'api/')")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """Symbols at or under one of several path prefixes."""
    p = F.col("file_path")
    cond = F.lit(False)
    for x in ("sync", "api"):
        cond = cond | (p == x) | p.startswith(x + "/")
    return views.symbols(spark, d).where(cond).select("uid", "file_path")


@register("s10_payload_fetch", f"{views.sql('symbols')} SELECT uid, name, kind FROM symbols WHERE uid IN (SELECT uid FROM context_symbols WHERE utility_score > 1000)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Payload of a set of symbols by a semi-join."""
    wanted = load(spark, d, "context_symbols").where("utility_score > 1000").select("uid")
    return views.symbols(spark, d).join(wanted, "uid", "left_semi").select("uid", "name", "kind")


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version, content_hash ORDER BY last_used_at DESC NULLS LAST, created_at DESC NULLS LAST, embedding_hash DESC NULLS LAST) AS n FROM embedding_cache) WHERE n = 1"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    keys = ["model_name", "model_version", "content_hash"]
    slim = load(spark, d, "embedding_cache").select(*keys, "embedding_hash", "last_used_at", "created_at")
    return slim.groupBy(*keys).agg(F.max(F.struct("last_used_at", "created_at", "embedding_hash"))["embedding_hash"].alias("embedding_hash"))


@register("s15_cache_lookup", f"SELECT DISTINCT p.probe_id, c.embedding_hash, c.content_hash IS NOT NULL AS hit FROM vector_probes p LEFT JOIN ({_LATEST}) c USING (model_name, model_version, content_hash)")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Each key's newest cache entry, or a miss."""
    c = _cache(spark, d).withColumn("hit", F.lit(True))
    return load(spark, d, "vector_probes").join(c, ["model_name", "model_version", "content_hash"], "left").select("probe_id", "embedding_hash", F.coalesce("hit", F.lit(False)).alias("hit")).distinct()


@register("s20_patch_adjacency", "SELECT o_orderkey, o_orderstatus, false AS patched FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_orderkey, lower(o_orderstatus), true FROM orders WHERE o_custkey % 10 = 0")
def s20(spark: SparkSession, d: str) -> DataFrame:
    """Patch of the rows of some owners: anti-join, then union with their new rows."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    patch = o.where("o_custkey % 10 = 0").withColumn("o_orderstatus", F.lower("o_orderstatus")).withColumn("patched", F.lit(True))
    rest = o.join(patch.select("o_custkey").distinct(), "o_custkey", "left_anti").withColumn("patched", F.lit(False))
    return rest.unionByName(patch).drop("o_custkey")


@register("s21_delete_by_prefix", f"{views.sql('symbols')} SELECT uid FROM symbols WHERE NOT (starts_with(file_path, 'cli/') OR starts_with(file_path, 'core/')) OR file_path IS NULL")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """What is left after rows under some prefixes are deleted."""
    p = F.col("file_path")
    return views.symbols(spark, d).where(~F.coalesce(p.startswith("cli/") | p.startswith("core/"), F.lit(False))).select("uid")


@register("s22_graph_merge", "SELECT target, arg_max(status, {'u': coalesce(updated_at, -1), 'i': id, 's': status}) AS status, count(*) AS n FROM index_jobs WHERE target IS NOT NULL AND status IS NOT NULL GROUP BY target")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent upsert by key: the newest version of each, aggregated before the shuffle."""
    j = load(spark, d, "index_jobs").where("target is not null and status is not null")
    return j.groupBy("target").agg(F.max(F.struct(F.coalesce("updated_at", F.lit(-1)), "id", "status"))["status"].alias("status"), F.count("*").alias("n"))


@register("f01_bits_predicate", "SELECT DISTINCT uid FROM context_symbols WHERE list_contains(provenance, 'vector:symbols') AND list_contains(provenance, 'lexical')")
def f01(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have all of several bits."""
    cond = F.lit(True)
    for bit in sorted({"lexical", "vector:symbols"}):
        cond = cond & F.array_contains("provenance", bit)
    return load(spark, d, "context_symbols").where(cond).select("uid").distinct()


_TESTS = r"(regexp_matches(lower(file_path), '(^|/)(tests|test|t|__tests__|testfixtures|__testfixtures__|integration|e2e)/') OR regexp_matches(lower(file_path), '(^|/)(test_[^/]*|[^/]*_test)\.py$|(^|/)conftest\.py$'))"
_FOLDERS = lambda names: "regexp_matches(lower(file_path), '(^|/)(" + "|".join(names) + ")/')"
_NAME = "regexp_extract(file_path, '([^/]*)$', 1)"
_TIER = f"""CASE WHEN coalesce(file_path, '') = '' THEN 'core' WHEN {_FOLDERS(tx.TIER_TEST_FOLDERS)} OR regexp_matches({_NAME}, '{tx.TIER_TEST_NAME}') THEN 'test' WHEN {_FOLDERS(tx.EXAMPLE_FOLDERS)} THEN 'example'
WHEN {_FOLDERS(tx.DOC_FOLDERS)} OR regexp_matches(lower({_NAME}), '{tx.DOC_NAME}') THEN 'doc' WHEN ends_with(lower({_NAME}), '.pyi') THEN 'stub' WHEN reexport THEN 'reexport' ELSE 'core' END"""


@register("f02_test_fence", f"{views.sql('symbols')} SELECT uid, {_TESTS} AS is_test FROM symbols")
def f02(spark: SparkSession, d: str) -> DataFrame:
    """Whether a symbol's file is a test."""
    return views.symbols(spark, d).select("uid", tx.is_test_path(F.col("file_path")).alias("is_test"))


_PATHS = "SELECT file_path, count(*) = 1 AS reexport FROM symbols GROUP BY 1 UNION ALL SELECT DISTINCT source_file, false FROM context_docs"


@register("f03_file_tier", f"{views.sql('symbols')} SELECT file_path, {_TIER} AS tier, count(*) AS n FROM ({_PATHS}) GROUP BY 1, 2")
def f03(spark: SparkSession, d: str) -> DataFrame:
    """Files of symbols and of documents by tier; files with a single symbol stand for those that only pass names on."""
    one = views.symbols(spark, d).groupBy("file_path").agg((F.count("*") == 1).alias("reexport"))
    docs = load(spark, d, "context_docs").select(F.col("source_file").alias("file_path"), F.lit(False).alias("reexport")).distinct()
    return one.unionByName(docs).groupBy("file_path", tx.file_tier(F.col("file_path"), F.col("reexport")).alias("tier")).agg(F.count("*").alias("n"))


@register("f04_tier_weight", f"{views.sql('symbols')}, t AS (SELECT uid, {_TIER.replace('WHEN reexport THEN', 'WHEN false THEN')} AS tier FROM symbols) SELECT uid, CASE tier WHEN 'test' THEN 0.0 WHEN 'example' THEN 0.2 WHEN 'doc' THEN 0.3 WHEN 'stub' THEN 0.5 ELSE 1.0 END::DOUBLE AS seed_weight, CASE tier WHEN 'example' THEN 0.6 WHEN 'doc' THEN 0.6 WHEN 'stub' THEN 0.5 ELSE 1.0 END::DOUBLE AS impact_weight FROM t")
def f04(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a tier for seeds and for impact."""
    t = tx.file_tier(F.col("file_path"))
    return views.symbols(spark, d).select("uid", tx.tier_weight(t).alias("seed_weight"), tx.tier_weight(t, True).alias("impact_weight"))


@register("f05_workspace_filter", f"SELECT chunk_id FROM context_docs WHERE coalesce(workspace_id, '{WS}') = '{WS}' AND owner_uid IN (SELECT uid FROM context_symbols)")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a workspace, or of none, whose owner exists."""
    docs = load(spark, d, "context_docs").where(F.coalesce("workspace_id", F.lit(WS)) == WS)
    return docs.join(load(spark, d, "context_symbols").select(F.col("uid").alias("owner_uid")), "owner_uid", "left_semi").select("chunk_id")


@register("f06_evidence_filter", "SELECT DISTINCT uid FROM context_symbols WHERE list_has_any(provenance, ['graph:calls', 'graph:affects'])")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose evidence meets a set."""
    return load(spark, d, "context_symbols").where(F.arrays_overlap("provenance", F.array(F.lit("graph:calls"), F.lit("graph:affects")))).select("uid").distinct()


_PLUMB = ", ".join(f"'{r}'" for r in tx.PLUMBING_ROOTS)


@register("f08_external_root", f"""WITH b AS (SELECT DISTINCT regexp_extract(file_path, '^([^/]+)/', 1) AS root FROM context_symbols WHERE file_path IS NOT NULL), p AS (SELECT DISTINCT string_split(role, '_')[1] AS root FROM context_symbols WHERE role IS NOT NULL),
r AS (SELECT root, count(*) AS n FROM (SELECT DISTINCT symbol, string_split(regexp_replace(symbol, '[(].*$', ''), '.')[1] AS root FROM messages WHERE symbol IS NOT NULL UNION SELECT DISTINCT role, string_split(role, '_')[1] FROM context_symbols WHERE role IS NOT NULL UNION SELECT file_path, regexp_extract(file_path, '^([^/]+)/', 1) FROM context_symbols WHERE file_path IS NOT NULL) GROUP BY 1)
SELECT root, CASE WHEN coalesce(root, '') = '' THEN 'skip' WHEN root IN (SELECT root FROM b) THEN 'internal' WHEN root IN (SELECT root FROM p) THEN 'external' ELSE 'skip' END AS class, root NOT IN ({_PLUMB}) AND root <> '' AS integration, n FROM r""")
def f08(spark: SparkSession, d: str) -> DataFrame:
    """Roots of names: the project's own, external (named by the project), or neither; and whether a root is more than plumbing."""
    s = load(spark, d, "context_symbols")
    top, first = F.regexp_extract("file_path", "^([^/]+)/", 1), F.substring_index("role", "_", 1)
    boundary = s.where("file_path is not null").select(top.alias("root"))
    named = s.where("role is not null").select(first.alias("root"))
    m = load(spark, d, "messages").where("symbol is not null").select(F.col("symbol").alias("x"), tx.external_root(F.regexp_replace("symbol", "[(].*$", "")).alias("root"))
    every = m.union(s.where("role is not null").select("role", first)).union(s.where("file_path is not null").select("file_path", top)).distinct()
    roots = every.groupBy("root").agg(F.count("*").alias("n"))
    return tx.classify_roots(roots, boundary, named).withColumn("integration", ~F.col("root").isin(*tx.PLUMBING_ROOTS) & (F.col("root") != "")).select("root", "class", "integration", "n")


_WORDS = lambda words: f"regexp_matches(lower(content), '{tx._any_word(words)}')"
_ANCHOR = f"""CASE WHEN {_WORDS(tx.DEPRECATED_WORDS)} THEN 'deprecated' WHEN {_WORDS(tx.WARNING_WORDS)} THEN 'warning' WHEN contains(content, '```') OR contains(lower(source_file), '/examples/') OR contains(lower(source_file), '/tutorial/') THEN 'example'
WHEN contains(lower(source_file), '/reference/') OR regexp_matches(lower(content), '(?m)^[ \\t]*#{{1,4}}[ \\t]([^\\n]*[^a-z\\n])?({"|".join(tx.HEADING_WORDS)})([^a-z]|$)') OR {_WORDS(tx.DEFINITION_WORDS)} THEN 'definition' ELSE 'reference' END"""


@register("f09_anchor_type", f"{views.sql('chunks')} SELECT chunk_id, {_ANCHOR} AS kind FROM chunks")
def f09(spark: SparkSession, d: str) -> DataFrame:
    """Kind of passage by ordered words, headings, code and folders."""
    return views.chunks(spark, d).select("chunk_id", tx.anchor_type(F.col("content"), F.col("source_file")).alias("kind"))


@register("f14_public_api", f"{views.sql('symbols')} SELECT uid, name FROM symbols WHERE kind = 'method' AND (NOT starts_with(name, '_') OR name = '__init__')")
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Public methods."""
    return views.symbols(spark, d).where("kind = 'method'").where(~F.col("name").startswith("_") | (F.col("name") == "__init__")).select("uid", "name")


_LONG = "list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > 5000"


@register("s02_generated_output", f"""SELECT DISTINCT chunk_id, coalesce({_LONG} OR regexp_matches(content, '//[#@]\\s*sourceMappingURL=[^\\n]*\\s*$'), false) AS generated FROM (SELECT chunk_id, content, regexp_replace(source_file, '\\.[a-z]+$', '.js') AS path FROM context_docs
UNION ALL SELECT chunk_id || '+', content || chr(10) || '//# sourceMappingURL=x.js.map' || chr(10), 'x.ts' FROM context_docs)""")
def s02(spark: SparkSession, d: str) -> DataFrame:
    """Texts, taken for scripts, that look like the output of a tool: as they are, and with a source map at their end."""
    c = load(spark, d, "context_docs")
    plain = c.select("chunk_id", "content", F.regexp_replace("source_file", r"\.[a-z]+$", ".js").alias("path"))
    mapped = c.select(F.concat("chunk_id", F.lit("+")).alias("chunk_id"), F.concat("content", F.lit("\n//# sourceMappingURL=x.js.map\n")).alias("content"), F.lit("x.ts").alias("path"))
    return plain.unionByName(mapped).select("chunk_id", files.is_generated(F.col("content"), F.coalesce("path", F.lit("x.js"))).alias("generated")).distinct()


def _at(spark: SparkSession, d: str, name: str) -> str:
    """A folder of a query's own below the shared one; a second run finds it empty."""
    f = stores.Folder(spark, f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    f.delete(f"{name}-{abs(hash(d))}")
    return f"{f.path}/{name}-{abs(hash(d))}"


@register("s01_file_tree", "SELECT n || '.parquet' AS path FROM (VALUES ('customer'), ('lineitem'), ('nation'), ('orders'), ('part'), ('region'), ('supplier'), ('events')) t(n)")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """The table files of the folder, by ending and ignore patterns, without opening one."""
    keep = ["*", *[f"!{n}.parquet" for n in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier", "events")]]
    return files.file_tree(spark, d, ["parquet"], keep).select("path")


@register("s05_markdown_source", f"{views.sql('chunks')} SELECT chunk_id, source_file, length(content) AS n_chars FROM chunks WHERE source_file LIKE '%.md'")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of Markdown files; files.documents() reads the files themselves."""
    return views.chunks(spark, d).where(F.col("source_file").endswith(".md")).select("chunk_id", "source_file", F.length("content").alias("n_chars"))


@register("s11_span_hydration", f"""{views.sql('chunks')}, s AS (SELECT chunk_id, content, 1 + length(chunk_id || content) % 4 AS a, 1 + length(chunk_id || content) % 4 + length(content) % 3 AS b FROM chunks)
SELECT chunk_id, array_to_string(string_split(replace(content, chr(13), ''), chr(10))[a:b], chr(10)) AS code FROM s""")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """The lines from a row's start to its end."""
    c = views.chunks(spark, d).withColumn("a", 1 + F.length(F.concat("chunk_id", "content")) % 4).withColumn("b", F.col("a") + F.length("content") % 3)
    return c.select("chunk_id", tx.lines(F.col("content"), F.col("a"), F.col("b")).alias("code"))


@register("s12_json_tail", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events ORDER BY event_id DESC LIMIT 50")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a log of JSON lines that rotates; the last 50 of it."""
    e = load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    log = stores.JsonLog(spark, _at(spark, d, "log"), "event_id bigint, k bigint", rows=5_000, parts=3)
    log.append(e, "event_id")
    return log.tail(50, "event_id")


@register("s16_audit_tail", "SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 20")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """A user's last 20 actions in an audit log, appended in two goes."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    log = stores.JsonLog(spark, _at(spark, d, "audit"), "event_id bigint, user_id bigint, event_type string, value double", rows=50_000, parts=1_000)
    half = F.lit((e.agg(F.max("event_id")).first()[0] or 0) // 2)
    log.append(e.where(F.col("event_id") <= half), "event_id")
    log.append(e.where(F.col("event_id") > half), "event_id")
    return log.tail(20, "event_id", F.col("user_id") == 7).select("event_id", "event_type", "value")


_KEYS = ["model_name", "model_version", "content_hash"]


@register("s18_vector_upsert", f"""WITH old AS ({_LATEST}), new AS (SELECT * FROM old WHERE last_used_at >= (SELECT quantile_disc(last_used_at, 0.9) FROM old))
SELECT model_name, model_version, content_hash, embedding_hash, false AS is_new FROM old WHERE (model_name, model_version, content_hash) NOT IN (SELECT (model_name, model_version, content_hash) FROM new)
UNION ALL SELECT model_name, model_version, content_hash, embedding_hash, true FROM new""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """The whole cache written at one go (bulk), then its last used tenth again (delta): what is replaced, and what stays."""
    old = load(spark, d, "embedding_cache").select(*_KEYS, "embedding_hash", "last_used_at", "created_at").groupBy(*_KEYS).agg(F.max(F.struct("last_used_at", "created_at", "embedding_hash")).alias("t")).select(*_KEYS, "t.embedding_hash", "t.last_used_at")
    t = stores.KeyedTable(spark, _at(spark, d, "vectors"), _KEYS, "model_name string, model_version string, content_hash string, embedding_hash string, is_new boolean")
    t.upsert(old.withColumn("is_new", F.lit(False)))
    edge = old.agg(F.expr("percentile_disc(0.9) within group (order by last_used_at)"))
    t.upsert(old.where(F.col("last_used_at") >= edge.scalar()).withColumn("is_new", F.lit(True)))
    return t.read()


@register("s13_history_crud", """WITH c AS (SELECT id, max(title) AS title, max(coalesce(updated_at, '')) AS u FROM conversations WHERE id IS NOT NULL GROUP BY 1), k AS (SELECT id, upper(title) AS title FROM c WHERE left(u, 10) >= '2026-01-20')
SELECT k.id, title, count(DISTINCT m.id) AS messages FROM k LEFT JOIN messages m ON m.conversation_id = k.id GROUP BY 1, 2""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """A history written, its titles updated, conversations out of retention deleted with their messages; what is left."""
    h = stores.History(spark, _at(spark, d, "history"), "id string, title string, updated_at string", "id string, conversation_id string")
    c = load(spark, d, "conversations").where("id is not null").groupBy("id").agg(F.max("title").alias("title"), F.max(F.coalesce("updated_at", F.lit(""))).alias("updated_at"))
    h.conversations.upsert(c)
    h.messages.upsert(load(spark, d, "messages").where("id is not null").groupBy("id").agg(F.max("conversation_id").alias("conversation_id")))
    h.conversations.upsert(h.conversations.read().withColumn("title", F.upper("title")))
    h.prune(F.lit("2026-01-20"))
    n = h.messages.read().groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("messages"))
    return h.conversations.read().join(n, "id", "left").select("id", "title", F.coalesce("messages", F.lit(0)).alias("messages"))


@register("s17_manifest", "SELECT count(DISTINCT workspace_id) AS workspaces, count(DISTINCT source_file) AS files, count(DISTINCT chunk_id) AS chunks, max(indexed_at) AS newest FROM context_docs")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of an index, written twice as a whole and read back."""
    m = stores.Manifest(spark, _at(spark, d, "manifest"))
    row = load(spark, d, "context_docs").agg(F.countDistinct("workspace_id").alias("workspaces"), F.countDistinct("source_file").alias("files"), F.countDistinct("chunk_id").alias("chunks"), F.max("indexed_at").alias("newest"))
    m.write(row.withColumn("files", F.lit(0)))
    m.write(row)
    return m.read("workspaces bigint, files bigint, chunks bigint, newest timestamp_ntz")


@register("s19_chunk_upsert", """WITH n AS (SELECT chunk_id, anchor_type, max(indexed_at) AS t FROM context_docs WHERE chunk_id IS NOT NULL GROUP BY 1, 2)
SELECT CASE coalesce(anchor_type, '') WHEN 'definition' THEN 'docstring' WHEN 'example' THEN 'semantic' ELSE 'chunk' END AS kind, chunk_id, coalesce(anchor_type, '') AS anchor_type, CASE WHEN t >= TIMESTAMP '2026-02-10' THEN 2 ELSE 1 END AS version FROM n""")
def s19(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, docstrings and semantic chunks in a table each; what was indexed late is put in again and replaces what was there."""
    n = load(spark, d, "context_docs").where("chunk_id is not null").groupBy("chunk_id", "anchor_type").agg(F.max("indexed_at").alias("t")).withColumn("anchor_type", F.coalesce("anchor_type", F.lit("")))
    kind = F.when(F.col("anchor_type") == "definition", "docstring").when(F.col("anchor_type") == "example", "semantic").otherwise("chunk")
    n, out, at = n.withColumn("kind", kind), None, _at(spark, d, "chunks")
    for k in ("chunk", "docstring", "semantic"):
        t = stores.KeyedTable(spark, f"{at}/{k}", ["chunk_id", "anchor_type"], "kind string, chunk_id string, anchor_type string, version int")
        mine = n.where(F.col("kind") == k)
        t.upsert(mine.withColumn("version", F.lit(1)))
        t.upsert(mine.where(F.col("t") >= F.lit("2026-02-10").cast("timestamp_ntz")).withColumn("version", F.lit(2)))
        out = t.read() if out is None else out.unionByName(t.read())
    return out


@register("s14_job_log", """SELECT target, arg_max(id, {'u': updated_at, 'i': id}) AS id, arg_max(attempts, {'u': updated_at, 'i': id}) + 1 AS attempt FROM index_jobs WHERE target IS NOT NULL AND updated_at IS NOT NULL AND lower(trim(status)) = 'failed' AND attempts < 3 AND target_hash <> '' GROUP BY target, target_hash""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """For every target and hash with a failed job that has tries left, the job to be tried again; stores.start_job() does it for one."""
    j = load(spark, d, "index_jobs").where("target is not null and updated_at is not null and lower(trim(status)) = 'failed' and attempts < 3 and target_hash <> ''")
    return j.groupBy("target", "target_hash").agg(F.max(F.struct("updated_at", "id", "attempts")).alias("t")).select("target", "t.id", (F.col("t.attempts") + 1).alias("attempt"))


@register("s24_packs", "SELECT item_id, question FROM eval_items")
def s24(spark: SparkSession, d: str) -> DataFrame:
    """A pack in Parquet that includes one in JSON lines."""
    e = load(spark, d, "eval_items").select("item_id", "question")
    at = _at(spark, d, "packs")
    e.where("item_id % 2 = 1").write.mode("overwrite").json(f"{at}/odd.json")
    rest = e.where("item_id % 2 = 0").withColumn("include", F.lit(None).cast("string"))
    rest.unionByName(spark.createDataFrame([(f"{at}/odd.json",)], "include string"), allowMissingColumns=True).write.mode("overwrite").parquet(f"{at}/all.parquet")
    return files.pack(spark, f"{at}/all.parquet").select("item_id", "question")


@register("s25_metrics_text", """WITH c AS (SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type), g AS (SELECT 'last_user{type="' || event_type || '"} ' || arg_max(user_id, {'t': ts, 'u': user_id}) AS line FROM events GROUP BY event_type)
SELECT line FROM c UNION ALL SELECT line FROM g UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT '# TYPE last_user gauge'""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    """Counters and gauges as text."""
    e = load(spark, d, "events")
    labels = F.create_map(F.lit("type"), "event_type").alias("labels")
    return stores.metrics_text(e.select(F.lit("events_total").alias("name"), labels, F.lit(1).alias("value")), e.select(F.lit("last_user").alias("name"), labels, F.col("user_id").alias("value"), F.col("ts").alias("at")))


@register("f10_path_match", f"""{views.sql('symbols')}, f AS (SELECT DISTINCT source_file AS b FROM context_docs WHERE source_file IS NOT NULL), s AS (SELECT DISTINCT file_path AS a FROM symbols WHERE file_path IS NOT NULL UNION SELECT DISTINCT regexp_extract(b, '([^/]+)$', 1) FROM f UNION SELECT DISTINCT 'x/' || b FROM f)
SELECT a, b, CASE WHEN a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a) THEN 'suffix' ELSE 'name' END AS rule FROM s, f WHERE regexp_extract(a, '([^/]+)$', 1) = regexp_extract(b, '([^/]+)$', 1)""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Paths that mean one file: one ends in the other at a folder's border, or they share a name; joined for equality of the name."""
    f = load(spark, d, "context_docs").where("source_file is not null").select(F.col("source_file").alias("b")).distinct()
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    s = views.symbols(spark, d).where("file_path is not null").select(F.col("file_path").alias("a")).union(f.select(name("b"))).union(f.select(F.concat(F.lit("x/"), "b"))).distinct()
    return s.join(f, name("a") == name("b")).select("a", "b", F.when(tx.same_path(F.col("a"), F.col("b")), "suffix").otherwise("name").alias("rule"))


_SAFE = ("kind", "source")


@register("f11_redaction", "SELECT DISTINCT id, CASE WHEN metadata_json IS NULL OR json_extract_string(metadata_json, '$.kind') IS NULL THEN NULL ELSE json_extract_string(metadata_json, '$.kind') END AS kind, CASE WHEN content_summary IS NULL THEN [] ELSE ['content_summary'] END AS redacted, length(content_summary) AS n FROM messages WHERE id IS NOT NULL")
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Structure stays, free text goes; the names of what went and its length are kept."""
    m = load(spark, d, "messages").where("id is not null")
    safe = tx.redact(F.create_map(F.lit("kind"), F.get_json_object("metadata_json", "$.kind"), F.lit("content_summary"), F.col("content_summary")), _SAFE)
    return m.select("id", safe["kept"]["kind"].alias("kind"), safe["redacted"].alias("redacted"), F.length("content_summary").alias("n")).distinct()


@register("f12_bounds", "SELECT feedback_token, coalesce(question_tokens, 10) AS \"limit\", coalesce(question_tokens, 10) BETWEEN 1 AND 50 AS limit_ok, least(50, greatest(1, coalesce(question_tokens, 10))) AS bounded, least(32000, greatest(400, coalesce(question_tokens, 10) * 30)) AS budget FROM retrieval_snapshots")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """A request's numbers: whether they are within bounds, and brought within them."""
    n = F.coalesce("question_tokens", F.lit(10))
    return load(spark, d, "retrieval_snapshots").select("feedback_token", n.alias("limit"), n.between(*tx.LIMIT_BOUNDS).alias("limit_ok"), tx.bounded(n, tx.LIMIT_BOUNDS).alias("bounded"), tx.bounded(n * 30, tx.BUDGET_BOUNDS).alias("budget"))


_VERSIONS = "a AS (SELECT uid, min(code) AS h, min(start_line) AS s, max(end_line) AS e FROM context_symbols WHERE uid IS NOT NULL AND NOT is_dirty GROUP BY 1), b AS (SELECT uid, min(code) AS h, min(start_line) AS s, max(end_line) AS e FROM context_symbols WHERE uid IS NOT NULL AND is_dirty GROUP BY 1)"


@register("f13_changed_symbols", f"WITH {_VERSIONS} SELECT uid, CASE WHEN a.uid IS NULL THEN 'new' WHEN b.uid IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' WHEN a.s IS DISTINCT FROM b.s OR a.e IS DISTINCT FROM b.e THEN 'moved' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (uid)")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Stored symbols against edited ones: new, removed, changed in text, moved in lines, or unchanged."""
    s = load(spark, d, "context_symbols").where("uid is not null")
    side = lambda cond, p: s.where(cond).groupBy("uid").agg(F.min("code").alias(f"{p}h"), F.min("start_line").alias(f"{p}s"), F.max("end_line").alias(f"{p}e"), F.lit(True).alias(f"{p}has"))
    m = side("not is_dirty", "a").join(side("is_dirty", "b"), "uid", "full")
    same = lambda c: F.col(f"a{c}").eqNullSafe(F.col(f"b{c}"))
    state = F.when(F.col("ahas").isNull(), "new").when(F.col("bhas").isNull(), "removed").when(~same("h"), "changed").when(~same("s") | ~same("e"), "moved").otherwise("unchanged")
    return m.select("uid", state.alias("state"))


QUERIES, ORACLES = R.queries, R.oracles
