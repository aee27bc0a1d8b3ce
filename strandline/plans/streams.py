"""Queries on change data, state and windows, and on text, rules and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..operators import extract
from ..sources.tables import load
from ..streaming import jobs as sj
from ..streaming import queue as sq
from ..streaming import windows as sw
from .sources import _ANCHOR
from .base import Registry

R = Registry()
register = R.register


@register("t01_debounce_queue", """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, event_type, min(ts) AS enqueued_at, max(ts) AS updated_at, count(*) AS generation FROM i GROUP BY user_id, event_type, s""")
def t01(spark: SparkSession, d: str) -> DataFrame:
    """Saves of one target as one work item until it is quiet."""
    return sw.debounce(load(spark, d, "events"), "ts", ["user_id", "event_type"], "6 hours")


_QUEUE = """e AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, 'w' || (user_id % 3) AS workspace, CASE WHEN event_type = 'error' THEN 'project' ELSE 'file' END AS kind, event_type || user_id AS target FROM events),
k AS (SELECT workspace, kind, target, min(ms) AS enqueued_at, max(ms) AS updated_at, count(*) AS generation, min({'a': ms, 'i': id}) AS f FROM e GROUP BY 1, 2, 3), q AS (SELECT * FROM k ORDER BY f, workspace, kind, target LIMIT 120)"""


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("event_type") == "error", "project").otherwise("file")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    a = load(spark, d, "events").select(F.col("event_id").alias("id"), at.alias("at"), F.concat(F.lit("w"), F.col("user_id") % 3).alias("workspace"), kind.alias("kind"), F.concat("event_type", "user_id").alias("target"))
    return sq.admit(spark.createDataFrame([], sq.ITEM), a, 120)


@register("t01_work_queue", f"WITH {_QUEUE} SELECT workspace, kind, target, enqueued_at, updated_at, generation FROM q")
def t01_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue after all events, of 120 places: later saves of what waits count it up, new keys find it full."""
    return _queue(spark, d)[0]


@register("t01_outcomes", f"WITH {_QUEUE} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN q.target IS NULL THEN 'queue_full' WHEN q.f.i = e.id THEN 'queued' ELSE 'coalesced' END AS outcome FROM e LEFT JOIN q USING (workspace, kind, target)) GROUP BY 1")
def t01_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of the events."""
    return _queue(spark, d)[1].groupBy("outcome").agg(F.count("*").alias("n"))


_STATES = "a AS (SELECT target, arg_max(target_hash, {'l': landed_at, 'i': id, 'h': target_hash}) AS h FROM index_jobs WHERE target IS NOT NULL AND target_hash <> '' AND landed_at < TIMESTAMP '2026-02-01' GROUP BY 1), b AS (SELECT target, arg_max(target_hash, {'l': landed_at, 'i': id, 'h': target_hash}) AS h FROM index_jobs WHERE target IS NOT NULL AND target_hash <> '' AND landed_at < TIMESTAMP '2026-02-10' GROUP BY 1)"


def _state(spark: SparkSession, d: str, until: str) -> DataFrame:
    j = load(spark, d, "index_jobs").where("target is not null and target_hash <> ''").where(F.col("landed_at") < F.lit(until).cast("timestamp_ntz"))
    return j.groupBy("target").agg(F.max(F.struct("landed_at", "id", "target_hash"))["target_hash"].alias("h"))


@register("t02_head_delta", f"WITH {_STATES} SELECT b.target, CASE WHEN a.target IS NULL THEN 'added' ELSE 'modified' END AS change FROM b LEFT JOIN a USING (target) WHERE a.h IS DISTINCT FROM b.h")
def t02(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two points of a feed."""
    a, b = _state(spark, d, "2026-02-01").withColumnRenamed("h", "old"), _state(spark, d, "2026-02-10")
    return b.join(a, "target", "left").where(~F.col("h").eqNullSafe(F.col("old"))).select("target", F.when(F.col("old").isNull(), "added").otherwise("modified").alias("change"))


@register("t04_file_diff", f"WITH {_STATES} SELECT CASE WHEN a.target IS NULL THEN 'new' WHEN b.target IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n FROM a FULL JOIN b ON a.target = b.target GROUP BY 1")
def t04(spark: SparkSession, d: str) -> DataFrame:
    """Files by their state between two versions."""
    a, b = _state(spark, d, "2026-02-01").withColumnRenamed("h", "old"), _state(spark, d, "2026-02-10")
    s = F.when(F.col("old").isNull(), "new").when(F.col("h").isNull(), "removed").when(F.col("old") != F.col("h"), "changed").otherwise("unchanged")
    return a.join(b, "target", "full").groupBy(s.alias("state")).agg(F.count("*").alias("n"))


@register("t05_job_states", """WITH j AS (SELECT target, id, lower(trim(status)) AS s FROM index_jobs WHERE target IS NOT NULL), l AS (SELECT target, max(id) AS done FROM j WHERE s = 'completed' GROUP BY 1),
g AS (SELECT j.target, count(DISTINCT CASE WHEN (done IS NULL OR id > done) AND s IN ('failed', 'dead_letter') THEN id END) AS failures, max({'id': id, 's': s}) FILTER (WHERE s IN ('running', 'completed', 'failed', 'dead_letter')) AS t FROM j LEFT JOIN l USING (target) GROUP BY 1)
SELECT target, CASE WHEN failures >= 3 AND t.s <> 'completed' THEN 'dead_letter' WHEN t.s = 'dead_letter' THEN 'failed' ELSE t.s END AS state, failures FROM g""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """The state of every job."""
    return sj.states(load(spark, d, "index_jobs"))


@register("t08_cache_miss", "SELECT DISTINCT content_hash FROM messages WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM embedding_cache WHERE content_hash IS NOT NULL)")
def t08(spark: SparkSession, d: str) -> DataFrame:
    """Contents to be encoded, each once."""
    return load(spark, d, "messages").where("content_hash is not null").select("content_hash").distinct().join(load(spark, d, "embedding_cache").select("content_hash"), "content_hash", "left_anti")


@register("t09_retention", "WITH o AS (SELECT id FROM conversations WHERE id IS NOT NULL GROUP BY 1 HAVING max(left(updated_at, 10)) < '2026-01-20') SELECT DISTINCT m.id FROM messages m JOIN o ON m.conversation_id = o.id WHERE m.id IS NOT NULL")
def t09(spark: SparkSession, d: str) -> DataFrame:
    """Messages that go with conversations out of retention."""
    old = load(spark, d, "conversations").where("id is not null").groupBy(F.col("id").alias("conversation_id")).agg(F.max(F.substring("updated_at", 1, 10)).alias("u")).where("u < '2026-01-20'").select("conversation_id")
    return load(spark, d, "messages").where("id is not null").join(old, "conversation_id", "left_semi").select("id").distinct()


@register("t10_overlay_eviction", "SELECT id, job_type FROM (SELECT id, job_type, row_number() OVER (PARTITION BY job_type ORDER BY u DESC, id DESC) AS r FROM (SELECT id, job_type, max(CASE WHEN updated_at >= 100000000000 THEN updated_at // 1000 ELSE updated_at END) AS u FROM index_jobs GROUP BY 1, 2) WHERE u >= 1769904000) WHERE r <= 256")
def t10(spark: SparkSession, d: str) -> DataFrame:
    """What an overlay of 256 entries with a time to live keeps."""
    u = F.when(F.col("updated_at") >= 100_000_000_000, F.expr("updated_at div 1000")).otherwise(F.col("updated_at"))
    e = load(spark, d, "index_jobs").groupBy("id", "job_type").agg(F.max(u).alias("u"))
    return sj.evict(e, "job_type", "u", "id", 256, 1_769_904_000).select("id", "job_type")


@register("t11_cache_invalidation", "SELECT DISTINCT feedback_token FROM retrieval_snapshots WHERE feedback_token IS NOT NULL AND feedback_token NOT IN (SELECT feedback_token FROM context_symbols WHERE feedback_token IS NOT NULL AND starts_with(file_path, 'sync/'))")
def t11(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers that no changed file touches."""
    hit = load(spark, d, "context_symbols").where(F.col("file_path").startswith("sync/")).select("feedback_token")
    return load(spark, d, "retrieval_snapshots").where("feedback_token is not null").select("feedback_token").distinct().join(hit, "feedback_token", "left_anti")


@register("t12_version_bump", "SELECT workspace_id, count(DISTINCT indexed_at) + 1 AS version FROM context_docs GROUP BY 1")
def t12(spark: SparkSession, d: str) -> DataFrame:
    """The next version of each workspace."""
    return load(spark, d, "context_docs").groupBy("workspace_id").agg((F.countDistinct("indexed_at") + 1).alias("version"))


@register("t14_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t14(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and sums."""
    return sw.tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@register("t15_sliding", "SELECT start, n, round(total, 4) AS total FROM (SELECT s AS start, count(*) AS n, sum(value) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1)")
def t15(spark: SparkSession, d: str) -> DataFrame:
    """Windows of twelve hours every six."""
    return sw.tumbling(load(spark, d, "events"), "ts", "12 hours", [], slide="6 hours").withColumn("total", F.round("total", 4))


@register("x01_identifier_parts", r"SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]+') AS parts FROM documents")
def x01(spark: SparkSession, d: str) -> DataFrame:
    """Parts of all identifiers of a text."""
    return load(spark, d, "documents").select("doc_id", tx.identifier_parts(F.col("text")).alias("parts"))


@register("x02_python_facts")
def x02(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, calls, imports and raises of the symbols' source."""
    c = load(spark, d, "context_symbols").where("code is not null and uid is not null and file_path like '%.py'").groupBy("uid").agg(F.max("code").alias("code"))
    return extract.python_facts(c, "uid", "code")


@register("x03_uid_hash", f"{views.sql('symbols')} SELECT uid, left(sha256('ws|' || qualified_name || '|' || coalesce(kind, '')), 16) AS h FROM symbols")
def x03(spark: SparkSession, d: str) -> DataFrame:
    """Identity by hash."""
    return views.symbols(spark, d).select("uid", tx.uid(F.lit("ws"), F.col("qualified_name"), F.coalesce("kind", F.lit(""))).alias("h"))


@register("c04_contract_diagnosis", "WITH x AS (SELECT uid, list_sort(list_distinct(flatten(list(provenance)))) AS bits FROM context_symbols WHERE uid IS NOT NULL AND provenance IS NOT NULL GROUP BY 1) SELECT uid, list_filter(['graph:calls', 'lexical', 'vector:symbols'], lambda b: NOT list_contains(bits, b)) AS missing FROM x")
def c04(spark: SparkSession, d: str) -> DataFrame:
    """Bits that a contract requires and a symbol lacks."""
    x = load(spark, d, "context_symbols").where("uid is not null and provenance is not null").select("uid", F.explode_outer("provenance").alias("p")).groupBy("uid").agg(F.collect_set("p").alias("bits"))
    return x.select("uid", F.filter(F.array(*map(F.lit, ("graph:calls", "lexical", "vector:symbols"))), lambda b: ~F.array_contains("bits", b)).alias("missing"))


@register("c05_marker_lookup", f"{views.sql('symbols')} SELECT uid, CASE string_split(name, '_')[1] WHEN 'emit' THEN 'event' WHEN 'register' THEN 'registry' WHEN 'load' THEN 'source' ELSE 'none' END AS marker FROM symbols WHERE name IS NOT NULL")
def c05(spark: SparkSession, d: str) -> DataFrame:
    """Names in a catalogue of markers."""
    table = F.create_map(*map(F.lit, ("emit", "event", "register", "registry", "load", "source")))
    return views.symbols(spark, d).where("name is not null").select("uid", F.coalesce(table[F.substring_index("name", "_", 1)], F.lit("none")).alias("marker"))


_HAS = lambda cond, value: f"CASE WHEN {cond} THEN {value} ELSE 0 END"
_CONFIDENCE = f"""round(greatest(0.05, least(1.0, 0.68 + {_HAS("regexp_matches(content, '(?m)\\b' || name || '\\b')", 0.14)} + {_HAS("regexp_matches(content, '(?m)^#{1,6}\\s+.*\\b' || name || '\\b')", 0.10)}
+ {_HAS("contains(content, '`' || name || '`') OR contains(content, name || '(')", 0.08)} + CASE WHEN kind IN ('definition', 'warning', 'deprecated') THEN 0.05 WHEN kind = 'example' THEN -0.04 ELSE 0 END)), 3)::DOUBLE"""
_IDENTIFIERS = "list_sort(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9]*_[A-Za-z0-9_]*[A-Za-z0-9]|[a-z]+[A-Z][A-Za-z0-9]*')))"


@register("c07_anchor_confidence", f"""{views.sql('symbols', 'chunks')}, n AS (SELECT name, min(uid) AS uid FROM symbols GROUP BY 1), l AS (SELECT chunk_id, content, {_ANCHOR} AS kind, unnest({_IDENTIFIERS}) AS name FROM chunks)
SELECT chunk_id, uid, {_CONFIDENCE} AS confidence FROM l JOIN n USING (name)""")
def c07(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each link from a chunk to a symbol that it names."""
    names = views.symbols(spark, d).groupBy("name").agg(F.min("uid").alias("uid"))
    c = views.chunks(spark, d)
    link = c.select("chunk_id", "content", "source_file", F.explode(tx.identifiers(F.col("content"))).alias("name")).join(names, "name")
    kind = tx.anchor_type(F.col("content"), F.col("source_file"))
    return link.select("chunk_id", "uid", tx.anchor_confidence(F.lit("identifier"), F.lit(None).cast("double"), F.col("content"), F.col("name"), kind).alias("confidence"))


QUERIES, ORACLES = R.queries, R.oracles
