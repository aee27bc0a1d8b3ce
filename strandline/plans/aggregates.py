"""Queries on aggregations, ranks, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import views
from ..functions import text as tx
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import selection as se
from ..sources.tables import load
from .base import Registry

R = Registry()
register = R.register


@register("a01_degree", f"{views.sql('edges')} SELECT node, sum(i)::BIGINT AS degree_in, sum(o)::BIGINT AS degree_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """Edges in and out of every node."""
    return gr.degrees(views.edges(spark, d))


@register("a02_call_fan_in", f"{views.sql('edges')} SELECT dst AS node, count(DISTINCT src) AS fan_in FROM edges WHERE rel_type LIKE 'CALLS%' GROUP BY 1")
def a02(spark: SparkSession, d: str) -> DataFrame:
    """Distinct callers."""
    return views.edges(spark, d).where("rel_type like 'CALLS%'").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))


@register("a07_doc_counts", f"{views.sql('symbols', 'chunks')} SELECT s.uid, count(c.chunk_id) AS docs FROM symbols s LEFT JOIN chunks c ON c.owner_uid = s.uid GROUP BY 1")
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each symbol, zero kept."""
    n = views.chunks(spark, d).groupBy(F.col("owner_uid").alias("uid")).agg(F.count("chunk_id").alias("docs"))
    return views.symbols(spark, d).select("uid").join(n, "uid", "left").select("uid", F.coalesce("docs", F.lit(0)).alias("docs"))


@register("a08_doc_weights", "SELECT owner_uid, round(sum(CASE WHEN anchor_type IN ('definition', 'reference') THEN score ELSE 0 END), 6) AS defining, round(sum(CASE WHEN anchor_type IN ('warning', 'deprecated') THEN score ELSE 0 END), 6) AS warning, round(sum(CASE WHEN anchor_type = 'example' THEN score ELSE 0 END), 6) AS example FROM context_docs WHERE owner_uid IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    """Weights of documentation by class of anchor."""
    s = lambda *k: F.round(F.sum(F.when(F.col("anchor_type").isin(*k), F.col("score")).otherwise(0.0)), 6)
    ok = load(spark, d, "context_docs").where("owner_uid is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    return ok.groupBy("owner_uid").agg(s("definition", "reference").alias("defining"), s("warning", "deprecated").alias("warning"), s("example").alias("example"))


@register("a10_dispersion", f"{views.sql('symbols')} SELECT kind, CASE WHEN count(DISTINCT qualified_name) <= 1 THEN 0 ELSE round((count(DISTINCT string_split(qualified_name, '.')[1]) - 1)::DOUBLE / (count(DISTINCT qualified_name) - 1), 9) END AS dispersion FROM symbols GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """How far names spread over packages."""
    q, r = F.countDistinct("qualified_name"), F.countDistinct(tx.external_root(F.col("qualified_name")))
    return views.symbols(spark, d).groupBy("kind").agg(F.when(q <= 1, 0.0).otherwise(F.round((r - 1).cast("double") / F.nullif(q - 1, F.lit(0)), 9)).alias("dispersion"))


@register("a11_profile_counts", f"{views.sql('edges')} SELECT rel_type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Edges and distinct ends by relation."""
    return views.edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@register("a12_repository_profile", f"""{views.sql('symbols')} SELECT regexp_extract(file_path, '\\.([a-z]+)$', 1) AS ext, count(*) AS symbols, count(DISTINCT file_path) AS files, round(count(*)::DOUBLE / nullif(count(DISTINCT file_path), 0), 6) AS density,
CASE WHEN count(*)::DOUBLE / nullif(count(DISTINCT file_path), 0) >= 2 THEN 'high' WHEN count(*)::DOUBLE / nullif(count(DISTINCT file_path), 0) >= 1.5 THEN 'medium' ELSE 'low' END AS level FROM symbols WHERE file_path IS NOT NULL GROUP BY 1""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, files, density and its level by language."""
    g = views.symbols(spark, d).where("file_path is not null").groupBy(F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))
    r = F.col("symbols") / F.col("files")
    return g.withColumns({"density": F.round(r, 6), "level": F.when(r >= 2, "high").when(r >= 1.5, "medium").otherwise("low")})


_ROBUST = "m AS (SELECT median(value) AS med FROM events), a AS (SELECT median(abs(value - med)) AS mad FROM events, m), w AS (SELECT median(value) AS weak FROM events, m WHERE value <= med)"


@register("a13_robust_stats", f'WITH {_ROBUST} SELECT round(med, 6) AS median, round(mad, 6) AS mad, round(weak + 3 * 1.4826 * mad, 6) AS noise_floor FROM m, a, w')
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Median, median absolute deviation and noise floor."""
    r = rk.robust_stats(load(spark, d, "events"), "value")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("a15_idf_weight", f"{views.sql('edges')}, n AS (SELECT dst, count(DISTINCT src) AS k FROM edges WHERE rel_type LIKE 'CALLS%' GROUP BY 1) SELECT 'P' || p_partkey AS node, round(1 / ln(greatest(coalesce(k, 1), 1) + 1), 9) AS weight FROM part LEFT JOIN n ON dst = 'P' || p_partkey")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Seeds weighted down by what calls them."""
    n = views.edges(spark, d).where("rel_type like 'CALLS%'").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("k"))
    p = load(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return p.join(n, "node", "left").select("node", F.round(1 / F.log(F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)) + 1), 9).alias("weight"))


@register("a17_keep_best", "SELECT user_id, arg_max(event_id, {'v': value, 'i': event_id}) AS event_id FROM events GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each key."""
    return load(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("value", "event_id"))["event_id"].alias("event_id"))


@register("a18_evidence_union", "SELECT uid, list_sort(list_distinct(flatten(list(provenance)))) AS channels, bool_or(is_dirty) AS dirty, max(depth) AS depth FROM context_symbols WHERE uid IS NOT NULL AND provenance IS NOT NULL GROUP BY 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    """Channels of all of a symbol's rows; the union is taken before the shuffle."""
    e = load(spark, d, "context_symbols").where("uid is not null and provenance is not null").select("uid", F.explode_outer("provenance").alias("p"), "is_dirty", "depth")
    return e.groupBy("uid").agg(F.sort_array(F.collect_set("p")).alias("channels"), F.max("is_dirty").alias("dirty"), F.max("depth").alias("depth"))


@register("a19_counters", "SELECT event_type, json_extract_string(props, '$.k')::BIGINT % 4 AS label, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, {'t': ts, 'i': event_id}) AS last FROM events GROUP BY 1, 2")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """Counters, sums and last values by name and label."""
    e = load(spark, d, "events").withColumn("label", F.get_json_object("props", "$.k").cast("bigint") % 4)
    return e.groupBy("event_type", "label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.struct("ts", "event_id", "value"))["value"].alias("last"))


@register("a20_cost_estimate", "SELECT feedback_token, round((question_tokens * 3.0 + selected_count * 15.0) / 1e6, 8) AS cost FROM retrieval_snapshots")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Cost by rate."""
    return load(spark, d, "retrieval_snapshots").select("feedback_token", F.round((F.col("question_tokens") * 3.0 + F.col("selected_count") * 15.0) / 1e6, 8).alias("cost"))


@register("a21_cache_stats", "SELECT model_name, model_version, count(*) AS entries, count(*) FILTER (WHERE vector IS NULL) AS empty FROM embedding_cache GROUP BY ROLLUP (model_name, model_version)")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """Entries by model and version, with totals."""
    return load(spark, d, "embedding_cache").rollup("model_name", "model_version").agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("vector").isNull(), 1)).alias("empty"))


@register("a23_explain_groups", f"""{views.sql('edges')}, l AS (SELECT 'out:' || rel_type AS label, dst AS other FROM edges WHERE src = 'P2' UNION SELECT 'in:' || rel_type, src FROM edges WHERE dst = 'P2') SELECT label, other, size FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY other) AS r, count(*) OVER (PARTITION BY label) AS size FROM l) WHERE r <= 8""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's connections by directed label, eight of each, with the size of the group."""
    e = views.edges(spark, d)
    label = lambda way: F.concat(F.lit(way + ":"), "rel_type")
    conn = e.where("src = 'P2'").select(label("out").alias("label"), F.col("dst").alias("other")).union(e.where("dst = 'P2'").select(label("in"), "src")).distinct()
    size = conn.groupBy("label").agg(F.count("*").alias("size"))
    return lk.top_by(conn, ["label"], [F.col("other")], 8).join(size, "label")


_EVAL = "g AS (SELECT DISTINCT feedback_token AS q, uid FROM context_symbols WHERE relevance_score > 0.52 AND isfinite(relevance_score)), r AS (SELECT q, uid, n FROM (SELECT q, uid, row_number() OVER (PARTITION BY q ORDER BY u DESC, uid) AS n FROM (SELECT feedback_token AS q, uid, max(utility_score) AS u FROM context_symbols WHERE isfinite(utility_score) AND uid IS NOT NULL GROUP BY 1, 2)) WHERE n <= 5)"


def _gold_and_top(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = load(spark, d, "context_symbols").where("uid is not null")
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    gold = s.where(fin("relevance_score") & (F.col("relevance_score") > 0.52)).select(F.col("feedback_token").alias("q"), "uid").distinct()
    best = s.where(fin("utility_score")).groupBy(F.col("feedback_token").alias("q"), "uid").agg(F.max("utility_score").alias("u"))
    top = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("u"), "uid"))).where("n <= 5")
    return gold, top


@register("a24_recall_precision", f"WITH {_EVAL} SELECT r.q, round(count(g.uid)::DOUBLE / 5, 6) AS precision_at_5, round(count(g.uid)::DOUBLE / any_value(t.n), 6) AS recall_at_5, coalesce(round(1.0 / min(r.n) FILTER (WHERE g.uid IS NOT NULL), 6), 0) AS rr FROM r LEFT JOIN g ON g.q = r.q AND g.uid = r.uid JOIN (SELECT q, count(*) AS n FROM g GROUP BY 1) t ON t.q = r.q GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and reciprocal rank of the first five of each query."""
    gold, top = _gold_and_top(spark, d)
    n = gold.groupBy("q").agg(F.count("*").alias("gold"))
    j = top.join(gold.withColumn("hit", F.lit(1)), ["q", "uid"], "left").join(n, "q")
    return j.groupBy("q").agg(F.round(F.count("hit") / F.lit(5.0), 6).alias("precision_at_5"), F.round(F.count("hit") / F.max("gold").cast("double"), 6).alias("recall_at_5"), F.coalesce(F.round(1.0 / F.min(F.when(F.col("hit") == 1, F.col("n"))), 6), F.lit(0.0)).alias("rr"))


@register("a25_role_report", "SELECT kind, role, count(DISTINCT uid) AS n FROM context_symbols GROUP BY 1, 2")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by kind and role."""
    return load(spark, d, "context_symbols").groupBy("kind", "role").agg(F.countDistinct("uid").alias("n"))


@register("a28_rank_auc", "WITH x AS (SELECT quality AS s, toxic = 1 AS g FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), a AS (SELECT s, count(*) AS n FROM x WHERE g GROUP BY 1), b AS (SELECT s, count(*) AS n FROM x WHERE NOT g GROUP BY 1) SELECT round(sum(a.n * b.n * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 9) AS auc FROM a, b")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """How well a score ranks, by rank sums instead of pairs."""
    x = load(spark, d, "labels").where("quality is not null and toxic is not null")
    return rk.rank_auc(x, "quality", F.col("toxic") == 1).select(F.round("auc", 9).alias("auc"))


@register("a29_verdict_matrix", "SELECT coalesce(category, 'none') AS verdict, count(*) FILTER (WHERE quality <= 2) AS low, count(*) FILTER (WHERE quality = 3) AS mid, count(*) FILTER (WHERE quality >= 4) AS high FROM labels GROUP BY 1")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against quality."""
    c = lambda cond: F.count(F.when(F.expr(cond), 1))
    return load(spark, d, "labels").groupBy(F.coalesce("category", F.lit("none")).alias("verdict")).agg(c("quality <= 2").alias("low"), c("quality = 3").alias("mid"), c("quality >= 4").alias("high"))


@register("a30_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a30(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all combinations of two keys."""
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("w02_descending_ranks", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS r FROM events")
def w02(spark: SparkSession, d: str) -> DataFrame:
    """Ranks from the greatest, the later first among equals."""
    return load(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), F.desc("event_id"))).alias("r"))


@register("w03_top_k_per_role", "SELECT role, uid FROM (SELECT role, uid, row_number() OVER (PARTITION BY role ORDER BY u DESC, uid DESC) AS r FROM (SELECT role, uid, max(utility_score) AS u FROM context_symbols WHERE isfinite(utility_score) GROUP BY 1, 2)) WHERE r <= 7")
def w03(spark: SparkSession, d: str) -> DataFrame:
    """The first seven of each role."""
    s = load(spark, d, "context_symbols").where("utility_score is not null and not isnan(utility_score) and abs(utility_score) < double('infinity')").groupBy("role", "uid").agg(F.max("utility_score").alias("u"))
    return lk.top_by(s, ["role"], [F.desc("u"), F.desc("uid")], 7).select("role", "uid")


@register("w04_limit_by_row", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= CASE WHEN user_id % 3 = 0 THEN 5 ELSE 2 END")
def w04(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each key, with a limit of its own for some."""
    return lk.top_by(load(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("user_id") % 3 == 0, 5).otherwise(2)).select("user_id", "event_id")


@register("w05_cap_by_file", f"""{views.sql('symbols')}, a AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY name, uid) AS n FROM symbols WHERE file_path IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY role, file_path ORDER BY n) AS k, min(n) OVER (PARTITION BY role, file_path) AS f FROM a), c AS (SELECT *, dense_rank() OVER (PARTITION BY role ORDER BY f) AS g FROM b)
SELECT role, uid FROM (SELECT role, uid, row_number() OVER (PARTITION BY role ORDER BY n) AS t FROM c WHERE k <= 2 AND g <= 5) WHERE t <= 10""")
def w05(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order with caps for a file, for files and in all."""
    s = views.symbols(spark, d).where("file_path is not null").select("role", "file_path", "name", "uid")
    return se.cap_by_file(s, [F.col("name"), F.col("uid")], ["role"]).select("role", "uid")


@register("w06_first_wins", f"{views.sql('symbols')} SELECT name, uid FROM (SELECT name, uid, row_number() OVER (PARTITION BY name ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, qualified_name, uid) AS r FROM symbols) WHERE r = 1")
def w06(spark: SparkSession, d: str) -> DataFrame:
    """The first definition of each name in source order."""
    return lk.first_by(views.symbols(spark, d), ["name"], [F.col("file_path"), F.col("start_line"), F.col("qualified_name"), F.col("uid")]).select("name", "uid")


@register("w07_minmax", "SELECT event_id, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) END AS x FROM events WINDOW w AS (PARTITION BY event_type)")
def w07(spark: SparkSession, d: str) -> DataFrame:
    """Values scaled within their type."""
    return rk.minmax(load(spark, d, "events"), "value", "x", ["event_type"]).select("event_id", F.round("x", 9).alias("x"))


@register("w08_prefix_budget", "SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events) WHERE c <= 50000")
def w08(spark: SparkSession, d: str) -> DataFrame:
    """The dearest rows of each key whose running sum keeps to a budget."""
    e = load(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return se.prefix_budget(e, ["user_id"], [F.desc("value"), F.col("event_id")], "cents", 50000).select("user_id", "event_id")


@register("w09_rank_decay", "SELECT user_id, event_id, floor(6000 * 0.15 * 0.75 ** (r - 1))::BIGINT AS credit FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """Credit that falls with rank."""
    t = load(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("r <= 10")
    return t.select("user_id", "event_id", F.floor(6000 * 0.15 * F.pow(F.lit(0.75), F.col("r") - 1)).cast("bigint").alias("credit"))


@register("w11_round_robin", f"{views.sql('symbols')} SELECT uid, row_number() OVER (ORDER BY r, role NULLS FIRST) AS place FROM (SELECT uid, role, row_number() OVER (PARTITION BY role ORDER BY uid) AS r FROM symbols) WHERE r <= 4")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """Roles take turns; four rounds."""
    s = lk.top_by(views.symbols(spark, d).select("uid", "role"), ["role"], [F.col("uid")], 4)
    s = s.withColumn("r", F.row_number().over(W.partitionBy("role").orderBy("uid")))
    return s.select("uid", F.row_number().over(W.orderBy("r", F.asc_nulls_first("role"))).alias("place"))


@register("w12_latest_failed", "SELECT target, arg_max(id, {'u': updated_at, 'i': id}) AS id FROM index_jobs WHERE target IS NOT NULL AND updated_at IS NOT NULL AND lower(trim(status)) = 'failed' GROUP BY 1")
def w12(spark: SparkSession, d: str) -> DataFrame:
    """The last failure of each target."""
    j = load(spark, d, "index_jobs").where("target is not null and updated_at is not null and lower(trim(status)) = 'failed'")
    return j.groupBy("target").agg(F.max(F.struct("updated_at", "id"))["id"].alias("id"))


@register("w14_head_diff", "SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events")
def w14(spark: SparkSession, d: str) -> DataFrame:
    """Whether a state differs from the one before."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, d, "events").select("event_id", (~F.col("event_type").eqNullSafe(before)).alias("changed"))


@register("w15_balanced_sample", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7|' || doc_id)) AS r FROM documents WHERE source IS NOT NULL) ORDER BY r, source LIMIT 100")
def w15(spark: SparkSession, d: str) -> DataFrame:
    """A balanced sample of 100: sources take turns in an order of their own hashes. The limit is the feature."""
    s = load(spark, d, "documents").where("source is not null").select("doc_id", "source", F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256).alias("h"))
    return lk.top_by(s, ["source"], [F.col("h")], 100).withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("h"))).orderBy("r", "source").limit(100).select("doc_id")


@register("w16_ranked_dedupe", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS r FROM a WHERE k = 1) WHERE r <= 3")
def w16(spark: SparkSession, d: str) -> DataFrame:
    """The longest three of each source after copies are removed; copies take no slots."""
    one = load(spark, d, "documents").where("source is not null").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min(F.struct("doc_id", "source", "n_chars")).alias("t")).select("t.*")
    return lk.top_by(one, ["source"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 3).select("doc_id")


@register("w17_frames", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events")
def w17(spark: SparkSession, d: str) -> DataFrame:
    """Moving mean, next row and quartile."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.round(F.avg("value").over(w.rowsBetween(-3, 0)), 6).alias("moving"), F.lead("event_id").over(w).alias("following"), F.ntile(4).over(w).alias("quarter"))


@register("k02_adjusted_top_k", "SELECT vec_id, round(x, 6) AS adjusted FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.5 END AS x FROM embeddings WHERE vec_id <> 0) ORDER BY x, vec_id LIMIT 20")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """The nearest 20 by distance over tier weight."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding")
    x = rk.l2(F.col("embedding"), F.col("q")) / F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.5)
    return e.where("vec_id <> 0").withColumn("q", q.scalar()).withColumn("x", x).orderBy("x", "vec_id").limit(20).select("vec_id", F.round("x", 6).alias("adjusted"))


@register("k03_adaptive_threshold", "SELECT vec_id FROM (SELECT vec_id, c, row_number() OVER (ORDER BY round(c, 9) DESC, vec_id) AS r FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings WHERE vec_id <> 0)) WHERE r <= 100 AND (r <= 5 OR c >= 0.2)")
def k03(spark: SparkSession, d: str) -> DataFrame:
    """All above a threshold, at least five, at most 100."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding")
    e = e.where("vec_id <> 0").withColumn("q", q.scalar())
    c = rk.dot(F.col("embedding"), F.col("q")) / F.sqrt(rk.dot(F.col("embedding"), F.col("embedding")) * rk.dot(F.col("q"), F.col("q")))
    top = e.withColumn("c", c).orderBy(F.desc(F.round("c", 9)), "vec_id").limit(100).select("vec_id", "c")
    return top.withColumn("r", F.row_number().over(W.orderBy(F.desc(F.round("c", 9)), "vec_id"))).where("r <= 5 or c >= 0.2").select("vec_id")


@register("k08_conversation_list", "SELECT id FROM (SELECT id, max(updated_at) AS u, max(created_at) AS c FROM conversations WHERE id IS NOT NULL AND workspace_id LIKE 'aldermoor/%' GROUP BY 1) ORDER BY u DESC NULLS LAST, c DESC NULLS LAST, id LIMIT 50")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """A workspace's latest 50 conversations."""
    c = load(spark, d, "conversations").where("id is not null and workspace_id like 'aldermoor/%'").groupBy("id").agg(F.max("updated_at").alias("u"), F.max("created_at").alias("c"))
    return c.orderBy(F.desc_nulls_last("u"), F.desc_nulls_last("c"), "id").limit(50).select("id")


@register("k10_even_sample", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id FROM n WHERE floor((i + 1) * 20.0 / n) > floor(i * 20.0 / n)")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows evenly spaced in order of their key; positions come from counts of range partitions, so no task orders everything."""
    e = rk.ranked(load(spark, d, "events").select("event_id"), [F.col("event_id")], "i").withColumn("i", F.col("i") - 1)
    n = F.lit(load(spark, d, "events").count())
    return e.where(F.floor((F.col("i") + 1) * 20.0 / n) > F.floor(F.col("i") * 20.0 / n)).select("event_id")


@register("u01_pool_union", "SELECT uid, list_sort(list_distinct(list(pool))) AS pools FROM (SELECT uid, 'utility' AS pool FROM context_symbols WHERE utility_score > 100 UNION ALL SELECT uid, 'relevance' FROM context_symbols WHERE relevance_score > 0.5) GROUP BY 1")
def u01(spark: SparkSession, d: str) -> DataFrame:
    """Union of pools with provenance."""
    s = load(spark, d, "context_symbols")
    pools = s.where("utility_score > 100").select("uid", F.lit("utility").alias("pool")).unionByName(s.where("relevance_score > 0.5").select("uid", F.lit("relevance").alias("pool")))
    return pools.groupBy("uid").agg(F.sort_array(F.collect_set("pool")).alias("pools"))


@register("u03_symbol_diff", "SELECT target, target_hash FROM index_jobs WHERE id % 2 = 0 AND target IS NOT NULL AND target_hash IS NOT NULL EXCEPT SELECT target, target_hash FROM index_jobs WHERE id % 2 = 1")
def u03(spark: SparkSession, d: str) -> DataFrame:
    """What one version has and the other has not."""
    j = load(spark, d, "index_jobs").select("id", "target", "target_hash")
    return j.where("id % 2 = 0 and target is not null and target_hash is not null").select("target", "target_hash").subtract(j.where("id % 2 = 1").select("target", "target_hash"))


@register("u04_tombstones", "SELECT DISTINCT source_file FROM context_docs WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM context_docs WHERE source_file IS NOT NULL AND indexed_at >= TIMESTAMP '2026-02-15')")
def u04(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files that are active no more."""
    c = load(spark, d, "context_docs").where("source_file is not null").select("source_file", "indexed_at")
    return c.select("source_file").distinct().join(c.where(F.col("indexed_at") >= F.lit("2026-02-15").cast("timestamp_ntz")), "source_file", "left_anti")


@register("u06_key_intersection", "SELECT target FROM index_jobs WHERE lower(trim(status)) = 'failed' AND target IS NOT NULL INTERSECT SELECT target FROM index_jobs WHERE lower(trim(status)) = 'completed'")
def u06(spark: SparkSession, d: str) -> DataFrame:
    """Keys that both sides have."""
    j = load(spark, d, "index_jobs").where("target is not null").select("target", F.lower(F.trim("status")).alias("s"))
    return j.where("s = 'failed'").select("target").intersect(j.where("s = 'completed'").select("target"))


_SPANS = "s AS (SELECT DISTINCT file_path, start_line AS a, end_line AS b FROM context_symbols WHERE file_path IS NOT NULL AND start_line <= end_line)"


@register("u09_merge_spans", f"""WITH {_SPANS}, r AS (SELECT *, max(b) OVER (PARTITION BY file_path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT file_path, min(a) AS "start", max(b) AS "end" FROM i GROUP BY file_path, g""")
def u09(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a file, merged where they overlap or adjoin."""
    s = load(spark, d, "context_symbols").where("file_path is not null").select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    return lk.merge_spans(s, ["file_path"])


QUERIES, ORACLES = R.queries, R.oracles
