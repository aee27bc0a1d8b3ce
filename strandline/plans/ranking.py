"""Queries on retrieval scores and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import views
from ..functions import text as tx
from ..operators import lexical as lx
from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import selection as se
from ..sources.tables import load, spread
from .base import Registry
from .sources import _TIER

R = Registry()
register = R.register

_Q = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], qv) AS d FROM embeddings, q WHERE vec_id <> 0)"


def _distances(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding")
    return e.where("vec_id <> 0").withColumn("q", q.scalar()).withColumn("d", rk.l2(F.col("embedding"), F.col("q"))).select("vec_id", "label", "d")


@register("r01_knn", f"WITH {_Q} SELECT vec_id, round(d, 6) AS distance FROM v ORDER BY round(d, 9), vec_id LIMIT 20")
def r01(spark: SparkSession, d: str) -> DataFrame:
    """The nearest 20 vectors, exactly."""
    return _distances(spark, d).orderBy(F.round("d", 9), "vec_id").limit(20).select("vec_id", F.round("d", 6).alias("distance"))


@register("r02_dual_facet", "WITH a AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id = 0), b AS (SELECT embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(least(list_distance(embedding::DOUBLE[], x), list_distance(embedding::DOUBLE[], y)), 6) AS distance FROM embeddings, a, b WHERE vec_id > 1")
def r02(spark: SparkSession, d: str) -> DataFrame:
    """The lesser of two distances."""
    e = load(spark, d, "embeddings")
    q = [e.where(f"vec_id = {i}").select("embedding") for i in (0, 1)]
    e = e.where("vec_id > 1").withColumns({"x": q[0].scalar(), "y": q[1].scalar()})
    return e.select("vec_id", F.round(F.least(rk.l2(F.col("embedding"), F.col("x")), rk.l2(F.col("embedding"), F.col("y"))), 6).alias("distance"))


@register("r03_score_maps", f"WITH {_Q} SELECT vec_id, round(greatest(-1, least(1, 1 - d * d / 2)), 6) AS cosine, round((1 + greatest(-1, least(1, 1 - d * d / 2))) / 2, 6) AS score FROM v")
def r03(spark: SparkSession, d: str) -> DataFrame:
    """Distances as cosines and scores."""
    return _distances(spark, d).select("vec_id", F.round(rk.cosine_of_distance(F.col("d")), 6).alias("cosine"), F.round(rk.semantic_score(F.col("d")), 6).alias("score"))


@register("r04_filtered_knn", f"WITH {_Q} SELECT vec_id FROM v WHERE label IN (1, 3, 5) AND d <= 1.45 ORDER BY round(d, 9), vec_id LIMIT 15")
def r04(spark: SparkSession, d: str) -> DataFrame:
    """Nearest within a threshold, filtered before the scores are made."""
    return _distances(spark, d).where(F.col("label").isin(1, 3, 5) & (F.col("d") <= 1.45)).orderBy(F.round("d", 9), "vec_id").limit(15).select("vec_id")


@register("r05_model_guard", "SELECT model_name, model_version, count(*) AS rows, count(*) FILTER (WHERE len(vector) <> dimensions) AS mismatched FROM embedding_cache GROUP BY 1, 2")
def r05(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose vector is not of the model's size."""
    return load(spark, d, "embedding_cache").groupBy("model_name", "model_version").agg(F.count("*").alias("rows"), F.count(F.when(F.size("vector") != F.col("dimensions"), 1)).alias("mismatched"))


@register("r06_role_retrieval", "SELECT feedback_token, uid, round((1.0 * len(list_intersect(provenance, ['lexical', 'graph:calls'])) + 0.6 * len(list_intersect([kind], ['function', 'method']))) / 3.2, 6) AS structural FROM context_symbols WHERE provenance IS NOT NULL AND kind IS NOT NULL GROUP BY feedback_token, uid, provenance, kind")
def r06(spark: SparkSession, d: str) -> DataFrame:
    """Share of a role's evidence that each symbol has."""
    s = load(spark, d, "context_symbols").where("provenance is not null and kind is not null").select("feedback_token", "uid", "provenance", "kind").distinct()
    score = rk.structural_score(F.col("provenance"), F.array("kind"), F.array(F.lit("lexical"), F.lit("graph:calls")), F.array(F.lit("function"), F.lit("method")))
    return s.select("feedback_token", "uid", F.round(score, 6).alias("structural"))


_TOK = r"regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]+')"
_POST = f"""p AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2), l AS (SELECT doc, sum(tf) AS dl FROM p GROUP BY 1), t AS (SELECT count(*) AS n, avg(dl) AS avg FROM l)"""
_BM25 = """h AS (SELECT * FROM p WHERE term IN ('resolver', 'queue', 'timeout', 'cache')), df AS (SELECT term, count(DISTINCT doc) AS df FROM h GROUP BY 1),
b AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))) AS score FROM h JOIN df USING (term) JOIN l USING (doc), t GROUP BY 1)"""
TERMS = ("resolver", "queue", "timeout", "cache")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return rk.bm25(spread(load(spark, d, "documents").select("doc_id", "text")), "doc_id", [(tx.identifier_parts(F.col("text")), 1.0)], TERMS)


@register("r07_bm25", f"WITH {_POST}, {_BM25} SELECT doc, round(score, 6) AS score FROM b")
def r07(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of all documents for a query."""
    return _lexical(spark, d).select("doc", F.round("score", 6).alias("score"))


@register("r08_rare_terms", f"WITH {_POST}, d AS (SELECT term, count(DISTINCT doc) AS df FROM p WHERE length(term) >= 3 GROUP BY 1) SELECT term, df FROM d WHERE df BETWEEN 2 AND 32")
def r08(spark: SparkSession, d: str) -> DataFrame:
    """Terms rare enough to lift a row."""
    terms = spread(load(spark, d, "documents").select("text")).select(F.explode(F.array_distinct(tx.identifier_parts(F.col("text")))).alias("term"))
    return terms.where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("df")).where("df between 2 and 32")


@register("r09_exact_boost", f"{views.sql('symbols')} SELECT uid, CASE WHEN name = 'rank_policy' THEN 12.0 WHEN ends_with(qualified_name, '.rank_policy') THEN 9.0 WHEN contains(qualified_name, 'policy') THEN 1.0 ELSE 0.0 END::DOUBLE AS boost FROM symbols")
def r09(spark: SparkSession, d: str) -> DataFrame:
    """Boost of exact identifiers."""
    b = F.when(F.col("name") == "rank_policy", 12.0).when(F.col("qualified_name").endswith(".rank_policy"), 9.0).when(F.contains("qualified_name", F.lit("policy")), 1.0).otherwise(0.0)
    return views.symbols(spark, d).select("uid", b.alias("boost"))


_ASK = "Where does `rank_policy` replay the retry.queue for clientUrl after token expiry, and who calls merge_decorator?"
_L = r"regexp_extract_all(coalesce({}, ''), '[A-Za-z_][A-Za-z0-9_.$:-]*')"
_TOKENS = r"flatten(list_transform(" + _L + r", lambda r: list_concat([lower(r)], list_filter(regexp_split_to_array(lower(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[.$:/\-_ ]+'), lambda p: p <> '' AND p <> lower(r)))))"
_BODY = r"list_filter(list_distinct(list_concat(list_transform(" + _L + r", lambda r: lower(r)), flatten(list_transform(" + _L + r", lambda r: regexp_split_to_array(lower(r), '[.$:/\-]+'))))), lambda t: length(t) >= 3)"
_ASKED = lx.query_tokens(_ASK)
_EXACT = ", ".join(f"'{t}'" for t in lx.exact_terms(_ASK))
_LEXICAL = f"""{views.sql('symbols')}, code AS (SELECT uid, max(code) AS code FROM context_symbols WHERE uid IS NOT NULL GROUP BY 1), asked(token, times) AS (VALUES {", ".join(f"('{t}', {n})" for t, n in _ASKED.items())}),
f AS (SELECT uid, unnest({_TOKENS.format('name')}) AS token, 5.0 AS w FROM symbols UNION ALL SELECT uid, unnest({_TOKENS.format('qualified_name')}), 3.0 FROM symbols UNION ALL SELECT uid, unnest({_TOKENS.format('file_path')}), 1.0 FROM symbols UNION ALL SELECT uid, unnest({_TOKENS.format('kind')}), 1.0 FROM symbols),
own AS (SELECT uid, token, sum(w)::DOUBLE AS tf FROM f GROUP BY 1, 2), bodies AS (SELECT uid, unnest({_BODY.format('code', 'code')}) AS token FROM code), rare AS (SELECT token FROM bodies GROUP BY 1 HAVING count(*) <= 32), held AS (SELECT uid, token FROM bodies WHERE token IN (SELECT token FROM rare)),
docs AS (SELECT * FROM own UNION ALL SELECT uid, token, 1.0 FROM held ANTI JOIN own USING (uid, token)), len AS (SELECT uid, sum(tf) AS dl FROM docs GROUP BY 1), st AS (SELECT (SELECT count(*) FROM symbols) AS n, greatest(1.0, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM symbols)) AS mean), df AS (SELECT token, count(*) AS df FROM docs GROUP BY 1),
bm AS (SELECT uid, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS s FROM docs JOIN asked USING (token) JOIN df USING (token) JOIN len USING (uid), st GROUP BY 1)"""
_SEARCHED = f"""{_LEXICAL}, met AS (SELECT uid, count(*) AS met FROM held JOIN asked USING (token) GROUP BY 1), base AS (SELECT uid, name, qualified_name, coalesce(met, 0) AS met, coalesce(s, 0) AS s FROM symbols LEFT JOIN bm USING (uid) LEFT JOIN met USING (uid)),
lift AS (SELECT uid, 0.9 * (SELECT max(s) FROM base) AS lift FROM base WHERE met > 0 ORDER BY met DESC, round(s, 9) DESC, uid LIMIT 4),
x AS (SELECT uid, lower(name) IN ({_EXACT}) AS by_name, len(list_filter([{_EXACT}], lambda t: lower(qualified_name) = t OR ends_with(lower(qualified_name), '.' || t) OR ends_with(lower(qualified_name), ':' || t))) > 0 AS by_end FROM symbols),
hit AS (SELECT uid, greatest(s, coalesce(lift, 0)) + CASE WHEN by_name THEN 12 WHEN by_end THEN 9 ELSE 0 END AS score, coalesce(by_name OR by_end, false) AS exact FROM base LEFT JOIN lift USING (uid) JOIN x USING (uid))"""


def _symbols_with_code(spark: SparkSession, d: str) -> DataFrame:
    code = load(spark, d, "context_symbols").where("uid is not null").groupBy("uid").agg(F.max("code").alias("code"))
    return views.symbols(spark, d).join(code, "uid")


@register("r07_fielded_search", f"{_SEARCHED} SELECT uid, round(score, 6) AS score, exact FROM hit WHERE score > 0 ORDER BY round(score, 9) DESC, uid LIMIT 40")
def r07_fielded(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over weighted fields, rare words of bodies lifted, exact names raised: the best 40."""
    return lx.search(_symbols_with_code(spark, d), _ASK, 40).select("uid", F.round("score", 6).alias("score"), "exact")


@register("r10_lexical_seeds", f"{_SEARCHED}, t AS (SELECT * FROM hit WHERE score > 0 ORDER BY round(score, 9) DESC, uid LIMIT 16), symbols2 AS (SELECT uid, file_path, false AS reexport FROM symbols) SELECT uid, round(least(1, score / (SELECT max(score) FROM t)) * CASE {_TIER} WHEN 'test' THEN 0.0 WHEN 'example' THEN 0.2 WHEN 'doc' THEN 0.3 WHEN 'stub' THEN 0.5 ELSE 1.0 END, 6)::DOUBLE AS score, exact FROM t JOIN symbols2 USING (uid)")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """The lexical channel's seeds, weighted by tier."""
    return lx.seeds(_symbols_with_code(spark, d), _ASK).select("uid", F.round("score", 6).alias("score"), "exact")


@register("r11_chunk_seeds", f"{views.sql('chunks')} SELECT owner_uid, min(score) AS distance FROM chunks WHERE owner_uid IS NOT NULL AND isfinite(score) GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Owners of the best chunks."""
    c = views.chunks(spark, d).where("owner_uid is not null and score is not null and not isnan(score) and abs(score) < double('infinity')")
    return c.groupBy("owner_uid").agg(F.min("score").alias("distance")).orderBy("distance", "owner_uid").limit(25)


def _fused(spark: SparkSession, d: str, lexical: DataFrame) -> DataFrame:
    v = _distances(spark, d).select(F.col("vec_id").alias("uid"), F.round(-F.col("d"), 9).alias("score"))
    b = lexical.select(F.col("doc").alias("uid"), F.round("score", 9).alias("score"))
    return rk.reciprocal_rank_fusion({"vector": (v, 1.0), "lexical": (b, 1.15)}).select("uid", F.round("score", 9).alias("score"))


@register("r13_rank_fusion", f"""WITH {_Q}, {_POST}, {_BM25}, a AS (SELECT vec_id AS uid, 1.0 / (60 + row_number() OVER (ORDER BY round(-d, 9) DESC, vec_id DESC)) AS s FROM v),
c AS (SELECT doc AS uid, 1.15 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, doc DESC)) AS s FROM b), u AS (SELECT * FROM a UNION ALL SELECT * FROM c) SELECT uid, round(sum(s) / (1.0 / 61 + 1.15 / 61), 9) AS score FROM u GROUP BY 1""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """Vector and lexical channels fused by reciprocal rank, over all documents; vectors and documents meet by id."""
    return _fused(spark, d, _lexical(spark, d))


@register("r14_calibrated_blend", f"""WITH {_Q}, x AS (SELECT vec_id, 1 - d * d / 2 AS sim, (vec_id % 17)::DOUBLE AS base FROM v), m AS (SELECT median(sim) AS med FROM x), a AS (SELECT median(abs(sim - med)) AS mad FROM x, m), w AS (SELECT median(sim) AS weak FROM x, m WHERE sim <= med),
s AS (SELECT weak + 1.4826 * mad AS floor FROM a, w), p AS (SELECT quantile_cont(sim, 0.95) AS p95, min(base) AS lo, max(base) AS hi FROM x) SELECT vec_id, round(0.6 * (base - lo) / (hi - lo) + 0.4 * CASE WHEN p95 > floor THEN greatest(0, least(1, (sim - floor) / (p95 - floor))) ELSE 0 END, 6) AS score FROM x, s, p""")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """A base score blended with calibrated similarity."""
    x = _distances(spark, d).select("vec_id", (1 - F.col("d") * F.col("d") / 2).alias("sim"), (F.col("vec_id") % 17).cast("double").alias("base"))
    return rk.blend(x, "base", "sim", "score", 0.4).select("vec_id", F.round("score", 6).alias("score"))


@register("r15_semantic_boost", f"WITH {_Q} SELECT vec_id, round(least(1, label / 20.0 + 0.20 * greatest(0, 1 - d * d / 2)), 6) AS score FROM v")
def r15(spark: SparkSession, d: str) -> DataFrame:
    """A graph score raised by positive similarity only."""
    return _distances(spark, d).select("vec_id", F.round(F.least(F.lit(1.0), F.col("label") / 20.0 + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("d") * F.col("d") / 2)), 6).alias("score"))


@register("r16_axis_boost", "SELECT DISTINCT feedback_token, uid, least(1.0, 0.5 + CASE WHEN list_has_any(provenance, ['lexical']) THEN 0.15 ELSE 0 END)::DOUBLE AS score FROM context_symbols WHERE provenance IS NOT NULL")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """A boost where axes overlap."""
    b = F.when(F.arrays_overlap("provenance", F.array(F.lit("lexical"))), 0.15).otherwise(0.0)
    return load(spark, d, "context_symbols").where("provenance is not null").select("feedback_token", "uid", F.least(F.lit(1.0), 0.5 + b).alias("score")).distinct()


@register("r17_intent_classify", f"WITH {_Q}, s AS (SELECT label, max(1 - d * d / 2) AS c FROM v GROUP BY 1) SELECT label, round(c, 6) AS similarity FROM s WHERE c >= 0.20 AND (c >= 0.21 OR c >= 0.92 * (SELECT max(c) FROM s)) ORDER BY round(c, 9) DESC, label LIMIT 3")
def r17(spark: SparkSession, d: str) -> DataFrame:
    """Up to three roles that a query is like."""
    s = _distances(spark, d).groupBy("label").agg(F.max(1 - F.col("d") * F.col("d") / 2).alias("c"))
    best = s.agg(F.max("c"))
    return s.where((F.col("c") >= 0.20) & ((F.col("c") >= 0.21) | (F.col("c") >= 0.92 * best.scalar()))).orderBy(F.desc(F.round("c", 9)), "label").limit(3).select("label", F.round("c", 6).alias("similarity"))


@register("r18_role_resolve", "WITH dim(role2, kinds, rels) AS (VALUES ('entry', ['function'], ['caller']), ('model', ['class'], ['callee']), ('any', ['method', 'function', 'class'], ['caller', 'callee'])) SELECT DISTINCT uid, role2 FROM context_symbols, dim WHERE uid IS NOT NULL AND (list_contains(kinds, kind) OR list_contains(rels, direction))")
def r18(spark: SparkSession, d: str) -> DataFrame:
    """Roles that fire on a kind or a relation: evidence is exploded and joined for equality."""
    dim = {"entry": (["function"], ["caller"]), "model": (["class"], ["callee"]), "any": (["method", "function", "class"], ["caller", "callee"])}
    rows = [(r, "k:" + k) for r, (ks, _) in dim.items() for k in ks] + [(r, "r:" + x) for r, (_, xs) in dim.items() for x in xs]
    ev = load(spark, d, "context_symbols").where("uid is not null").select("uid", F.explode(F.array(F.concat(F.lit("k:"), "kind"), F.concat(F.lit("r:"), "direction"))).alias("e"))
    return ev.join(spark.createDataFrame(rows, "role2 string, e string"), "e").select("uid", "role2").distinct()


@register("r19_seed_selection")
def r19(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of each snapshot: seven of a role, anchors and an exact hit reserved, raised where roles and channels agree."""
    fin = F.when(~F.isnan("utility_score") & (F.abs("utility_score") < float("inf")), F.col("utility_score"))
    shown = load(spark, d, "retrieval_snapshots").where("feedback_token is not null").groupBy("feedback_token").agg(F.min("symbol").alias("asked"))
    s = load(spark, d, "context_symbols").where("feedback_token is not null and uid is not null and role is not null").join(shown, "feedback_token", "left")
    c = s.groupBy("feedback_token", "role", "uid").agg(F.max(fin).alias("u"), F.max(F.coalesce(F.col("symbol") == F.col("asked"), F.lit(False))).alias("exact"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("provenance", F.array().cast("array<string>")))))).alias("channels"))
    c = c.withColumn("place", F.row_number().over(W.partitionBy("feedback_token", "role").orderBy(F.desc_nulls_last("u"), "uid")))
    c = c.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("u", F.lit(0.0)))))
    got = se.select_seeds(c, "feedback_token", ["orchestrator", "executor"], frozenset({"abstract_contract"}), role_boost=0.05, channel_boost=0.02, exact_boost=0.1)
    return got.withColumn("score", F.round("score", 6))


@register("r20_path_proximity", rf"{views.sql('symbols')} SELECT uid, CASE WHEN regexp_replace(file_path, '/?[^/]*$', '') = 'sync' THEN 0.15 WHEN regexp_replace(file_path, '/?[^/]*$', '') <> '' AND regexp_replace(regexp_replace(file_path, '/?[^/]*$', ''), '/?[^/]*$', '') = '' THEN 0.05 ELSE 0 END::DOUBLE AS boost FROM symbols")
def r20(spark: SparkSession, d: str) -> DataFrame:
    """Boost by nearness of paths."""
    return views.symbols(spark, d).select("uid", rk.proximity_boost(F.col("file_path"), F.lit("sync/x.py")).alias("boost"))


@register("r23_unified_search", """WITH s AS (SELECT 'symbol' AS type, file_path AS file, symbol AS title, relevance_score AS score FROM context_symbols WHERE isfinite(relevance_score) UNION ALL SELECT 'doc', source_file, chunk_id, score FROM context_docs WHERE isfinite(score))
SELECT type, file, title, round(max(score), 6) AS score, count(*) AS n FROM s GROUP BY 1, 2, 3 ORDER BY max(score) DESC, count(*) DESC, type, file, title LIMIT 50""")
def r23(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and documents in one list, the best of each, 50 in all."""
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    s = load(spark, d, "context_symbols").where(fin("relevance_score")).select(F.lit("symbol").alias("type"), F.col("file_path").alias("file"), F.col("symbol").alias("title"), F.col("relevance_score").alias("score"))
    c = load(spark, d, "context_docs").where(fin("score")).select(F.lit("doc").alias("type"), F.col("source_file").alias("file"), F.col("chunk_id").alias("title"), "score")
    g = s.unionByName(c).groupBy("type", "file", "title").agg(F.max("score").alias("m"), F.count("*").alias("n"))
    return g.orderBy(F.desc("m"), F.desc("n"), "type", F.asc_nulls_last("file"), "title").limit(50).select("type", "file", "title", F.round("m", 6).alias("score"), "n")


@register("r24_symbol_resolution", f"{views.sql('symbols')}, r AS (SELECT name, uid, file_path, row_number() OVER (PARTITION BY name ORDER BY k DESC, file_path NULLS LAST, uid) AS n FROM symbols JOIN (SELECT uid, count(*) AS k FROM context_symbols GROUP BY 1) USING (uid)) SELECT name, uid FROM r WHERE n = 1")
def r24(spark: SparkSession, d: str) -> DataFrame:
    """The symbol a name means: the most linked, then by path and uid."""
    k = load(spark, d, "context_symbols").groupBy("uid").agg(F.count("*").alias("k"))
    return lk.first_by(views.symbols(spark, d).join(k, "uid"), ["name"], [F.desc("k"), F.asc_nulls_last("file_path"), F.col("uid")]).select("name", "uid")


@register("r25_model_benchmark", f"WITH {_Q}, t AS (SELECT label, row_number() OVER (ORDER BY round(d, 9), vec_id) AS r FROM v) SELECT k, round(avg((label = (SELECT label FROM embeddings WHERE vec_id = 0))::INT), 6) AS precision FROM t, (VALUES (1), (5), (10), (50)) x(k) WHERE r <= k GROUP BY 1")
def r25(spark: SparkSession, d: str) -> DataFrame:
    """Precision at several depths."""
    own = load(spark, d, "embeddings").where("vec_id = 0").select("label")
    top = _distances(spark, d).orderBy(F.round("d", 9), "vec_id").limit(50).withColumn("r", F.row_number().over(W.orderBy(F.round("d", 9), "vec_id"))).withColumn("hit", (F.col("label") == own.scalar()).cast("int"))
    return top.select(F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 50)])).alias("k"), "r", "hit").where("r <= k").groupBy("k").agg(F.round(F.avg("hit"), 6).alias("precision"))


@register("o02_token_estimate", "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def o02(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a text, about."""
    return load(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@register("o03_class_folding", f"{views.sql('symbols')}, p AS (SELECT regexp_replace(qualified_name, '\\.[^.]*$', '') AS parent, name FROM symbols WHERE name IS NOT NULL) SELECT parent, string_agg(name, ', ' ORDER BY name) AS members, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2")
def o03(spark: SparkSession, d: str) -> DataFrame:
    """Members of a parent in one line, where there are two or more."""
    p = views.symbols(spark, d).where("name is not null").select(F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("parent"), "name")
    return p.groupBy("parent").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("members"), F.count("*").alias("n")).where("n >= 2")


_POOL = "c AS (SELECT feedback_token AS q, uid, greatest(max(relevance_score), 1e-9) AS u FROM context_symbols WHERE isfinite(relevance_score) AND feedback_token IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2)"


@register("o04_leader_pool", f"""WITH {_POOL}, m AS (SELECT q, max(u) AS peak, median(u) AS mid, count(*) AS n FROM c GROUP BY 1), g AS (SELECT q, u, 100.0 * u / peak AS g, mid, n FROM c JOIN m USING (q)), a AS (SELECT q, median(g) FILTER (WHERE u <= mid) AS med FROM g GROUP BY 1),
b AS (SELECT q, median(abs(g - med)) FILTER (WHERE u <= mid) AS mad FROM g JOIN a USING (q) GROUP BY 1), x AS (SELECT q, g, n, CASE WHEN n <= 1 THEN 1.0 ELSE greatest(1.0, med + 1.4826 * mad) END AS noise FROM g JOIN a USING (q) JOIN b USING (q))
SELECT q, round(max(noise), 6) AS noise, greatest(1, count(*) FILTER (WHERE g > noise AND n > 1)) AS leaders, greatest(1, floor(6000 / greatest(1, count(*) FILTER (WHERE g > noise AND n > 1))))::BIGINT AS step_limit FROM x GROUP BY 1""")
def o04(spark: SparkSession, d: str) -> DataFrame:
    """How weak each query's noise is, how many stand out of it, and what each may spend of 6000 tokens."""
    return se.leaders(_pool(spark, d), "q", "u", 6000).withColumn("noise", F.round("noise", 6))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "context_symbols").where("feedback_token is not null and uid is not null and relevance_score is not null and not isnan(relevance_score) and abs(relevance_score) < double('infinity')")
    return s.groupBy(F.col("feedback_token").alias("q"), "uid").agg(F.max("relevance_score").alias("u"), F.min("file_path").alias("file_path"), F.min("role").alias("role"), F.min("relation").alias("relation"), F.max("is_dirty").alias("passive"), F.max(F.coalesce(tx.token_estimate(F.col("code")), F.lit(20))).alias("tokens"))


@register("o05_coverage_packer")
def o05(spark: SparkSession, d: str) -> DataFrame:
    """Bundles bought under a budget of 400 tokens for each snapshot; a bundle is a symbol and the one after it."""
    c = _pool(spark, d).where("u > 0")
    w = W.partitionBy("q").orderBy("uid")
    one = F.struct("uid", "tokens", F.lit(0.0).alias("semantic"))
    c = c.withColumn("own", one).withColumn("next", F.lead("own").over(w))
    tier = F.create_map(*[F.lit(x) for kv in se.PACK_TIER.items() for x in kv])[tx.file_tier(F.col("file_path"))]
    weight = F.coalesce(tier, F.lit(1.0))
    files = F.when(F.col("file_path").isNotNull(), F.array(F.struct(F.col("file_path").alias("path"), weight.alias("weight")))).otherwise(F.array().cast("array<struct<path:string,weight:double>>"))
    steps = F.array_compact(F.array("relation"))
    b = c.select("q", F.col("uid").alias("bundle"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("passive", F.lit(False)).alias("passive"), F.col("u").alias("utility"), weight.alias("weight"), F.lit(0.0).alias("bridge"), files.alias("files"), steps.alias("steps"), F.array_compact(F.array("own", "next")).alias("symbols"))
    return se.pack(b, "q", 400).withColumn("gain", F.round("gain", 6))


@register("o01_render_ladder", "SELECT uid, string_split(max(code), chr(10))[1] AS signature, length(max(code)) AS n_full FROM context_symbols WHERE code IS NOT NULL AND code <> '' AND uid IS NOT NULL GROUP BY 1")
def o01(spark: SparkSession, d: str) -> DataFrame:
    """A symbol at the lowest and highest rung."""
    c = load(spark, d, "context_symbols").where("code is not null and code <> '' and uid is not null").groupBy("uid").agg(F.max("code").alias("code"))
    return c.select("uid", se.render(F.col("code"), "signature_only").alias("signature"), F.length(se.render(F.col("code"), "full")).alias("n_full"))


@register("o01_render_fold", r"""WITH c AS (SELECT uid, string_split(max(code), chr(10)) AS l FROM context_symbols WHERE code IS NOT NULL AND code <> '' AND uid IS NOT NULL GROUP BY 1)
SELECT uid, array_to_string(list_filter(l, lambda x, i: i = 1 OR regexp_matches(x, '^\s*(async def|def|class|func|function|fn|public|private|protected|export|interface|type|@)') OR regexp_matches(x, '^\s*(return|raise|yield)\b')), chr(10)) AS folded FROM c""")
def o01_fold(spark: SparkSession, d: str) -> DataFrame:
    """A symbol folded to its declarations and returns."""
    c = load(spark, d, "context_symbols").where("code is not null and code <> '' and uid is not null").groupBy("uid").agg(F.max("code").alias("code"))
    return c.select("uid", se.render(F.col("code"), "fold").alias("folded"))


@register("o10_cross_file_freeze", f"{views.sql('symbols')}, f AS (SELECT DISTINCT file_path FROM symbols WHERE uid LIKE '0%') SELECT uid, file_path NOT IN (SELECT file_path FROM f WHERE file_path IS NOT NULL) AS frozen FROM symbols WHERE file_path IS NOT NULL")
def o10(spark: SparkSession, d: str) -> DataFrame:
    """Whether a symbol lies outside the files of the seeds."""
    s = views.symbols(spark, d).where("file_path is not null")
    seed = s.where("uid like '0%'").select("file_path").distinct().withColumn("seed", F.lit(True))
    return s.join(seed, "file_path", "left").select("uid", F.col("seed").isNull().alias("frozen"))


QUERIES, ORACLES = R.queries, R.oracles
