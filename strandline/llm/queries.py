"""Queries of the llm operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import conversations as conv
from . import leakage, markup, moderation, ranking, splitting, tokens, vectors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop, at the clocks of the senders; where those are right, as in the supplied tables, times stay as stamped."""
    return conv.rejected(load(spark, sf_dir, "messages"), load(spark, sf_dir, "conversations"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations, turn by turn."""
    out = conv.assemble(load(spark, sf_dir, "messages"), load(spark, sf_dir, "conversations"))
    return out.withColumn("at", F.unix_millis("at"))


def p1_clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's clock against the user's that each conversation by itself asks for."""
    return conv.clock_offsets(conv.read_messages(load(spark, sf_dir, "messages")))


def p1_sender_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of each workspace's assistant against its users', by least squares under the constraints of all its conversations."""
    return conv.sender_offsets(conv.read_messages(load(spark, sf_dir, "messages")), load(spark, sf_dir, "conversations"))


#: The entries of context_symbols.scores.
SCORES = ("graph_score", "semantic_score", "lexical_score", "intent_weight")


def _closeness(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame | None]:
    scores = {n: F.col(n) for n in ("utility_score", "relevance_score")} | {n: F.col("scores")[n] for n in SCORES}
    symbols = load(spark, sf_dir, "context_symbols")
    hot = ranking.hot_groups(symbols, "feedback_token")
    return ranking.closeness(symbols, "feedback_token", "uid", scores, hot=hot), hot


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols to show for each snapshot, by one ranking of six scores."""
    ranked, hot = _closeness(spark, sf_dir)
    return ranking.top(ranked, load(spark, sf_dir, "retrieval_snapshots"), "feedback_token", "uid", "selected_count", hot).select("feedback_token", "uid")


def p2_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank key of every symbol of every snapshot."""
    return _closeness(spark, sf_dir)[0].withColumn("closeness", F.round("closeness", 6))


def _model() -> Column:
    return F.to_json(F.array("model_name", "model_version"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = load(spark, sf_dir, "embedding_cache").where(vectors.well_formed(F.col("vector"), F.col("dimensions")) & F.col("content_hash").isNotNull())
    return cache.select(_model().alias("g"), F.col("content_hash").alias("key"), F.col("vector").alias("v"), F.struct("last_used_at", "created_at", "embedding_hash").alias("v_order"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar keys of each probe, among the rows of its model and version."""
    probes = load(spark, sf_dir, "vector_probes").select(F.col("probe_id").alias("query_id"), _model().alias("g"), F.col("content_hash").alias("key"))
    return vectors.nearest(_cache(spark, sf_dir), probes).select(F.col("query_id").alias("probe_id"), F.col("key").alias("content_hash"))


def p3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in embeddings: every 50th vector against all."""
    e = load(spark, sf_dir, "embeddings").where(vectors.well_formed(F.col("embedding"), F.size("embedding")) & F.col("vec_id").isNotNull())
    key = F.col("vec_id").cast("string")
    rows = e.select(F.lit("all").alias("g"), key.alias("key"), F.col("embedding").alias("v"), F.lit(0).alias("v_order"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("g"), key.alias("key"))
    return vectors.nearest(rows, asked).select(F.col("query_id").alias("vec_id"), F.col("key").cast("bigint").alias("neighbour"), "rank")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "context_docs").select(F.lit("doc").alias("item_type"), F.col("chunk_id").alias("item_id"), F.col("content").alias("text"))
    code = load(spark, sf_dir, "context_symbols").select(F.lit("symbol").alias("item_type"), F.col("uid").alias("item_id"), F.col("code").alias("text"))
    return docs.unionByName(code)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and symbols that had to be split, and whether inside a word."""
    return splitting.cuts(_items(spark, sf_dir), load(spark, sf_dir, "split_limits"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents and symbols."""
    return splitting.pieces(_items(spark, sf_dir), load(spark, sf_dir, "split_limits"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and the evaluation items that leaked into them."""
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).where("exact").select("doc_id", "item_id").distinct()


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item's text is in a document, edited copies included: all with a share of at least a half, by alignment."""
    found = leakage.edited_copies(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return leakage.best_fields(found).withColumn("share", F.round("share", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of markup in each chunk."""
    return markup.kinds(load(spark, sf_dir, "context_docs"), "chunk_id", "content").select("chunk_id", "markup")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of each chunk."""
    return markup.clean(load(spark, sf_dir, "context_docs"), "chunk_id", "content").select("chunk_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are abusive, hateful or sexual."""
    return moderation.cases(moderation.score_documents(load(spark, sf_dir, "documents")))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return moderation.score_documents(load(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of such documents for each source."""
    return moderation.rates(moderation.score_documents(load(spark, sf_dir, "documents"), keep=("source",)))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p8_found": p8_found, "p8_alignments": p8_alignments, "p6_found": p6_found, "p6_pieces": p6_pieces, "p3_found": p3_found, "p3_embeddings": p3_embeddings, "p7_ids": p7_ids, "p2_found": p2_found, "p2_closeness": p2_closeness, "p1_found": p1_found, "p1_turns": p1_turns, "p1_clock_offsets": p1_clock_offsets, "p1_sender_offsets": p1_sender_offsets}

#: Messages as read, shared by the statements of problem 1.
_READ = r"""
raw AS (SELECT conversation_id, request_id, content_hash, content_summary, lower(trim(role)) AS r, trim(created_at) AS c FROM messages
  WHERE conversation_id IS NOT NULL AND length(trim(replace(replace(replace(replace(content_summary, chr(160), ''), chr(9), ''), chr(10), ''), chr(13), ''))) > 0),
read AS (SELECT conversation_id, request_id, content_hash, content_summary,
  CASE WHEN r IN ('user','human','customer','client','prompter','person','end_user','usr') THEN 'user'
       WHEN r IN ('assistant','ai','bot','model','chatbot','agent','gpt','chatgpt','asst') THEN 'assistant'
       WHEN r IN ('system','sys','developer') THEN 'system' END AS role,
  CASE WHEN regexp_full_match(c, '\d{11,15}') THEN try_cast(c AS BIGINT)
       WHEN regexp_full_match(c, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?')
       THEN epoch_ms(try_cast(CASE WHEN regexp_matches(c, '(Z|[+-]\d\d:\d\d)$') THEN c ELSE c || 'Z' END AS TIMESTAMPTZ)) END AS "at" FROM raw),
msg AS (SELECT conversation_id, role, request_id, content_hash, min("at") AS "at", min(content_summary) AS content FROM read GROUP BY ALL)
"""
_READ = _READ.replace("GROUP BY ALL", "GROUP BY conversation_id, role, request_id, content_hash")
_FOUND = r"""
ids AS (SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL UNION SELECT id FROM conversations WHERE id IS NOT NULL),
seq AS (SELECT conversation_id, role, lag(role) OVER w AS p, lead(role) OVER w AS n FROM msg WHERE role IS DISTINCT FROM 'system'
  WINDOW w AS (PARTITION BY conversation_id ORDER BY "at", role DESC)),
s AS (SELECT conversation_id, bool_or(role = 'assistant' AND (p IS NULL OR p = 'assistant')) AS b, bool_or(role = 'user' AND (n IS NULL OR n = 'user')) AS u FROM seq GROUP BY 1),
m AS (SELECT conversation_id, bool_or(role IS DISTINCT FROM 'system') AS t, bool_or(role IS NULL OR "at" IS NULL) AS x FROM msg GROUP BY 1),
found AS (SELECT conversation_id, CASE WHEN NOT coalesce(m.t, false) THEN 'empty'
  WHEN conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL) OR m.x OR s.b THEN 'broken' WHEN s.u THEN 'no_reply' END AS reason
  FROM ids LEFT JOIN m USING (conversation_id) LEFT JOIN s USING (conversation_id))
"""
_NAMES = ("utility_score", "relevance_score", *SCORES)


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("$", n) for n in _NAMES)


_CLOSENESS = f"""
s AS (SELECT feedback_token AS g, uid AS k, {_each("max(CASE WHEN isfinite($) THEN $ END) AS $")} FROM
  (SELECT feedback_token, uid, utility_score, relevance_score, {", ".join(f"scores['{n}'] AS {n}" for n in SCORES)} FROM context_symbols)
  WHERE feedback_token IS NOT NULL AND uid IS NOT NULL GROUP BY 1, 2),
m AS (SELECT g, {_each("quantile_disc($, 0.5) AS $_m")} FROM s GROUP BY 1),
d AS (SELECT g, {_each("quantile_disc(abs($ - $_m), 0.5) AS $_d, avg(abs($ - $_m)) AS $_a")} FROM s JOIN m USING (g) GROUP BY 1),
c AS (SELECT g, k, {_each("CASE WHEN $ IS NOT NULL THEN least(greatest($, $_m - 3 * CASE WHEN $_d > 0 THEN 1.4826 * $_d ELSE 1.2533 * $_a END), $_m + 3 * CASE WHEN $_d > 0 THEN 1.4826 * $_d ELSE 1.2533 * $_a END) END AS $")}
  FROM s JOIN m USING (g) JOIN d USING (g)),
e AS (SELECT g, {_each("max($) AS $_h, min($) AS $_l, var_pop($) * count($) AS $_n")} FROM c GROUP BY 1),
b AS (SELECT g, k, {_each("CASE WHEN $_n > 0 THEN coalesce(($ - $_h) ** 2 / $_n, 0) ELSE 0 END", " + ")} AS b, {_each("CASE WHEN $_n > 0 THEN coalesce(($ - $_l) ** 2 / $_n, 0) ELSE 0 END", " + ")} AS w,
  {_each("($ IS NOT NULL)::INT", " + ")} AS t FROM c JOIN e USING (g)),
closeness AS (SELECT g AS feedback_token, k AS uid, CASE WHEN t > 0 AND b + w > 0 THEN sqrt(w / t) / (sqrt(b / t) + sqrt(w / t)) ELSE 0.5 END AS closeness FROM b)
"""
#: White space of Unicode, for RE2.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLES = {
    "p6_found": f"""WITH i AS (SELECT DISTINCT 'doc' AS item_type, chunk_id AS item_id, content AS t FROM context_docs UNION SELECT DISTINCT 'symbol', uid, code FROM context_symbols),
l AS (SELECT i.*, max_chars FROM i JOIN (SELECT item_type, min(max_chars) AS max_chars FROM split_limits WHERE max_chars > 0 GROUP BY 1) USING (item_type) WHERE length(t) > max_chars)
SELECT item_type, item_id, CASE WHEN max(list_max(list_transform(regexp_split_to_array(t, '{_SPACE}'), lambda x: length(x))) - max_chars) > 0 THEN 'hard' ELSE 'natural' END AS cut FROM l GROUP BY 1, 2""",
    "p3_found": """WITH v AS (SELECT model_name, model_version, content_hash, vector, row_number() OVER (PARTITION BY model_name, model_version, content_hash ORDER BY last_used_at DESC NULLS LAST, created_at DESC NULLS LAST, embedding_hash DESC NULLS LAST) AS n
  FROM embedding_cache WHERE vector IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND content_hash IS NOT NULL),
u AS (SELECT * FROM v WHERE n = 1),
p AS (SELECT DISTINCT probe_id, model_name, model_version, content_hash, vector FROM vector_probes JOIN u USING (model_name, model_version, content_hash)),
s AS (SELECT probe_id, u.content_hash, row_number() OVER (PARTITION BY probe_id ORDER BY list_cosine_similarity(p.vector::DOUBLE[], u.vector::DOUBLE[]) DESC, u.content_hash) AS r
  FROM p JOIN u ON p.model_name = u.model_name AND p.model_version = u.model_version AND p.content_hash <> u.content_hash)
SELECT probe_id, content_hash FROM s WHERE r <= 10""",
    "p3_embeddings": """WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id::VARCHAR) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT * FROM s WHERE rank <= 10""",
    "p2_closeness": f"WITH {_CLOSENESS} SELECT feedback_token, uid, round(closeness, 6) AS closeness FROM closeness",
    "p2_found": f"""WITH {_CLOSENESS}, l AS (SELECT feedback_token, max(selected_count) AS n FROM retrieval_snapshots GROUP BY 1),
r AS (SELECT feedback_token, uid, row_number() OVER (PARTITION BY feedback_token ORDER BY closeness DESC, uid) AS rn FROM closeness)
SELECT feedback_token, uid FROM r JOIN l USING (feedback_token) WHERE rn <= n""",
    "p1_found": f"WITH {_READ}, {_FOUND} SELECT conversation_id, reason FROM found WHERE reason IS NOT NULL",
    "p1_turns": f"""WITH {_READ}, {_FOUND}
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY "at", CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, request_id NULLS FIRST, content_hash NULLS FIRST) AS turn,
role, "at", content FROM msg WHERE conversation_id NOT IN (SELECT conversation_id FROM found WHERE reason IS NOT NULL)""",
    "p1_sender_offsets": f"""WITH {_READ},
asked AS (SELECT conversation_id, request_id, min("at") FILTER (WHERE role = 'user') AS u, min("at") FILTER (WHERE role = 'assistant') AS a FROM msg
  WHERE "at" IS NOT NULL AND role IN ('user', 'assistant') AND request_id IS NOT NULL GROUP BY 1, 2),
nx AS (SELECT *, lead(u) OVER (PARTITION BY conversation_id ORDER BY u, request_id) AS n FROM asked WHERE u IS NOT NULL),
s AS (SELECT id AS conversation_id, min(workspace_id) AS sender FROM conversations WHERE id IS NOT NULL GROUP BY 1),
g AS (SELECT sender, count(*) AS pairs, quantile_disc(u - a, 0.5) AS low_ms, quantile_disc(coalesce(n - a, {conv.NEVER_MS}), 0.5) AS high_ms FROM nx LEFT JOIN s USING (conversation_id) WHERE a IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN pairs < 20 THEN 0 WHEN low_ms <= high_ms THEN greatest(low_ms, least(0, high_ms)) ELSE floor((low_ms + high_ms) / 2) END::BIGINT AS offset_ms FROM g""",
    "p1_clock_offsets": f"""WITH {_READ},
asked AS (SELECT conversation_id, request_id, min("at") FILTER (WHERE role = 'user') AS u, min("at") FILTER (WHERE role = 'assistant') AS a FROM msg
  WHERE "at" IS NOT NULL AND role IN ('user', 'assistant') AND request_id IS NOT NULL GROUP BY 1, 2),
nx AS (SELECT *, lead(u) OVER (PARTITION BY conversation_id ORDER BY u, request_id) AS n FROM asked WHERE u IS NOT NULL),
o AS (SELECT conversation_id, count(*) AS pairs, max(u - a) AS low_ms, min(n - a) AS high_ms FROM nx WHERE a IS NOT NULL GROUP BY 1)
SELECT conversation_id, pairs, low_ms, high_ms, high_ms IS NULL OR low_ms <= high_ms AS feasible,
CASE WHEN high_ms IS NULL OR low_ms <= high_ms THEN greatest(low_ms, least(0, coalesce(high_ms, 0))) END AS offset_ms FROM o""",
}
