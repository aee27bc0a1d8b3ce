"""Lexical retrieval of symbols: BM25 over weighted fields, rare words of bodies, and exact names.

Tokens of metadata are counted where they stand; only those that the query asks for leave a row. Words of bodies take part while few bodies
have them, which takes one count over all of them.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import checkpoint_dir
from .ranking import ranked

#: Weights of the fields, most bodies that may have a rare word and its least length, rows lifted and to what part of the best score,
#: boosts of an exact name and of an exact end of a qualified name, and the constants of BM25.
FIELDS = {"name": 5.0, "qualified_name": 3.0, "file_path": 1.0, "kind": 1.0}
RARE_BODIES, RARE_LENGTH = 32, 3
LIFTED, LIFT = 4, 0.9
NAME_BOOST, SUFFIX_BOOST = 12.0, 9.0
K1, B = 1.2, 0.75
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.$:-]*"


def tokens(text: Column) -> Column:
    """Identifiers of a text in lower case, each with its parts between dots, underscores and changes of case; a part that is the whole counts once."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    parts = lambda r: F.filter(F.split(F.lower(F.regexp_replace(r, "([a-z0-9])([A-Z])", "$1 $2")), r"[.$:/\-_ ]+"), lambda p: (p != "") & (p != F.lower(r)))
    return F.flatten(F.transform(raw, lambda r: F.concat(F.array(F.lower(r)), parts(r))))


def query_tokens(query: str) -> Counter[str]:
    """The same of a query, counted."""
    out: Counter[str] = Counter()
    for raw in re.findall(IDENTIFIER, query):
        out[raw.lower()] += 1
        out.update(p for p in re.split(r"[.$:/\-_ ]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", raw).lower()) if p and p != raw.lower())
    return out


def exact_terms(query: str) -> list[str]:
    """Identifiers that are meant as names: quoted, or with code signs, digits or capitals inside."""
    quoted = {q.lower() for q in re.findall(f"`+({IDENTIFIER})`+", query)}
    shaped = {r.lower() for r in re.findall(IDENTIFIER, query) if re.search(r"[_.$:\-0-9]", r) or re.search("[A-Z]", r[1:])}
    return sorted(quoted | shaped)


def body_tokens(text: Column) -> Column:
    """Distinct identifiers of a body in lower case with their dotted parts, of at least three letters; case and underscores cut nothing here."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), F.lower)
    return F.filter(F.array_distinct(F.concat(raw, F.flatten(F.transform(raw, lambda r: F.split(r, r"[.$:/\-]+"))))), lambda t: F.length(t) >= RARE_LENGTH)


def _weighted(words: Column, weight: float) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("w")))


def search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``uid, score, exact``: the best ``limit`` symbols for a query. ``symbols``: uid, name, qualified_name, file_path, kind, code; one row each.

    The score is BM25 over the fields and the rare words of bodies; of the rows whose body holds a rare word of the query the best few are lifted to
    just under the top; exact names and ends of qualified names are raised last. Equal scores go by uid. A query without identifiers gives no rows.
    """
    checkpoint_dir(symbols.sparkSession)
    asked = query_tokens(query)
    s = symbols.select("uid", "code", *FIELDS)
    fields = {f: tokens(F.col(f)) for f in FIELDS}
    own = F.array_distinct(F.concat(*fields.values()))
    bodies = s.select("uid", own.alias("own"), body_tokens(F.col("code")).alias("body"))
    each = bodies.select("uid", F.explode("body").alias("token"), F.array_contains("own", F.col("token")).alias("named"))
    rare = each.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= RARE_BODIES).select("token")
    # What a row has of rare words: how many its metadata lacks, and which of them the query asks for.
    words = F.array(*map(F.lit, sorted(asked))) if asked else F.array().cast("array<string>")
    wanted = F.array_contains(words, F.col("token"))
    held = each.join(rare, "token").groupBy("uid").agg(
        F.sum(F.when(F.col("named"), 0).otherwise(1)).alias("extra"), F.collect_list(F.when(wanted & ~F.col("named"), F.col("token"))).alias("rare"), F.sum(wanted.cast("int")).alias("met")
    )
    length = sum((F.size(c) * w for c, w in ((fields[f], w) for f, w in FIELDS.items())), F.lit(0.0))
    hits = F.concat(*[_weighted(F.filter(c, lambda t: F.array_contains(words, t)), FIELDS[f]) for f, c in fields.items()])
    rows = s.select("uid", "name", "qualified_name", length.alias("length"), hits.alias("hits")).join(held, "uid", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("uid", "name", "qualified_name", (F.col("length") + F.coalesce("extra", F.lit(0))).alias("length"), F.concat("hits", _weighted(F.coalesce("rare", none), 1.0)).alias("hits"), F.coalesce("met", F.lit(0)).alias("met")).checkpoint()
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    if not n or not asked:
        return rows.select("uid", F.lit(0.0).alias("score"), F.lit(False).alias("exact")).where("false")
    tf = rows.select("uid", "length", F.explode("hits").alias("h")).groupBy("uid", "length", "h.token").agg(F.sum("h.w").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    times = F.create_map(*[F.lit(x) for kv in asked.items() for x in kv])[F.col("token")]
    part = times * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(1.0, mean)))
    base = rows.join(tf.join(df, "token").groupBy("uid").agg(F.sum(part).alias("s")), "uid", "left").select("uid", "name", "qualified_name", "met", F.coalesce("s", F.lit(0.0)).alias("s")).checkpoint()
    top = base.agg(F.max("s")).first()[0] or 1.0
    lift = base.where("met > 0").orderBy(F.desc("met"), F.desc(F.round("s", 9)), "uid").limit(LIFTED).select("uid", F.lit(LIFT * top).alias("lift"))
    terms = exact_terms(query)
    qn = F.lower("qualified_name")
    name = F.lower("name").isin(*terms) if terms else F.lit(False)
    suffix = F.lit(False)
    for t in terms:
        suffix = suffix | (qn == t) | qn.endswith(f".{t}") | qn.endswith(f":{t}")
    score = F.greatest("s", F.coalesce("lift", F.lit(0.0))) + F.when(name, NAME_BOOST).when(suffix, SUFFIX_BOOST).otherwise(0.0)
    out = base.join(lift, "uid", "left").select("uid", score.alias("score"), F.coalesce(name | suffix, F.lit(False)).alias("exact")).where("score > 0")
    return out.orderBy(F.desc(F.round("score", 9)), "uid").limit(limit)


def seeds(symbols: DataFrame, query: str, limit: int = 16, impact: bool = False) -> DataFrame:
    """``uid, score, exact``: search() as seeds, scores as parts of the best one, weighted by the tier of the file."""
    hits = search(symbols, query, limit)
    best = hits.agg(F.max("score"))
    weight = tx.tier_weight(tx.file_tier(F.col("file_path")), impact)
    return hits.join(symbols.select("uid", "file_path"), "uid").select("uid", (F.least(F.lit(1.0), F.col("score") / best.scalar()) * weight).alias("score"), "exact")


def channel_ranks(hits: DataFrame) -> DataFrame:
    """``uid, rank``: places of a channel's hits by score and uid, both descending."""
    return ranked(hits, [F.desc("score"), F.desc("uid")]).select("uid", "rank")
