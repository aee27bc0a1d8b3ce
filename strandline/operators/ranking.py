"""Retrieval scores and their fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

#: Rows that a quantile's last step sorts in one task, and the parts into which a step cuts a range.
QUANTILE_ROWS, QUANTILE_PARTS = 100_000, 1_000


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order`` (from 1), which should end in a unique column.

    Rows are dealt into ranges of the order and written, each range is numbered by itself and shifted by the rows of the ranges before it: no task
    holds more than its range.
    """
    return _placed(df, order).withColumn(rank, F.col("__shift") + F.col("__n")).drop("__p", "__n", "__shift", "__sum", "__before")


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in ``order``, by ranges as in ranked()."""
    d = _placed(df.withColumn("__value", value), order, F.col("__value"))
    return d.withColumn(out, F.col("__before") + F.col("__sum") - F.col("__value")).drop("__p", "__n", "__shift", "__sum", "__before", "__value")


def _placed(df: DataFrame, order: Sequence[Column], value: Column | None = None) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    value = F.lit(0) if value is None else value
    # Written, because the bounds of ranges are drawn anew whenever they are asked for.
    d = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    per = d.groupBy("__p").agg(F.count("*").alias("k"), F.sum(value).alias("s"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    shift = per.select("__p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__shift"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__before"))
    w = W.partitionBy("__p").orderBy(*order)
    return d.withColumns({"__n": F.row_number().over(w), "__sum": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))}).join(shift, "__p")


def quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """The exact quantile of the values that are not null, interpolated between neighbours; None if there are none.

    The range that holds the place is narrowed by counts of its parts, which are added up map-side, until few enough rows are left to be sorted.
    """
    v = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    first = int(at)
    below, inside = 0, n
    while inside > QUANTILE_ROWS and lo < hi:
        step = (hi - lo) / QUANTILE_PARTS
        part = F.least(F.lit(QUANTILE_PARTS - 1), F.floor((F.col("v") - lo) / step)).cast("int")
        seen = below
        # The place and the one after it may lie in different parts; the range kept reaches from the one to the other.
        kept: list[tuple[float, float, int]] = []
        for _, k, a, b in sorted(tuple(r) for r in v.where(F.col("v").between(lo, hi)).groupBy(part.alias("p")).agg(F.count("*"), F.min("v"), F.max("v")).collect()):
            if seen + k > first and seen <= first + 1 and seen < n:
                if not kept:
                    below = seen
                kept.append((a, b, k))
            seen += k
        left = sum(k for _, _, k in kept)
        lo, hi = kept[0][0], kept[-1][1]
        if left == inside:
            break
        inside = left
    rows = v.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("k")).orderBy("v").collect()
    found = []
    for place in (first, min(first + 1, n - 1)):
        seen = below
        for r in rows:
            seen += r["k"]
            if seen > place:
                found.append(r["v"])
                break
    return found[0] + (found[1] - found[0]) * (at - first)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_of_distance(d: Column) -> Column:
    """Cosine of unit vectors from their distance, between -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d * d / 2))


def semantic_score(d: Column) -> Column:
    """A distance as a score from 0 to 1."""
    return (1 + cosine_of_distance(d)) / 2


def nearest(vectors: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``distance`` to a query vector given as a literal; top-k is ``orderBy(distance, key).limit(k)``, which Spark takes per task."""
    return vectors.withColumn("distance", l2(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def minmax(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``value`` scaled to 0..1 within each group; 1 where all values are equal."""
    stats = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    j = df.join(stats, list(by)) if by else df.withColumns({"__lo": stats.select("__lo").scalar(), "__hi": stats.select("__hi").scalar()})
    return j.withColumn(out, F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def robust_stats(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """One row: median, mad, and the noise floor, the median of the weaker half and k scaled deviations; nulls if there are no values."""
    med = quantile(df, F.col(value), 0.5)
    mad = None if med is None else quantile(df, F.abs(F.col(value) - med), 0.5)
    weak = None if med is None else quantile(df, F.when(F.col(value) <= med, F.col(value)), 0.5)
    return df.sparkSession.createDataFrame([(med, mad, None if med is None else weak + k * 1.4826 * mad)], "median double, mad double, noise_floor double")


def reciprocal_rank_fusion(channels: Mapping[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """``uid, score``: the channels (uid, score) fused by rank with weights; 1 is first in every channel that has rows.

    Ranks are by score, then uid, both descending. A channel without rows takes no part in the scale.
    """
    parts = None
    for name, (df, w) in channels.items():
        each = ranked(df, [F.desc("score"), F.desc("uid")], "r").select("uid", F.lit(name).alias("channel"), (F.lit(float(w)) / (k + F.col("r"))).alias("s"), F.lit(float(w) / (k + 1)).alias("top"))
        parts = each if parts is None else parts.unionByName(each)
    scale = parts.groupBy("channel").agg(F.max("top").alias("top")).agg(F.sum("top").alias("scale"))
    return parts.groupBy("uid").agg(F.sum("s").alias("s")).select("uid", (F.col("s") / scale.scalar()).alias("score"))


def bm25(docs: DataFrame, doc: str, fields: Sequence[tuple[Column, float]], terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc, score`` of the documents that hold a query term; ``fields``: arrays of tokens, with the weight that a token of each has.

    One row for each document. Lengths are sizes of arrays, counted where the tokens are, and only tokens that are asked for leave the row:
    nothing of the corpus is exploded or joined. Documents without tokens take no part in the mean length.
    """
    length = sum((w * F.coalesce(F.size(F.coalesce(f, F.array().cast("array<string>"))), F.lit(0)) for f, w in fields[1:]), fields[0][1] * F.size(F.coalesce(fields[0][0], F.array().cast("array<string>"))))
    wanted = F.array(*map(F.lit, sorted(set(terms))))
    held = [F.transform(F.filter(F.coalesce(f, F.array().cast("array<string>")), lambda t: F.array_contains(wanted, t)), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))) for f, w in fields]  # noqa: B023
    d = docs.select(F.col(doc).alias("doc"), length.cast("double").alias("dl"), (F.concat(*held) if len(held) > 1 else held[0]).alias("hits"))
    n, avg = d.where("dl > 0").agg(F.count("*"), F.avg("dl")).first()
    if not n:
        return d.select("doc", F.lit(0.0).alias("score")).where("false")
    hit = d.select("doc", "dl", F.explode("hits").alias("h")).groupBy("doc", "dl", "h.term").agg(F.sum("h.w").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    return hit.join(df, "term").groupBy("doc").agg(F.sum(part).alias("score"))


def blend(df: DataFrame, base: str, similarity: str, out: str, alpha: float = 0.4) -> DataFrame:
    """Calibrated blend: (1 - alpha) minmax(base) + alpha clip((similarity - floor) / (p95 - floor)).

    The floor is the noise floor with k = 1; p95 is the exact percentile. If p95 does not exceed the floor the second part is 0.
    """
    floor, p95 = robust_stats(df, similarity, 1.0).first()["noise_floor"], quantile(df, F.col(similarity), 0.95)
    d = minmax(df, base, "__b")
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(similarity) - floor) / (p95 - floor))) if p95 is not None and p95 > floor else F.lit(0.0)
    return d.withColumn(out, (1 - alpha) * F.col("__b") + alpha * sim).drop("__b")


def structural_score(contracts: Column, kinds: Column, want_contracts: Column, want_kinds: Column, kind_weight: float = 0.6) -> Column:
    """Share of a role's evidence that a row has: contracts weigh 1, kinds ``kind_weight``."""
    hit = F.size(F.array_intersect(contracts, want_contracts)) + kind_weight * F.size(F.array_intersect(kinds, want_kinds))
    return hit / F.nullif(F.size(want_contracts) + kind_weight * F.size(want_kinds), F.lit(0.0))


def proximity_boost(a: Column, b: Column, same: float = 0.15, sibling: float = 0.05) -> Column:
    """Boost for a file in the same folder, or in a folder beside it."""
    parent = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    return F.when(parent(a) == parent(b), same).when((parent(a) != "") & (parent(parent(a)) == parent(parent(b))), sibling).otherwise(0.0)


def rank_auc(df: DataFrame, score: str, gold: Column) -> DataFrame:
    """``auc``: the chance that a gold row outscores another, ties half, by rank sums: no pairs are formed."""
    by = df.groupBy(score).agg(F.sum(gold.cast("long")).alias("g"), F.sum((~gold).cast("long")).alias("o"))
    d = running_sum(by, [F.col(score)], F.col("o"), "below")
    return d.withColumn("w", F.col("g") * (F.col("below") + F.col("o") / 2)).agg((F.sum("w") / F.nullif(F.sum("g") * F.sum("o"), F.lit(0))).alias("auc"))
