"""One ranking from several scores of different scales: ideal-point ranking on winsorised, vector-normalised scores.

Within a group, each score is clipped to three robust deviations around its median (so an extreme value counts no more than a
good one), centred and divided by its vector norm (so every score spreads the same whatever its unit), and each item gets its
root-mean-square distances to the best and to the worst value of every score. The rank key is the relative closeness
worst / (worst + best), between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

#: Median absolute deviation of a normal distribution, to its standard deviation; and the mean absolute deviation's factor.
MAD_TO_SD, MEAN_AD_TO_SD = 1.4826, 1.2533
ACCURACY = 10_000
#: Rows of a group that may meet in one task; larger groups are salted, one salt for as many rows.
HOT_ROWS = 100_000


def finite(c: Column) -> Column:
    """The value as double, null where it is not a finite number."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def hot_groups(items: DataFrame, group: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``__g, __n``: the groups of more than ``hot_rows`` rows with the number of salts they get; None if there are none.

    One count over one column, added up before it is shuffled; the result is written, and most often empty.
    """
    checkpoint_dir(items.sparkSession)
    counts = items.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("c"))
    hot = counts.where(F.col("c") > hot_rows).select("__g", F.ceil(F.col("c") / hot_rows).cast("int").alias("__n")).checkpoint()
    return None if hot.isEmpty() else hot


def closeness(items: DataFrame, group: str, key: str, scores: Mapping[str, Column], weights: Mapping[str, float] | None = None, deviations: float = 3.0, hot: DataFrame | None = None) -> DataFrame:
    """``group, key, closeness``: one row per item; higher is better.

    ``scores`` names columns of ``items``; ``weights`` default to 1 each. Repeated items count once (of differing values the greatest).
    Missing and non-finite scores take no part in an item's distances; an item without any score, or a group in which nothing differs,
    gets 0.5. Rows with null group or key are left out. Medians are exact up to 10,000 distinct values and within 1/10,000 of the rank beyond.

    The rows are shuffled once, by group, and all statistics are windows there. The groups of ``hot`` (from hot_groups()) are spread by salts instead;
    their statistics are pre-aggregated and come back as one row a salt. Both ways give the same.
    """
    names = list(scores)
    weights = {n: 1.0 for n in names} | dict(weights or {})
    rows = items.select(F.col(group).alias("__g"), F.col(key).alias("__k"), *[finite(scores[n]).alias(f"__x{i}") for i, n in enumerate(names)])
    rows = rows.where(F.col("__g").isNotNull() & F.col("__k").isNotNull())
    w = [float(weights[n]) for n in names]
    if hot is None:
        out = _close(rows, w, deviations, salted=False)
    else:
        few, many = rows.join(hot, "__g", "left_anti"), rows.join(hot, "__g")
        out = _close(few, w, deviations, salted=False).unionByName(_close(many, w, deviations, salted=True))
    return out.select(F.col("__g").alias(group), F.col("__k").alias(key), "closeness")


def _close(rows: DataFrame, weights: list[float], deviations: float, salted: bool) -> DataFrame:
    """``__g, __k, closeness`` of ``__g, __k, __x0...``, and ``__n`` where the groups are salted."""
    x = [f"__x{i}" for i in range(len(weights))]
    at = ["__g"]
    if salted:
        at = ["__g", "__n", "__s"]
        rows = rows.withColumn("__s", F.pmod(F.xxhash64("__k"), F.col("__n")).cast("int"))
    # By group alone: dropping repeated items and all windows need no other order of the rows.
    rows = rows.repartition("__g", *at[2:]).groupBy(*at, "__k").agg(*[F.max(c).alias(c) for c in x])

    def with_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
        """``df`` with statistics over its groups."""
        if not salted:
            return df.withColumns({k: c.over(W.partitionBy("__g")) for k, c in stats.items()})
        one = df.groupBy("__g", "__n").agg(*[c.alias(k) for k, c in stats.items()])
        # A merge join: the rows lie by group and salt already.
        return df.join(one.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).hint("merge"), at)

    each = range(len(x))
    half = lambda c: F.percentile_approx(c, 0.5, ACCURACY)
    rows = with_stats(rows, {f"__m{i}": half(x[i]) for i in each})
    rows = rows.withColumns({f"__e{i}": F.abs(F.col(x[i]) - F.col(f"__m{i}")) for i in each})
    rows = with_stats(rows, {f"__d{i}": half(f"__e{i}") for i in each} | {f"__a{i}": F.avg(f"__e{i}") for i in each})
    clipped = {}
    for i in each:
        reach = deviations * F.when(F.col(f"__d{i}") > 0, MAD_TO_SD * F.col(f"__d{i}")).otherwise(MEAN_AD_TO_SD * F.col(f"__a{i}"))
        mid = F.col(f"__m{i}")
        clipped[x[i]] = F.when(F.col(x[i]).isNotNull(), F.least(F.greatest(F.col(x[i]), mid - reach), mid + reach))
    rows = rows.select(*at, "__k", *[c.alias(k) for k, c in clipped.items()])
    rows = with_stats(rows, {f"__{k}{i}": f(x[i]) for i in each for k, f in (("hi", F.max), ("lo", F.min), ("v", F.var_pop), ("c", F.count))})
    best, worst, total = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in each:
        norm2 = F.col(f"__v{i}") * F.col(f"__c{i}")
        here = F.col(x[i]).isNotNull()
        w = F.lit(weights[i])
        part = lambda edge: F.when(here & (norm2 > 0), w * F.pow(F.col(x[i]) - F.col(edge), 2) / norm2).otherwise(0.0)  # noqa: B023, E731
        best, worst, total = best + part(f"__hi{i}"), worst + part(f"__lo{i}"), total + F.when(here, w).otherwise(0.0)
    rows = rows.select("__g", "__k", F.sqrt(best / F.nullif(total, F.lit(0.0))).alias("__b"), F.sqrt(worst / F.nullif(total, F.lit(0.0))).alias("__w"))
    return rows.select("__g", "__k", F.coalesce(F.col("__w") / F.nullif(F.col("__b") + F.col("__w"), F.lit(0.0)), F.lit(0.5)).alias("closeness"))


def top(ranked: DataFrame, limits: DataFrame, group: str, key: str, limit: str, hot: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` items of each group: ``group, key, closeness, rank``, rank from 1; ties go to the lesser key.

    ``limits`` has the limit of each group; of repeated rows the greatest counts, groups without one or with null give nothing. Each salt
    of a group in ``hot`` (from hot_groups()) first keeps its own best, so that what meets in one task is at most salts x limit rows.
    """
    lim = limits.where(F.col(group).isNotNull() & F.col(limit).isNotNull()).groupBy(group).agg(F.max(limit).alias("__limit"))
    order = [F.desc("closeness"), F.asc(key)]
    rows = ranked.join(lim, group)
    if hot is not None:
        salts = hot.withColumnRenamed("__g", group)
        salted = rows.join(salts, group).withColumn("__s", F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))
        best = salted.withColumn("rank", F.row_number().over(W.partitionBy(group, "__s").orderBy(*order))).where(F.col("rank") <= F.col("__limit"))
        rows = rows.join(salts, group, "left_anti").unionByName(best.drop("__n", "__s", "rank"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= F.col("__limit")).select(group, key, "closeness", "rank")
