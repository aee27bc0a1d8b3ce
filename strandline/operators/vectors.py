"""Joins of vectors with vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import top_by

#: Vectors in a block, about; two blocks are compared at a time.
BLOCK_ROWS = 2_048


def nearest_within(df: DataFrame, id_col: str, vector: str, k: int, threshold: float, asked: Column | None = None) -> DataFrame:
    """``id, neighbour, distance``: of every vector, or of those ``asked`` for, the ``k`` others nearest by L2 at most ``threshold`` away, exactly; ties by id.

    All rows are compared with all, in pairs of blocks of bounded size; a pair of blocks sends on its best for each row, never its vectors.
    Rows without an id or a vector are left out; ids are distinct and vectors of one size.
    """
    v = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-v.count() // BLOCK_ROWS))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = v if asked is None else v.join(df.where(asked).select(F.col(id_col).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    left = left.withColumn("c", other)
    # New names: both sides come from the same rows.
    right = v.select(F.col("id").alias("rid"), F.col("v").alias("rv"), other.alias("rb"), F.col("b").alias("rc"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(b):
            b = b.sort_values("rid")
            x, y = np.stack(a["v"].to_numpy()), np.stack(b["rv"].to_numpy())
            ids = b["rid"].to_numpy()
            for i, q in zip(a["id"], x, strict=True):
                d = np.sqrt(((y - q) ** 2).sum(1))
                at = np.flatnonzero((d <= threshold) & (ids != i))
                at = at[np.argsort(d[at].round(9), kind="stable")[:k]]
                parts.append((np.full(len(at), i), ids[at], d[at]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "neighbour", "distance"), zip(*parts, strict=True), strict=True)})

    found = left.groupBy("b", "c").cogroup(right.groupBy("rb", "rc")).applyInPandas(near, "id long, neighbour long, distance double")
    return top_by(found, ["id"], [F.round("distance", 9), F.col("neighbour")], k).select(F.col("id").alias(id_col), "neighbour", F.round("distance", 6).alias("distance"))
