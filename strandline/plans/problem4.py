"""Query and SQL of the incremental-processing problem."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from ..sources.incremental import replay_batches
from ..sources.tables import load


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets each succeeded run had to process, from the batches that were written and committed for the runs.

    The batches of a table lie in a folder of their own below the shared one of the session, which a second call overwrites.
    """
    folder = f"{checkpoint_dir(spark)}/batches-{spark.sparkContext.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
    return replay_batches(load(spark, sf_dir, "index_jobs"), load(spark, sf_dir, "index_runs"), folder).select("run_id", "target")


QUERIES = {"p4_found": p4_found}

ORACLES = {
    "p4_found": r"""
WITH ok AS (SELECT run_id, max(cutoff_at) AS cutoff_at, max(started_at) AS started_at FROM index_runs WHERE lower(trim(status)) = 'succeeded' GROUP BY run_id),
r AS (SELECT run_id, cutoff_at, row_number() OVER (ORDER BY cutoff_at, started_at, run_id) AS n FROM ok),
f AS (SELECT DISTINCT id, target, target_hash, landed_at, CASE WHEN abs(updated_at) >= 100000000000 THEN updated_at ELSE updated_at * 1000 END AS at
      FROM index_jobs WHERE lower(trim(status)) = 'completed' AND updated_at IS NOT NULL AND length(trim(target_hash)) > 0),
s AS (SELECT r.n, r.run_id, f.target, arg_max(f.target_hash, {'at': f.at, 'id': f.id, 'h': f.target_hash}) AS h
      FROM r JOIN f ON f.landed_at <= r.cutoff_at GROUP BY r.n, r.run_id, f.target)
SELECT a.run_id, a.target FROM s a LEFT JOIN s b ON b.n = a.n - 1 AND b.target IS NOT DISTINCT FROM a.target
WHERE b.n IS NULL OR b.h IS DISTINCT FROM a.h
""",
}
