"""The job log as a state machine: running, completed, failed, and dead_letter after too many failures in a row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MAX_ATTEMPTS = 3


def states(jobs: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """``target, state, failures``: the state of each target after all rows of ``jobs`` (target, id, status), in order of id.

    failures counts those since the last completion; from ``most`` on a failed target is a dead letter until it completes. Statuses are read without
    case and blanks; unknown and null ones change nothing. A target is two aggregates over its rows (last completion, then counts after it), no window.
    """
    j = jobs.where("target is not null").select("target", "id", F.lower(F.trim("status")).alias("s"))
    last = j.where("s = 'completed'").groupBy("target").agg(F.max("id").alias("done"))
    j = j.join(last, "target", "left")
    after = F.col("done").isNull() | (F.col("id") > F.col("done"))
    g = j.groupBy("target").agg(
        F.countDistinct(F.when(after & F.col("s").isin("failed", "dead_letter"), F.col("id"))).alias("failures"),
        F.max(F.when(F.col("s").isin("running", "completed", "failed", "dead_letter"), F.struct("id", "s")))["s"].alias("s"),
    )
    return g.select("target", F.when((F.col("failures") >= most) & (F.col("s") != "completed"), "dead_letter").when(F.col("s") == "dead_letter", "failed").otherwise(F.col("s")).alias("state"), "failures")


def state_stream(jobs: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The same on a stream: each batch of rows of a target advances its state, which is emitted; a stream read to its end gives what states() gives.

    Rows come in any order and more than once, also over batches. The state of a target is the id of its last completion, the ids of the failures
    after it (a completion clears those before it) and the greatest (id, status). It is kept for as long as the stream runs: a target has one row of state,
    and its next row, however late, counts on from there.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failed, at, current = state.get if state.exists else (None, [], None, None)
        rows = pd.concat(list(batches)).drop_duplicates(["id", "s"])
        ends = rows.loc[rows["s"] == "completed", "id"]
        if len(ends):
            done = int(ends.max()) if done is None else max(done, int(ends.max()))
        new = rows.loc[rows["s"].isin(["failed", "dead_letter"]), "id"]
        failed = sorted({i for i in [*failed, *map(int, new)] if done is None or i > done})
        known = rows[rows["s"].isin(["running", "completed", "failed", "dead_letter"])]
        for i, s in zip(known["id"], known["s"], strict=True):
            if at is None or (int(i), s) > (at, current):
                at, current = int(i), s
        state.update((done, failed, at, current))
        now = "dead_letter" if len(failed) >= most and current != "completed" else "failed" if current == "dead_letter" else current
        yield pd.DataFrame({"target": [key[0]], "state": [now], "failures": [len(failed)]})

    j = jobs.where("target is not null").select("target", "id", F.lower(F.trim("status")).alias("s"))
    return j.groupBy("target").applyInPandasWithState(advance, "target string, state string, failures int", "done bigint, failed array<bigint>, at bigint, current string", "update", GroupStateTimeout.NoTimeout)


def evict(entries: DataFrame, owner: str, updated: str, key: str, cap: int, oldest: int) -> DataFrame:
    """Entries not older than ``oldest`` and, of each owner, the ``cap`` updated last; Spark keeps ``cap`` rows an owner before the shuffle."""
    w = W.partitionBy(owner).orderBy(F.desc(updated), F.desc(key))
    return entries.where(F.col(updated) >= oldest).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")
