"""A queue of work as tables: arrivals of one key are one item, a full queue rejects, and what has been quiet for a while leaves in batches.

Nothing is ordered as a whole: a limit decides who is admitted and who leaves, and what follows is joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that may wait, milliseconds of quiet, items of a batch, and the kind whose jobs run alone.
CAP, QUIET_MS, BATCH, PROJECT = 500, 500, 50, "project"
KEY = ["workspace", "kind", "target"]
ITEM = "workspace string, kind string, target string, enqueued_at bigint, updated_at bigint, generation bigint"


def admit(pending: DataFrame, arrivals: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The queue after some arrivals, and what became of each: ``queued``, ``coalesced`` or ``queue_full``.

    ``pending``: the columns of ``ITEM``; ``arrivals``: the key, at (milliseconds) and id, which tells them apart. An arrival of a key that waits moves its updated_at
    and counts its generation up, whatever the cap. New keys are admitted in order of their first arrival while fewer than ``cap`` wait; the others are rejected,
    each arrival of theirs. Null parts of a key are values.
    """
    a = arrivals.select("id", "at", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY])
    q = pending.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY], "enqueued_at", "updated_at", "generation")
    new = a.join(q, KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("at", "id")).alias("first"))
    room = max(0, cap - q.count())
    admitted = new.orderBy("first.at", "first.id", *KEY).limit(room).select(*KEY, F.col("first.id").alias("first_id"))
    known = admitted.unionByName(q.select(*KEY, F.lit(None).cast(arrivals.schema["id"].dataType).alias("first_id")))
    seen = a.join(known.withColumn("in", F.lit(True)), KEY, "left")
    outcome = F.when(F.col("in").isNull(), "queue_full").when(F.col("id").eqNullSafe(F.col("first_id")), "queued").otherwise("coalesced")
    came = seen.where(F.col("in")).groupBy(*KEY).agg(F.min("at").alias("enqueued_at"), F.max("at").alias("updated_at"), F.count("*").alias("generation"))
    both = q.unionByName(came).groupBy(*KEY).agg(F.min("enqueued_at").alias("enqueued_at"), F.max("updated_at").alias("updated_at"), F.sum("generation").alias("generation"))
    return both, seen.select("id", *KEY, outcome.alias("outcome"))


def next_batch(pending: DataFrame, now: int, quiet_ms: int = QUIET_MS, size: int = BATCH, force: bool = False) -> DataFrame:
    """The items that leave next: of those quiet for ``quiet_ms`` (of all, with ``force``) the first project's job alone, or the first ``size`` others, by updated_at and target."""
    ready = pending if force else pending.where(F.col("updated_at") + quiet_ms <= now)
    order = ["updated_at", "target", "workspace", "kind"]
    alone = ready.where(F.col("kind") == PROJECT).orderBy(*order).limit(1)
    return ready.orderBy(*order).limit(size) if alone.isEmpty() else alone


def taken(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """The queue without a batch that has left; items that a save has touched since are the same items no more and stay."""
    return pending.join(batch.select(*KEY, "generation"), [*KEY, "generation"], "left_anti")
