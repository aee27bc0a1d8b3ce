"""Tables that are written: keyed tables with upserts and deletes, logs that rotate, counters as text.

A keyed table is a folder of versions. A change reads the newest, writes the next beside it and renames it into place, so that a reader sees
one version or the other and a failed write leaves only a staged folder. Deletes and upserts are anti-joins and unions over whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import first_by

#: Rows of a batch, and the part of the table it must be, from which an upsert replaces the table outright.
BULK_ROWS, BULK_SHARE = 512, 0.85


#: Times in JSON keep their microseconds.
JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Folder:
    """A folder on the session's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the folder's entries, in order."""
        if not self._fs.exists(self._p(self.path)):
            return []
        return sorted(n[len(prefix) :] for n in (s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))) if n.startswith(prefix))

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._p(f"{self.path}/{a}"), self._p(f"{self.path}/{b}")):
            raise OSError(f"{self.path}/{b} was not written")

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(f"{self.path}/{name}"), True)


class KeyedTable(Folder):
    """A table with unique keys. ``keep`` versions stay, the newest being the table."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, keep: int = 2):
        super().__init__(spark, path)
        self.keys, self.schema, self.keep = list(keys), schema, keep

    def version(self) -> int:
        """The number of the newest version; 0 if nothing was written."""
        return max((int(v) for v in self.names("v=")), default=0)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v:012d}") if v else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> int:
        """The table's rows are ``rows``; the new version."""
        v = self.version() + 1
        cols = self.spark.createDataFrame([], self.schema).columns
        rows.select(*cols).write.mode("overwrite").parquet(f"{self.path}/_staged")
        self.rename("_staged", f"v={v:012d}")
        for old in self.names("v=")[: -self.keep]:
            self.delete(f"v={old}")
        return v

    def upsert(self, rows: DataFrame, order: Sequence[Column] = ()) -> str:
        """Rows replace those of equal keys (nulls are equal); of several rows of a key the first in ``order``. How it was done: bulk, if the batch is large and
        covers nearly the whole table and every key of it, or delta."""
        new = first_by(rows, self.keys, list(order) or [F.struct(*rows.columns)]) if order else rows.dropDuplicates(self.keys)
        n, old = new.count(), self.read()
        had = old.count()
        if n >= BULK_ROWS and n >= BULK_SHARE * max(1, had) and self._without(old, new).isEmpty():
            self.replace(new)
            return "bulk"
        self.replace(self._without(old, new).unionByName(new.select(*old.columns)))
        return "delta"

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        k = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(self.keys)]).distinct()
        cond = F.lit(True)
        for i, c in enumerate(self.keys):
            cond = cond & rows[c].eqNullSafe(k[f"__k{i}"])
        return rows.join(k, cond, "left_anti")

    def delete_keys(self, keys: DataFrame) -> int:
        return self.replace(self._without(self.read(), keys))

    def delete_where(self, condition: Column) -> int:
        """Rows for which the condition holds go; those for which it is null stay."""
        return self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))


class History:
    """Conversations and their messages; a conversation goes with its messages."""

    def __init__(self, spark: SparkSession, path: str, conversation: str, message: str):
        self.conversations = KeyedTable(spark, f"{path}/conversations", ["id"], conversation)
        self.messages = KeyedTable(spark, f"{path}/messages", ["id"], message)

    def delete(self, ids: DataFrame) -> None:
        """``ids``: id of conversations. Messages first, so that a crash between the two leaves a conversation without some messages, never the reverse."""
        old = self.messages.read()
        gone = ids.select(F.col("id").alias("conversation_id")).distinct()
        self.messages.replace(old.join(gone, "conversation_id", "left_anti"))
        self.conversations.delete_keys(ids)

    def prune(self, before: Column) -> None:
        """Conversations last updated before a time, and their messages."""
        self.delete(self.conversations.read().where(F.col("updated_at") < before).select("id"))


class JsonLog(Folder):
    """A log of JSON lines in parts of at most ``rows`` lines; parts beyond ``parts`` are removed, the oldest first."""

    def __init__(self, spark: SparkSession, path: str, schema: str, rows: int = 100_000, parts: int = 10):
        super().__init__(spark, path)
        self.schema, self.rows, self.parts = schema, rows, parts

    def append(self, events: DataFrame, at: str) -> None:
        """Events in order of ``at``, as new parts behind those there are. An append is one rename a part."""
        n = events.count()
        if not n:
            return
        first = max((int(p) for p in self.names("part=")), default=0) + 1
        count = -(-n // self.rows)
        ranges = events.repartitionByRange(count, at).sortWithinPartitions(at)
        ranges.withColumn("__part", F.spark_partition_id()).write.mode("overwrite").partitionBy("__part").options(**JSON).json(f"{self.path}/_staged")
        staged = Folder(self.spark, f"{self.path}/_staged")
        for i, name in enumerate(sorted(staged.names("__part="), key=int)):
            self.rename(f"_staged/__part={name}", f"part={first + i:012d}")
        for old in self.names("part=")[: -self.parts]:
            self.delete(f"part={old}")

    def read(self) -> DataFrame:
        names = self.names("part=")
        return self.spark.read.schema(self.schema).options(**JSON).json([f"{self.path}/part={p}" for p in names]) if names else self.spark.createDataFrame([], self.schema)

    def tail(self, n: int, at: str, where: Column | None = None) -> DataFrame:
        """The last ``n`` events in order of ``at``, of those for which ``where`` holds."""
        e = self.read()
        return (e if where is None else e.where(where)).orderBy(F.desc(at), *[F.desc(c) for c in e.columns if c != at]).limit(n)


class Manifest(Folder):
    """One JSON document, replaced as a whole."""

    def write(self, row: DataFrame) -> None:
        row.coalesce(1).write.mode("overwrite").options(**JSON).json(f"{self.path}/_staged")
        if self.names("manifest"):
            self.delete("manifest")
        self.rename("_staged", "manifest")

    def read(self, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).options(**JSON).json(f"{self.path}/manifest") if self.names("manifest") else None


def start_job(jobs: DataFrame, target: str, target_hash: str, at: int, most: int = 3) -> tuple[int, int]:
    """``id, attempts`` of the job for a target: the last failed one of the same hash is tried again while it has tries left, else a new one begins."""
    failed = jobs.where((F.col("target") == target) & (F.col("target_hash") == target_hash) & (F.lower(F.trim("status")) == "failed") & (F.col("attempts") < most))
    last = failed.orderBy(F.desc("updated_at"), F.desc("id")).select("id", "attempts").first()
    if last is not None:
        return last["id"], last["attempts"] + 1
    return (jobs.agg(F.max("id")).first()[0] or 0) + 1, 1


def metrics_text(counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """``line``: counters (name, labels, value) summed and gauges (name, labels, value, at) at their last value, in order of name and labels."""
    label = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ","), F.lit("}"))).otherwise("")
    c = counters.select("name", label("labels").alias("l"), "value").groupBy("name", "l").agg(F.sum("value").alias("value")).withColumn("type", F.lit("counter"))
    g = gauges.select("name", label("labels").alias("l"), "value", "at").groupBy("name", "l").agg(F.max(F.struct("at", "value"))["value"].alias("value")).withColumn("type", F.lit("gauge"))
    every = c.unionByName(g)
    head = every.groupBy("name").agg(F.min("type").alias("type")).select("name", F.lit("").alias("l"), F.lit(0).alias("o"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line"))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    rows = every.select("name", "l", F.lit(1).alias("o"), F.concat("name", "l", F.lit(" "), number).alias("line"))
    return head.unionByName(rows).orderBy("name", "o", "l").select("line")
