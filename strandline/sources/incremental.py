"""Processing only what is new or changed since the last successful run.

A *listing* names the inputs a run can see, each with a checksum; a *manifest* names those a committed run has processed.
What is pending is the anti-join of the listing against the manifest. A batch is written under its own identifier, replacing
whatever an earlier try left there, and only then is its manifest committed, so that a crash at any point leads to the
same batch again: nothing is skipped and nothing repeated.

``Batches`` is the protocol of writing and committing. ``IncrementalInput`` uses it for files. ``replay`` says what each run of a log had to
process of a change feed, all runs at once, and ``replay_batches`` writes and commits each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir

MANIFEST_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("size", T.LongType()), ("modified", T.LongType()), ("checksum", T.StringType()), ("todo", T.BooleanType()))])
#: Files above this are not read into one row to be hashed; their size and time stand for the checksum.
HASHED_BYTES = 1 << 30
#: Committed manifests from which a snapshot of all of them is written.
SNAPSHOT_EVERY = 50
#: Times that a batch is made anew because its files changed while they were processed.
TRIES = 3


def pending(listing: DataFrame, manifest: DataFrame, keys: Sequence[str], checksum: Sequence[str]) -> DataFrame:
    """Rows of ``listing`` that ``manifest`` does not hold with the same checksum.

    Nulls compare as values: a null key or checksum matches a null one. An empty manifest leaves the whole listing.
    Repeated rows of the manifest change nothing; repeated rows of the listing stay (deduplicate before).
    """
    m = manifest.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate([*keys, *checksum])])
    cond = F.lit(True)
    for i, c in enumerate([*keys, *checksum]):
        cond = cond & listing[c].eqNullSafe(m[f"__m{i}"])
    return listing.join(m, cond, "left_anti")


class Batches:
    """Batches below a folder: ``out/batch_id=B`` holds results, ``state/batch=B`` the manifest, whose existence commits the batch.

    The manifest is staged beside it and renamed. A result without a manifest is the rest of a failed run, which readers never see and the
    next try of the batch overwrites.
    """

    def __init__(self, spark: SparkSession, state_dir: str, out_dir: str):
        self.spark, self.state_dir, self.out_dir = spark, state_dir, out_dir
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(state_dir).getFileSystem(spark._jsc.hadoopConfiguration())

    def _named(self, prefix: str) -> list[str]:
        root = self._path(self.state_dir)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def committed(self) -> list[str]:
        """Identifiers of the committed batches, in order of their names."""
        return self._named("batch=")

    def stage(self, batch: str, manifest: DataFrame) -> DataFrame:
        """The manifest written, and read back: what is processed is what was written, however often it is looked at."""
        path = f"{self.state_dir}/_staged-{batch}"
        manifest.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(manifest.schema).parquet(path)

    def commit(self, batch: str, staged: str | None = None) -> None:
        if not self._fs.rename(self._path(f"{self.state_dir}/_staged-{staged or batch}"), self._path(f"{self.state_dir}/batch={batch}")):
            raise OSError(f"manifest of batch {batch} was not committed")

    def output(self, schema: T.StructType | None = None) -> DataFrame | None:
        """The results of the committed batches only."""
        done = self.committed()
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.out_dir}/batch_id={b}" for b in done]) if done else None


class IncrementalInput(Batches):
    """Incremental processing of the files below a folder."""

    def __init__(self, spark: SparkSession, input_dir: str, state_dir: str, out_dir: str, pattern: str = "*"):
        super().__init__(spark, state_dir, out_dir)
        self.input_dir, self.pattern = input_dir, pattern

    def _files(self, paths: Sequence[str] | None = None) -> DataFrame:
        reader = self.spark.read.format("binaryFile")
        if paths is not None:
            return reader.load([p.replace("[", r"\[").replace("{", r"\{").replace("*", r"\*").replace("?", r"\?") for p in paths])
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern).load(self.input_dir)

    def listing(self) -> DataFrame:
        """Every input file with its size and time; no file is opened for it."""
        return self._files().select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))

    def manifest(self) -> DataFrame:
        """The newest version processed of each path: from the last snapshot and the batches after it."""
        snap = self._named("snapshot=")
        last = snap[-1] if snap else ""
        parts = [self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.state_dir}/batch={b}").withColumn("batch", F.lit(b)) for b in self.committed() if b > last]
        if snap:
            parts.insert(0, self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.state_dir}/snapshot={last}").withColumn("batch", F.lit(last)))
        if not parts:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        names = [f.name for f in MANIFEST_SCHEMA]
        return every.groupBy("path").agg(F.max(F.struct("batch", *[n for n in names if n != "path"])).alias("m")).select("path", *[f"m.{n}" for n in names if n != "path"])

    def _digest(self, rows: DataFrame) -> tuple[int, str]:
        d = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "size", "checksum").cast("decimal(38,0)")).alias("h")).first()
        return d["n"], hashlib.sha256(str(d["h"]).encode()).hexdigest()[:12]

    def run(self, process: Callable[[DataFrame], DataFrame], batch_id: str | None = None) -> str | None:
        """Process what is pending and commit; the batch's identifier, or None if there was nothing to do.

        ``process`` gets a DataFrame of pending files (path, size, checksum). Only files whose size or time is not that of the manifest are
        opened and hashed, and of these only those with another checksum are pending. The manifest is staged and read back before anything is
        processed, so that hashing, processing and committing see the same rows. A file that is overwritten meanwhile makes the batch start
        anew; if one is overwritten after that, its new time sets it apart from the manifest, and the next run takes it.

        The identifier is the number of batches committed so far and a digest of what is pending: a retry of a failed run gets the same one.
        """
        for _ in range(TRIES):
            known = self.manifest()
            suspects = pending(self.listing(), known, ["path"], ["size", "modified"])
            # The list of files is on the driver already: Spark has read the folder there.
            paths = [r["path"] for r in suspects.select("path").collect()]
            if not paths:
                return None
            small = F.col("size") <= HASHED_BYTES
            meta = F.concat_ws(":", F.lit("unread"), F.col("size"), F.col("modified"))
            files = self._files(paths).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), "content")
            # Two scans: a filter on the length keeps the contents of large files from being read.
            hashed = files.where(small).withColumn("checksum", F.sha2("content", 256)).drop("content").unionByName(files.drop("content").where(~small).withColumn("checksum", meta))
            fresh = pending(hashed, known, ["path"], ["size", "checksum"]).select("path", F.lit(True).alias("todo"))
            rows = hashed.join(fresh, "path", "left").select("path", "size", "modified", "checksum", F.coalesce("todo", F.lit(False)).alias("todo"))
            staged = self.stage("next", rows)
            todo = staged.where("todo").select("path", "size", "checksum")
            n, digest = self._digest(todo)
            batch = batch_id or f"{len(self.committed()):08d}-{digest}"
            if batch in self.committed():
                return batch
            process(todo).write.mode("overwrite").parquet(f"{self.out_dir}/batch_id={batch}")
            if self._changed(staged):
                continue
            self.commit(batch, "next")
            self._snapshot()
            return batch if n else None
        raise OSError(f"input files changed while they were processed, {TRIES} times")

    def _changed(self, staged: DataFrame) -> bool:
        """Whether a file of the staged manifest is no longer what it was when it was hashed."""
        self.spark.catalog.refreshByPath(self.input_dir)
        return not pending(staged, self.listing(), ["path"], ["size", "modified"]).isEmpty()

    def _snapshot(self) -> None:
        """All manifests in one, now and then, so that reading them does not grow with the number of runs for ever."""
        done, snap = self.committed(), self._named("snapshot=")
        if len([b for b in done if not snap or b > snap[-1]]) >= SNAPSHOT_EVERY:
            self.stage("snapshot", self.manifest().repartition(1 + len(done) // 10_000, "path"))
            if not self._fs.rename(self._path(f"{self.state_dir}/_staged-snapshot"), self._path(f"{self.state_dir}/snapshot={done[-1]}")):
                raise OSError("snapshot of the manifests was not written")


def in_millis(c: Column) -> Column:
    """Epoch seconds or milliseconds, as milliseconds; values from 10^11 on are milliseconds already."""
    return F.when(F.abs(c) >= 100_000_000_000, c).otherwise(c * 1000)


def clean_status(c: Column) -> Column:
    """A status without case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def succeeded(runs: DataFrame) -> DataFrame:
    """``__run, run_id, cutoff_at``: the succeeded runs of a log in order of their cutoffs, numbered from 0."""
    ok = (
        runs.where(clean_status(F.col("status")) == "succeeded").where(F.col("cutoff_at").isNotNull())
        .groupBy("run_id").agg(F.max("cutoff_at").alias("cutoff_at"), F.max("started_at").alias("started_at"))
    )
    # A log of runs has as many rows as there were runs, whatever they processed.
    return ok.withColumn("__run", F.row_number().over(W.orderBy("cutoff_at", "started_at", "run_id")) - 1).select("__run", "run_id", "cutoff_at")


def _day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def first_run(rows: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``__run``, the first of ``runs`` (from succeeded(), written) whose cutoff is not before ``at``; rows behind the last cutoff are left out.

    An as-of join by days: each day knows how many cutoffs lie before it and those within it, so that a row meets one day and compares with
    that day's cutoffs only.
    """
    span = runs.agg(F.min(_day(F.col("cutoff_at"))).alias("a"), F.max(_day(F.col("cutoff_at"))).alias("b"), F.max("cutoff_at").alias("last")).first()
    if span["a"] is None:
        return rows.withColumn("__run", F.lit(0)).where("false")
    own = runs.groupBy(_day(F.col("cutoff_at")).alias("__day")).agg(F.sort_array(F.collect_list("cutoff_at")).alias("__cutoffs"))
    days = rows.sparkSession.range(span["a"], span["b"] + 1).select(F.col("id").cast("int").alias("__day")).join(own, "__day", "left")
    before = F.coalesce(F.sum(F.coalesce(F.size("__cutoffs"), F.lit(0))).over(W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = _cut(days.select("__day", before.alias("__before"), F.coalesce("__cutoffs", F.array().cast(own.schema["__cutoffs"].dataType)).alias("__cutoffs")))
    met = rows.where(F.col(at) <= F.lit(span["last"])).withColumn("__day", F.greatest(F.lit(span["a"]), _day(F.col(at)))).join(days, "__day")
    return met.withColumn("__run", (F.col("__before") + F.size(F.filter("__cutoffs", lambda c: c < F.col(at)))).cast("int")).drop("__day", "__before", "__cutoffs")


def replay(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, target, checksum``: what each succeeded run had to process.

    ``feed``: id, target, target_hash, status, updated_at, landed_at; ``runs``: run_id, started_at, cutoff_at, status.
    A run lists, for each target, the hash of the completed row with the greatest (updated_at, id) that had landed by its
    cutoff. The manifest of the run before holds what that run saw. Pending is the listing without the manifest.

    Only rows that land between two cutoffs can change a target's listing, so a target is listed at the runs where
    something of it landed and the manifest is the listing of the last such run. Rows are reduced to one per target and run
    before anything is ordered: a hot target sends at most one row per run and map task. Failed, aborted and crashed
    runs have no manifest and are passed over; late rows belong to the first succeeded run whose cutoff is not before their landing.

    Null or blank hashes, null times, null targets' rows: rows with null target form one target (null); rows with null
    landed_at are never visible. Repeated rows count once. An empty feed or no succeeded run gives no rows.
    """
    order = _cut(succeeded(runs))
    rows = (
        feed.where((clean_status(F.col("status")) == "completed") & F.col("updated_at").isNotNull() & F.col("landed_at").isNotNull())
        .where(F.length(F.regexp_replace(F.col("target_hash"), r"(?U)\s", "")) > 0)
        .select("target", "target_hash", "landed_at", in_millis(F.col("updated_at")).alias("__at"), F.col("id").alias("__id"))
    )
    landed = first_run(rows, order, "landed_at").groupBy("target", "__run").agg(F.max(F.struct("__at", "__id", "target_hash")).alias("__top"))
    by_target = W.partitionBy("target").orderBy("__run")
    listing = (
        landed.withColumn("__top", F.max("__top").over(by_target.rowsBetween(W.unboundedPreceding, 0)))
        .select("target", "__run", F.col("__top.target_hash").alias("checksum"))
    )
    manifest = listing.select("target", F.lead("__run").over(by_target).alias("__run"), "checksum").where(F.col("__run").isNotNull())
    todo = pending(listing, manifest, ["target", "__run"], ["checksum"])
    return todo.join(order, "__run").select("run_id", "target", "checksum")


def replay_batches(feed: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """replay() by the protocol of Batches: each run's targets are a batch named by the run, written together below ``folder`` and committed one by one.

    A run's manifest has its targets' number and a sum of their checksums, read back from what was written. A second call with the same folder
    overwrites batches and manifests by those of the same names, and gives the same rows; rows of runs that were not committed are not given.
    """
    spark = feed.sparkSession
    b = Batches(spark, f"{folder}/state", f"{folder}/out")
    todo = replay(feed, runs)
    todo.withColumn("batch_id", F.col("run_id")).write.mode("overwrite").partitionBy("batch_id").parquet(b.out_dir)
    if b._fs.exists(b._path(b.state_dir)):
        b._fs.delete(b._path(b.state_dir), True)
    written = spark.read.schema(todo.schema).parquet(b.out_dir)
    sums = written.groupBy("run_id").agg(F.count("*").alias("targets"), F.sum(F.xxhash64("target", "checksum").cast("decimal(38,0)")).alias("checksum"))
    # One row a run; all manifests are staged in one job, each in its own folder, and renamed.
    sums.repartition(1).write.mode("overwrite").partitionBy("run_id").parquet(f"{b.state_dir}/_staged")
    staged = [s.getPath().getName() for s in b._fs.listStatus(b._path(f"{b.state_dir}/_staged")) if s.getPath().getName().startswith("run_id=")]
    for name in sorted(staged):
        if not b._fs.rename(b._path(f"{b.state_dir}/_staged/{name}"), b._path(f"{b.state_dir}/batch={name[7:]}")):
            raise OSError(f"manifest of run {name[7:]} was not committed")
    out = b.output(todo.schema)
    return todo.where("false") if out is None else out
