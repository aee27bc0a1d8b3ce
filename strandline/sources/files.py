"""Source files of a project as tables: a filtered tree, generated output left out, documents, and packs of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never looked into, and endings of source files.
PRUNED = ".git .hg .svn node_modules __pycache__ .venv venv dist build .mypy_cache .pytest_cache .tox site-packages".split()
EXTENSIONS = "py js jsx ts tsx".split()
#: A line of more characters than this, in a file of any length, is that of a machine.
LONGEST_LINE = 5_000


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``; schemes in either are left out."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") if ":/" in root else "/" + root.strip("/")
    return F.substring(bare, len(base) + 2, 1 << 20)


def file_tree(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, ignore: Sequence[str] = (), content: bool = False) -> DataFrame:
    """``path, size, modified`` (and ``content``) of the files below ``root`` with one of ``extensions``, outside folders that are pruned.

    ``ignore`` holds patterns as of an ignore file: a name or a path with ``*`` and ``?``, a trailing slash for folders, ``!`` to take back, the last
    that fits counts; with a slash inside a pattern is of the whole path. Paths are relative to ``root``. Without ``content`` no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cols = [relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    f = files.select(*cols)
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    f = f.where(~F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED)))) if PRUNED else f
    if extensions:
        f = f.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    ignored = F.lit(False)
    for p in ignore:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, body = p.startswith("!"), p.lstrip("!")
        hit = F.col("path").rlike(pattern(body))
        ignored = F.when(hit, not back).otherwise(ignored)
    return f.where(~ignored)


def pattern(p: str) -> str:
    """An ignore pattern as a regular expression over relative paths."""
    folder, whole = p.endswith("/"), "/" in p.strip("/") or p.startswith("/")
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_" else "\\" + c) for c in p.strip("/").replace("**", "\0")).replace("\\\0", ".*").replace("\0", ".*")
    return ("^" if whole else "(^|/)") + body + ("/" if folder else "(/|$)")


def is_generated(text: Column, path: Column) -> Column:
    """Whether a script is the output of a tool: a line of machine length, or a source map at its end. Other files never are; null is not."""
    script = F.lower(path).rlike(r"\.(m?js|cjs|jsx|ts|tsx)$")
    longest = F.array_max(F.transform(F.split(text, "\n"), F.length)) > LONGEST_LINE
    return F.coalesce(script & (longest | text.rlike(r"(?s)//[#@]\s*sourceMappingURL=[^\n]*\s*$")), F.lit(False))


def committed(files: DataFrame, tracked: DataFrame, dirty: DataFrame) -> DataFrame:
    """The rows of ``files`` (path) that are tracked and equal to the last commit: a semi-join and an anti-join on path."""
    return files.join(tracked.select("path"), "path", "left_semi").join(dirty.select("path"), "path", "left_anti")


def documents(spark: SparkSession, root: str, ending: str = "md") -> DataFrame:
    """``path, text``: the whole text of every file with the ending below ``root``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").text(root, wholetext=True)
    return read.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))


def pack(spark: SparkSession, path: str) -> DataFrame:
    """A pack of questions from Parquet or JSON lines, by the ending of the path; rows of packs that it includes (column ``include``, a path) follow, once."""
    read = lambda p: spark.read.parquet(p) if p.rstrip("/").endswith("parquet") else spark.read.json(p)
    seen, todo, out = set(), [path], None
    while todo:
        p = todo.pop(0)
        if p in seen:
            continue
        seen.add(p)
        df = read(p)
        if "include" in df.columns:
            # A pack names the packs it includes, which are few.
            todo += [r["include"] for r in df.where("include is not null").select("include").distinct().orderBy("include").collect()]
            df = df.where("include is null").drop("include")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def polled(spark: SparkSession, root: str, schema: str, form: str = "json", files_a_tick: int = 100) -> DataFrame:
    """A stream of the rows of new files below ``root``: each tick reads what has arrived since the last, at most ``files_a_tick`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_tick).format(form).load(root)
