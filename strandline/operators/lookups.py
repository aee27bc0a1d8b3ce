"""Lookup joins: first match, unique match, best match, and joins on prefixes, suffixes and intervals as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which should end in a unique column."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    """At most ``k`` rows for each key; ``k`` may be a column. Spark limits each map task's groups before the shuffle for a constant."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; a name that several symbols share resolves to none of them."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("__c")).where("__c = 1").select(key), key, "left_semi")


def dotted_prefixes(c: Column) -> Column:
    """``a``, ``a.b``, ... of ``a.b.c``, the whole left out, longest first."""
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def path_suffixes(c: Column, most: int = 5) -> Column:
    """The last 1 to ``most`` segments of a path."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))


def longest_owner(members: DataFrame, owners: DataFrame, name: str = "qualified_name", within: Sequence[str] = ()) -> DataFrame:
    """``members`` with ``owner``: the longest of ``owners`` whose name and a dot begin the member's name, in the same ``within``; null if none.

    The prefixes of each member are joined for equality, never by comparing all with all.
    """
    own = owners.select(*[F.col(w).alias(f"__o_{w}") for w in within], F.col(name).alias("owner")).distinct()
    each = members.select("*", F.explode_outer(dotted_prefixes(F.col(name))).alias("__p"))
    on = F.col("__p") == F.col("owner")
    for w in within:
        on = on & (F.col(w) == F.col(f"__o_{w}"))
    hit = each.join(own, on, "left").groupBy(*members.columns).agg(F.max(F.struct(F.length("owner").alias("n"), "owner"))["owner"].alias("owner"))
    return hit


def best_match(refs: DataFrame, candidates: DataFrame, ref_key: str, rules: Sequence[tuple[str, str]], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Each reference's best candidate over several rules (column of refs, column of candidates), as a union of equi-joins.

    ``order`` may use columns of both and ``__rule``, the number of the rule; references without a candidate are left out.
    """
    out = None
    for i, (a, b) in enumerate(rules):
        j = refs.join(candidates, refs[a] == candidates[b]).withColumn("__rule", F.lit(i))
        out = j if out is None else out.unionByName(j)
    return first_by(out, [ref_key], list(order)).select(*keep)


def dotted_suffixes(c: Column) -> Column:
    """``c``, ``b.c``, ``a.b.c`` of ``a.b.c``."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imported, file_path``: each import's file. ``imports``: imported, candidates (array of paths); ``files``: file_path.

    Candidates are tried in sorted order; one that is a file's path counts first, else the first file (by path) of which it is the last one to five
    segments. Imports without a file are left out.
    """
    tried = imports.select("imported", F.posexplode(F.array_sort(F.array_distinct("candidates"))).alias("place", "suffix"))
    each = files.where("file_path is not null").select("file_path").distinct()
    index = each.select("file_path", F.explode(path_suffixes(F.col("file_path"))).alias("suffix")).groupBy("suffix").agg(F.min("file_path").alias("file_path"))
    exact = tried.join(each.withColumn("suffix", F.col("file_path")), "suffix").withColumn("rule", F.lit(0))
    ending = tried.join(index, "suffix").withColumn("rule", F.lit(1))
    return first_by(exact.unionByName(ending), ["imported"], [F.col("place"), F.col("rule"), F.col("file_path")]).select("imported", "file_path")


def bind_targets(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """``bindings`` (proxy, target) with ``uid``: of the symbols whose qualified name is the target or ends in it at a dot the one of the shortest name."""
    ends = symbols.select(F.col("uid"), "qualified_name", F.explode(dotted_suffixes(F.col("qualified_name"))).alias("target"))
    return first_by(bindings.join(ends, "target"), ["proxy"], [F.length("qualified_name"), F.col("qualified_name"), F.col("uid")]).drop("qualified_name")


#: Members of a group that are sent in one row, at most.
MEMBERS = 256


def link_bases(inherits: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``sub_uid, base_uid``: classes with the classes of the base's name in the same file or in one that it imports.

    ``inherits``: sub_uid, base_name, file_path; ``symbols``: uid, name, kind, file_path; ``imports``: file_path, imported. Classes that name the same
    bases in the same files meet as one, and so do bases of the same names and files: pairs of such groups are made distinct, by equi-joins on name and
    file in place of an OR. Every class is in one group, so that the pairs of members, which can be many more, are distinct without a shuffle.
    """
    sub = _alike(inherits.select(F.col("sub_uid").alias("uid"), F.col("base_name").alias("name"), "file_path"))
    base = _alike(symbols.where("kind = 'class'").select("uid", "name", "file_path"))
    # explode_outer, as explode would have a filter put below the windows, and the groups would be made twice.
    each = lambda df: df.where("uid = first").select("first", F.explode_outer("at").alias("at")).select("first", "at.*")
    seen = imports.dropna().groupBy("file_path").agg(F.collect_set("imported").alias("seen"))
    own = F.array("file_path")
    near = each(sub).join(seen, "file_path", "left").select(F.col("first").alias("sub"), "name", F.explode(F.coalesce(F.array_union(own, "seen"), own)).alias("file_path"))
    pairs = near.join(each(base).withColumnRenamed("first", "base"), ["name", "file_path"]).select("sub", "base").distinct()
    subs = sub.groupBy(F.col("first").alias("sub"), "part").agg(F.collect_list("uid").alias("uids")).select("sub", "uids")
    found = subs.join(pairs, "sub").join(base.select(F.col("first").alias("base"), F.col("uid").alias("base_uid")), "base")
    return found.select(F.explode("uids").alias("sub_uid"), "base_uid").where("sub_uid <> base_uid")


def _alike(df: DataFrame) -> DataFrame:
    """``uid, at, first, part``: each uid once with all its (name, file_path), the least uid that has just the same, and the part of their group that it is in; rows with a null are left out."""
    each = df.dropna().groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("name", "file_path"))).alias("at"))
    w = W.partitionBy("at").orderBy("uid")
    return each.select("uid", "at", F.first("uid").over(w).alias("first"), F.floor((F.row_number().over(w) - 1) / MEMBERS).alias("part"))


def abstain_join(left: DataFrame, right: DataFrame, left_key: str, on: str, least: int = 1, most: int = 3) -> DataFrame:
    """left joined with right on ``on``, keeping only rows of left with ``least`` to ``most`` matches; matches are counted before they are joined."""
    counts = right.groupBy(on).agg(F.count("*").alias("__c")).where(F.col("__c").between(least, most)).select(on)
    return left.join(right.join(counts, on, "left_semi"), on)


def capped_bridge(producers: DataFrame, consumers: DataFrame, key: str, cap: int) -> DataFrame:
    """``src, dst, key`` for producers (src, key) and consumers (dst, key) of a key that neither side has more than ``cap`` of; no self pairs.

    Hubs are dropped before the join, so a key gives cap x cap rows at most.
    """
    small = lambda df: df.groupBy(key).agg(F.count("*").alias("__c")).where(F.col("__c") <= cap).select(key)
    p = producers.distinct()
    c = consumers.distinct()
    return p.join(small(p), key, "left_semi").join(c.join(small(c), key, "left_semi"), key).where("src <> dst").select("src", "dst", key)


#: Items of a group that meet in one task, about; larger groups are dealt into blocks.
GROUP_BLOCK = 512


def shared_pairs(df: DataFrame, item: str, group: str, least: int, exclude: Sequence = ()) -> DataFrame:
    """``a, b, shared``: pairs of items that share at least ``least`` groups. The groups of ``exclude``, which everybody uses, bind nothing; no other is left out for its size.

    A large group's items are dealt into blocks, and every two blocks meet under their own key, so no key holds more than two blocks' pairs;
    pairs are counted before they are shuffled.
    """
    d = df.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(F.col(item).alias("__i"), F.col(group).alias("__g")).distinct()
    d = d.where(~F.col("__g").isin(list(exclude))) if len(exclude) else d
    sizes = d.groupBy("__g").agg(F.count("*").alias("__c")).where("__c > 1").select("__g", F.ceil(F.col("__c") / GROUP_BLOCK).cast("int").alias("__n"))
    d = d.join(sizes, "__g").withColumn("__b", F.pmod(F.xxhash64("__i"), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = d.select("__g", F.col("__i").alias("a"), F.col("__b").alias("__x"), every.alias("__y"))
    right = d.select("__g", F.col("__i").alias("b"), F.col("__b").alias("__y"), every.alias("__x"))
    return left.join(right, ["__g", "__x", "__y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def innermost(points: DataFrame, spans: DataFrame, on: str, at: str, bin_size: int = 64) -> DataFrame:
    """Each point (on, at) with the shortest span (on, start, end, uid) that holds it, ties to the lesser start and uid; points in no span are left out.

    Spans are cut into bins of lines and meet points by equality of file and bin.
    """
    s = spans.where("start <= end").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    p = points.withColumn("__b", F.floor(F.col(at) / bin_size))
    hit = p.join(s, [on, "__b"]).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).drop("__b")
    return first_by(hit, points.columns, [F.expr("end - start"), F.col("start"), F.col("uid")])


def overlay_callers(sites: DataFrame, spans: DataFrame, most: int = 50) -> DataFrame:
    """``file_path, uid, name, line``: the innermost symbols around the call sites of each name, once for each file and caller, never the name itself, ``most`` of a name.

    ``sites``: file_path, line, name (what is called); ``spans``: file_path, uid, symbol, start, end. The first site of a caller counts; callers are in order of file and line.
    """
    around = innermost(sites.select("file_path", "line", "name").distinct(), spans, "file_path", "line").where("symbol <> name")
    one = around.groupBy("name", "file_path", "uid").agg(F.min("line").alias("line"))
    return top_by(one, ["name"], [F.col("file_path"), F.col("line"), F.col("uid")], most).select("file_path", "uid", "name", "line")


def promote_contained(containers: DataFrame, on: str = "file_path") -> DataFrame:
    """``uid, channels, spans, score``: spans (on, uid, start, end, channels, score) with the evidence of all spans inside them: all channels, all spans, the best score.

    Spans of another symbol of the same file count, each once. Symbols that hold none are left out.
    """
    c = containers.select(on, "uid", "start", "end", "channels", "score")
    common = overlaps(c, c, on).where("left_uid <> right_uid")
    inner = c.select(on, F.col("uid").alias("right_uid"), "start", "end", "channels", "score")
    held = common.join(inner, [on, "right_uid", "start", "end"]).select(F.col("left_uid").alias("uid"), "start", "end", "channels", "score")
    every = held.unionByName(c.select("uid", "start", "end", "channels", "score").join(held.select("uid").distinct(), "uid", "left_semi"))
    spread = every.select("uid", F.struct("start", "end").alias("span"), "score", F.explode_outer("channels").alias("channel"))
    return spread.groupBy("uid").agg(F.sort_array(F.collect_set("channel")).alias("channels"), F.sort_array(F.collect_set("span")).alias("spans"), F.max("score").alias("score"))


def overlaps(left: DataFrame, right: DataFrame, on: str, bin_size: int = 64) -> DataFrame:
    """``on, left_uid, right_uid, start, end``: the common part of spans (on, uid, start, end) of both sides, each pair once."""
    cut = lambda df, p: df.where("start <= end").select(on, *[F.col(c).alias(f"{p}_{c}") for c in ("uid", "start", "end")], F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))).alias("__b"))
    j = cut(left, "left").join(cut(right, "right"), [on, "__b"])
    start, end = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    # A pair that shares several bins counts in the one where its common part begins.
    return j.where((start <= end) & (F.floor(start / bin_size) == F.col("__b"))).select(on, "left_uid", "right_uid", start.alias("start"), end.alias("end"))


def merge_spans(spans: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on..., start, end``: spans merged where they overlap or adjoin."""
    w = W.partitionBy(*on).orderBy("start", "end")
    s = spans.select(*on, "start", "end").where("start <= end").withColumn("__reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("__i", F.sum(F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + 1), 1).otherwise(0)).over(w))
    return s.groupBy(*on, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each row of left with the ``values`` of right's last row not after it, by one ordered union instead of a range join."""
    cols = [c for c in left.columns if c not in (*on, at)]
    right = right.select(*on, at, *values)
    both = left.select(*on, at, F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]).unionByName(
        right.select(*on, at, F.lit(0).alias("__side"), F.lit(None).alias("__row"), *values), allowMissingColumns=True
    )
    w = W.partitionBy(*on).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    for v in values:
        both = both.withColumn(v, F.last(v, ignorenulls=True).over(w))
    return both.where("__side = 1").select(*on, at, "__row.*", *values)
