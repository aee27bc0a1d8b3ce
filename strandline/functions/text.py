"""Column expressions on text and paths; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that hold tests.
TEST_FOLDERS = ("tests", "test", "t", "__tests__", "testfixtures", "__testfixtures__", "integration", "e2e")


def is_test_path(path: Column) -> Column:
    """A test folder among the segments, or a test's file name."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, TEST_FOLDERS))) | name.rlike(r"^(test_.*|.*_test)\.py$|^conftest\.py$")


#: Folders and file names that tell a file's tier; the first tier that fits counts.
TIER_TEST_FOLDERS = "tests test t qa __tests__ testfixtures __testfixtures__ integration e2e".split()
TIER_TEST_NAME = r"^(test_[^/]+\.(py|js|jsx|ts|tsx)|[^/]+_test\.(py|js|jsx|ts|tsx)|[^/]+\.(spec|test)\.[a-z]+|conftest\.py)$"
EXAMPLE_FOLDERS = "examples example tutorial tutorials demo demos sample samples docs_src benchmarks codemods".split()
DOC_FOLDERS, DOC_NAME = ("docs", "doc"), r"\.(md|rst|txt)$"


def file_tier(path: Column, reexport: Column | None = None) -> Column:
    """test, example, doc, stub, reexport or core, in this order of precedence; ``reexport`` tells files that only pass names on. No path is core."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    lies_in = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "core").when(lies_in(TIER_TEST_FOLDERS) | name.rlike(TIER_TEST_NAME), "test").when(lies_in(EXAMPLE_FOLDERS), "example")
        .when(lies_in(DOC_FOLDERS) | F.lower(name).rlike(DOC_NAME), "doc").when(F.lower(name).endswith(".pyi"), "stub").when(F.coalesce(reexport, F.lit(False)) if reexport is not None else F.lit(False), "reexport").otherwise("core")
    )


#: Weight of a row by its file's tier, for seeds and when the impact of a change is asked for.
SEED_WEIGHT = {"core": 1.0, "reexport": 0.5, "stub": 0.5, "doc": 0.3, "example": 0.2, "test": 0.0}
IMPACT_WEIGHT = {"core": 1.0, "reexport": 0.5, "stub": 0.5, "doc": 0.6, "example": 0.6, "test": 1.0}


def tier_weight(tier: Column, impact: bool = False) -> Column:
    """Weight of a tier; 1 for an unknown one."""
    table = IMPACT_WEIGHT if impact else SEED_WEIGHT
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[tier], F.lit(1.0))


def identifier_parts(text: Column) -> Column:
    """Lower-case parts of identifiers: split at case changes and at all but letters and digits; runs of at least two letters."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z][a-z0-9]+"), F.lit(0))


def identifiers(text: Column) -> Column:
    """Distinct names in snake case or camel case in a text, sorted: what may be the name of a symbol."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9]*_[A-Za-z0-9_]*[A-Za-z0-9]|[a-z]+[A-Z][A-Za-z0-9]*"), F.lit(0))))


def token_estimate(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("bigint")


def word_windows(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Windows of ``size`` words, each starting ``size - overlap`` after the one before; the last may be all overlap. Empty for no words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def signature_lines(code: Column) -> Column:
    """The lines that declare something."""
    return F.filter(F.split(code, "\n"), lambda line: line.rlike(r"^\s*(async def|def|class|func|function|fn|public|private|protected|export|interface|type)\b"))


def http_path(path: Column) -> Column:
    """A route in one notation: lower case, one slash between segments, none at the end, parameters as {}."""
    p = F.regexp_replace(F.lower(F.trim(path)), r"\?.*$", "")
    p = F.regexp_replace(p, r"(<[^>]*>|\{[^}]*\}|:[a-z_][a-z0-9_]*)", "{}")
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


#: Whole words of a passage, and of its headings, that tell what it is.
DEPRECATED_WORDS = "deprecated deprecation migration migrate removed renamed".split()
WARNING_WORDS = "warning caution danger security important avoid".split()
HEADING_WORDS = "api reference parameter parameters return returns class function method".split()
DEFINITION_WORDS = "argument arguments parameter parameters return returns raises signature".split()


def _any_word(words: list[str]) -> str:
    return r"(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)"


def anchor_type(text: Column, path: Column | None = None) -> Column:
    """What a passage of documentation is, by its words, its headings of up to four levels, its code and the folder of its file; the first that fits.

    Letters here are those from a to z.
    """
    t, p = F.lower(text), F.lower(F.coalesce(path, F.lit(""))) if path is not None else F.lit("")
    heading = r"(?m)^[ \t]*#{1,4}[ \t]([^\n]*[^a-z\n])?(" + "|".join(HEADING_WORDS) + r")([^a-z]|$)"
    return (
        F.when(t.rlike(_any_word(DEPRECATED_WORDS)), "deprecated").when(t.rlike(_any_word(WARNING_WORDS)), "warning")
        .when(F.contains(text, F.lit("```")) | F.contains(p, F.lit("/examples/")) | F.contains(p, F.lit("/tutorial/")), "example")
        .when(F.contains(p, F.lit("/reference/")) | t.rlike(heading) | t.rlike(_any_word(DEFINITION_WORDS)), "definition").otherwise("reference")
    )


#: Confidence of a link by its resolver (a semantic one has its score within bounds), and what raises or lowers it.
RESOLVER_BASE, SEMANTIC_BOUNDS = {"identifier": 0.68, "pending_identifier": 0.62}, (0.25, 0.72)
WORD_BONUS, HEADING_BONUS, CODE_BONUS, KIND_BONUS, EXAMPLE_BONUS = 0.14, 0.10, 0.08, 0.05, -0.04


def anchor_confidence(resolver: Column, semantic: Column, text: Column, name: Column, kind: Column) -> Column:
    """Confidence that a passage documents a symbol: a base by resolver, raised by a whole-word, heading or code mention and by the kind of passage; 0.05 to 1.

    A code mention is the name between back ticks or before a bracket. ``name`` consists of letters, digits and underscores.
    """
    table = F.create_map(*[F.lit(x) for kv in RESOLVER_BASE.items() for x in kv])
    base = F.coalesce(table[resolver], F.greatest(F.lit(SEMANTIC_BOUNDS[0]), F.least(F.lit(SEMANTIC_BOUNDS[1]), F.coalesce(semantic, F.lit(0.0)))))
    has = lambda cond, value: F.when(cond, value).otherwise(0.0)
    word = F.regexp_like(text, F.concat(F.lit(r"(?m)\b"), name, F.lit(r"\b")))
    head = F.regexp_like(text, F.concat(F.lit(r"(?m)^#{1,6}\s+.*\b"), name, F.lit(r"\b")))
    code = F.contains(text, F.concat(F.lit("`"), name, F.lit("`"))) | F.contains(text, F.concat(name, F.lit("(")))
    bonus = F.when(kind.isin("definition", "warning", "deprecated"), KIND_BONUS).when(kind == "example", EXAMPLE_BONUS).otherwise(0.0)
    total = base + has(word, WORD_BONUS) + has(head, HEADING_BONUS) + has(code, CODE_BONUS) + bonus
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), total)), 3)


def uid(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


#: Packages that everybody uses; calls to them bind nobody together.
PLUMBING_ROOTS = (
    "abc asyncio builtins collections contextlib copy dataclasses datetime enum functools importlib inspect io itertools json logging operator os pathlib re subprocess sys threading types typing typing_extensions warnings weakref "
    "annotated_doc doctest pytest rich typer unittest"
).split()


def external_root(name: Column) -> Column:
    """The package of a dotted name."""
    return F.substring_index(name, ".", 1)


def classify_roots(roots: DataFrame, boundary: DataFrame, named: DataFrame) -> DataFrame:
    """``roots`` (root) with ``class``: internal if in ``boundary`` (root), else external if in ``named`` (root), else, and for the empty root, skip."""
    b, n = boundary.select("root").distinct().withColumn("__b", F.lit(True)), named.select("root").distinct().withColumn("__n", F.lit(True))
    kind = F.when(F.coalesce("root", F.lit("")) == "", "skip").when(F.col("__b"), "internal").when(F.col("__n"), "external").otherwise("skip")
    return roots.join(b, "root", "left").join(n, "root", "left").withColumn("class", kind).drop("__b", "__n")


#: Bounds of a request's limit and token budget.
LIMIT_BOUNDS, BUDGET_BOUNDS = (1, 50), (400, 32_000)


def bounded(c: Column, bounds: tuple[int, int]) -> Column:
    """A number brought within bounds."""
    return F.least(F.lit(bounds[1]), F.greatest(F.lit(bounds[0]), c))


def lines(text: Column, first: Column, last: Column) -> Column:
    """The lines of a text from ``first`` to ``last``, counted from 1, both included; null for a null text, empty if there are none."""
    every = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    return F.array_join(F.slice(every, F.greatest(F.lit(1), first), F.greatest(F.lit(0), last - F.greatest(F.lit(1), first) + 1)), "\n")


def same_path(a: Column, b: Column) -> Column:
    """Whether two paths may mean one file: equal, or one the end of the other at a folder's border."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def redact(values: Column, safe: tuple[str, ...]) -> Column:
    """``kept, redacted`` of a map: the entries with safe names, and the sorted names of the others that hold something."""
    kept = F.map_filter(values, lambda k, v: k.isin(*safe))
    gone = F.sort_array(F.map_keys(F.map_filter(values, lambda k, v: ~k.isin(*safe) & v.isNotNull())))
    return F.struct(kept.alias("kept"), gone.alias("redacted"))


def http_fingerprint(method: Column, path: Column) -> Column:
    """What a client and a handler have in common: the method in capitals (GET where none is said) and the route in one notation."""
    m = F.upper(F.trim(F.coalesce(method, F.lit(""))))
    return F.concat(F.when(m == "", "GET").otherwise(m), F.lit(" "), http_path(path))


#: Relative weights of budgets by intent; the least of them is the caller's own budget.
BUDGET_WEIGHTS, MODE_INTENTS = {"architecture": 12_000, "impact": 6_000}, ("impact_analysis", "trace_dependency", "impact", "trace")


def budget(intent: Column, base: Column) -> Column:
    """Tokens for an intent: the weight of impact if the question is about impact or a trace, of architecture otherwise, scaled so that the least weight is ``base``."""
    least = min(BUDGET_WEIGHTS.values())
    weight = F.when(intent.isin(*MODE_INTENTS), BUDGET_WEIGHTS["impact"]).otherwise(BUDGET_WEIGHTS["architecture"])
    return F.greatest(F.lit(1), F.round(base * weight / F.lit(float(least))).cast("bigint"))


def line_windows(text: Column, size: int, overlap: int = 0, least: int = 1) -> Column:
    """Windows of ``size`` lines as struct(start, end, text), each starting ``size - overlap`` lines after the one before; a last one of fewer than ``least`` lines is
    left out, unless it is the only one. Lines are counted from 1."""
    every = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    n = F.size(every)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | ((n - s >= least) & (n - s > overlap)))
    return F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.least(n, s + size).alias("end"), F.array_join(F.slice(every, s + 1, size), "\n").alias("text")))


def trim_to_budget(text: Column, budget: int, anchor: Column | None = None) -> Column:
    """A text within three quarters of a token budget (at least 400): as it is if it fits, else whole lines, around the line ``anchor`` if one is given, from the start otherwise.

    Tokens are a quarter of the length, rounded up. A window around a line has a quarter as many lines as tokens, at least 50, and begins a quarter of that before the line.
    """
    most = max(400, int(budget * 0.75))
    room = max(50, most // 4)
    every = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    # An empty piece behind the last line end is no line.
    every = F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    total = F.size(every)
    step = lambda a, line: F.when(a["full"] | (F.floor((a["n"] + F.length(line) + 3) / 4) > most), F.struct(a["n"].alias("n"), a["k"].alias("k"), F.lit(True).alias("full"))).otherwise(F.struct((a["n"] + F.length(line) + 1).alias("n"), (a["k"] + 1).alias("k"), F.lit(False).alias("full")))
    kept = F.aggregate(every, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full")), step)["k"]
    head = F.array_join(F.slice(every, 1, kept), "\n")
    if anchor is not None:
        centre = F.greatest(F.lit(0), F.least(anchor - 1, total - 1))
        end = F.least(total, F.greatest(F.lit(0), centre - room // 2 // 2) + room)
        around = F.array_join(F.slice(every, F.greatest(F.lit(0), end - room) + 1, room), "\n")
        head = F.when(anchor.isNotNull(), around).otherwise(head)
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(token_estimate(text) <= most, text).otherwise(head)
