"""Splitting oversized items at natural boundaries.

A hierarchy of separators (section, paragraph, line or sentence, word, character) is applied recursively: what a level leaves too
large goes to the next. The units that result are packed greedily to the limit; each piece begins with the end of the piece
before it, from a blank on where the overlap holds one. Every character of the item is in some piece.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import deal

#: Where a unit may begin, from the coarsest level to words; what matches belongs to the unit before it.
LEVELS = {
    "doc": (
        re.compile(r"\n(?=[ \t]{0,3}#{1,6}\s|={1,6}[^=\n]|<h[1-6][\s>]|\\(?:sub)*section\b|\\chapter\b)|\f", re.I),
        re.compile(r"(?:\r?\n[ \t]*){2,}|</p>\s*|\r?\n(?=[ \t]*(?:[-*+]|\d+[.)])\s)", re.I),
        re.compile(r"\r?\n|(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])"),
        re.compile(r"\s+"),
    ),
    "symbol": (
        re.compile(r"\n(?=(?:async\s+def|def|class|func|fn|function|public|private|protected|static|export|impl|struct|interface|@)\b)"),
        re.compile(r"(?:\r?\n[ \t]*){2,}"),
        re.compile(r"\r?\n"),
        re.compile(r"\s+"),
    ),
}
WORD, CHARACTER = 3, 4
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))


def units(text: str, kind: str, limit: int, room: int) -> Iterator[tuple[int, int, int]]:
    """``start, end, level`` of units that together are the text: of at most ``room``, or a word of at most ``limit``.

    Level is the one whose separator ends the unit before; CHARACTER only inside a run of more than ``limit`` characters without white space.
    """
    stack = [(0, len(text), 0, 0)]
    while stack:
        a, b, level, born = stack.pop()
        if b - a <= room:
            yield a, b, born
            continue
        if level > WORD:
            word_end = b
            while word_end > a and text[word_end - 1].isspace():
                word_end -= 1
            if word_end - a <= limit:  # a word that fits, with the blanks after it
                if b - a <= limit:
                    yield a, b, born
                else:
                    if word_end > a:
                        yield a, word_end, born
                    for i in range(word_end, b, room):
                        yield i, min(b, i + room), WORD
                continue
            for i in range(a, b, room):
                yield i, min(b, i + room), born if i == a else CHARACTER
            continue
        cuts = [m.end() for m in LEVELS[kind][level].finditer(text, a, b) if a < m.end() < b]
        edges = [a, *cuts, b]
        stack.extend((s, e, level + 1, born if s == a else level) for s, e in reversed(list(zip(edges, edges[1:], strict=False))))


def split(text: str, kind: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """``start, end, level, text`` of the pieces, each of at most ``limit`` characters; level is that of the cut before the piece.

    The overlap is at most half the limit, and less before a word that would not fit otherwise. A text within the limit is one piece;
    an empty one has none.
    """
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit // 2)
    if len(text) <= limit:
        return [(0, len(text), 0, text)] if text else []
    blanks = [m.end() for m in re.finditer(r"\s+", text)]
    out: list[tuple[int, int, int, str]] = []
    start = fresh = end = 0  # the piece, where its own part begins, where it ends so far
    cut = 0
    for a, b, level in units(text, kind, limit, limit - overlap):
        if b - start > limit and end > fresh:
            out.append((start, end, cut, text[start:end]))
            least = max(end - overlap, b - limit, start + 1)
            i = bisect.bisect_left(blanks, least)
            start = blanks[i] if overlap and i < len(blanks) and blanks[i] < end else min(least, end)
            fresh, cut = end, level
        end = b
    out.append((start, end, cut, text[start:end]))
    return out


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of ``items`` (item_type, item_id, text) longer than their type's limit, each once, with max_chars and overlap_chars.

    ``limits`` has a row or repeated rows for each type (the least limit counts); types without one, or with null or no positive
    limit, have no limit. Lengths are in code points.
    """
    lim = limits.where(F.col("max_chars") > 0).groupBy("item_type").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    return items.select("item_type", "item_id", "text").join(lim, "item_type").where(F.length("text") > F.col("max_chars")).dropDuplicates(["item_type", "item_id", "text"])


def split_items(large: DataFrame) -> DataFrame:
    """``item_type, item_id, text_key, pieces``: array of struct(start, end, level, text) for each row of oversized()."""

    @F.pandas_udf(PIECES)
    def cut(kind: pd.Series, text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "level": v, "text": t} for s, e, v, t in split(x, k if k in LEVELS else "doc", int(n), int(o))] for k, x, n, o in zip(kind, text, limit, overlap, strict=True)])

    return deal(large).select("item_type", "item_id", F.xxhash64("text").alias("text_key"), cut("item_type", "text", "max_chars", "overlap_chars").alias("pieces"))


def pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_type, item_id, text_key, piece, start, end, text``: all pieces of all items, pieces numbered from 0.

    text_key is a hash of the whole text, which tells the pieces of different texts of one item apart. Items within their limit are one piece and never leave the JVM; null and empty texts have no piece. Repeated rows count once.
    """
    lim = limits.where(F.col("max_chars") > 0).groupBy("item_type").agg(F.min("max_chars").alias("max_chars"))
    small = (
        items.select("item_type", "item_id", "text").join(lim, "item_type", "left").where((F.length("text") > 0) & (F.col("max_chars").isNull() | (F.length("text") <= F.col("max_chars"))))
        .select("item_type", "item_id", "text").distinct()
        .select("item_type", "item_id", F.xxhash64("text").alias("text_key"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("text").alias("end"), "text")
    )
    large = split_items(oversized(items, limits)).select("item_type", "item_id", "text_key", F.posexplode("pieces").alias("piece", "p")).select("item_type", "item_id", "text_key", "piece", "p.start", "p.end", "p.text")
    return small.unionByName(large)


def cuts(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_type, item_id, cut``: the items that had to be split; ``hard`` if a piece had to be cut between characters of a word, else ``natural``."""
    hard = F.exists("pieces", lambda p: p["level"] == CHARACTER)
    return split_items(oversized(items, limits)).select("item_type", "item_id", hard.alias("hard")).groupBy("item_type", "item_id").agg(F.when(F.max("hard"), "hard").otherwise("natural").alias("cut"))
