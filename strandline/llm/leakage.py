"""Evaluation texts in training text: rare n-gram seeds, then alignment of each document with the items it may contain.

Seeds. A passage counts if it is long enough and stands in one item only. For each place of an item the shortest such passage that
begins there is found, and of its n-grams the one in the fewest items is its seed. Every document that holds a passage that
counts holds its seed; instructions shared by many items yield no seeds of their own.

Documents are reduced to rolling hashes of their n-grams, kept only where a seed has the same hash, and joined with the seeds. Pairs of
document and item that meet so are aligned (Smith-Waterman over words, many pairs at a time). A passage of n words alone scores n matches, so
what scores less holds none; the rest is checked for equal words exactly. Such seeds are exact for whole passages only; edited copies are found
by edited_copies().
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import checkpoint_dir
from ..sources.tables import deal, spread

WORDS = re.compile(r"[^\W_]+")
#: Odd factor of the rolling hash, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Seeds that are sent to the tasks to drop n-grams that can't meet (8 bytes each); with more seeds nothing is dropped before the join.
FILTER_SEEDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -2
#: Words of the documents of a table of alignments, times its pairs, about.
TABLE_CELLS = 200_000
#: Words of item texts that a task of edited_copies() holds, about; more are taken in turns.
HELD_WORDS = 4_000_000
#: Documents that are counted against the items at a time.
COUNTED = 512


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORDS.findall(text.lower()) if text else []


@functools.lru_cache(maxsize=200_000)
def _word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def hashes(ws: list[str], n: int) -> np.ndarray:
    """The rolling hashes of all n-grams, as int64."""
    if len(ws) < n:
        return np.empty(0, np.int64)
    h = np.fromiter((_word_hash(w) for w in ws), np.uint64, len(ws))
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for j in range(n):
        out = out * BASE + h[j : j + len(out)]
    return out.view(np.int64)


def _inside(split: list[list[str]], n: int) -> np.ndarray:
    """Which n-grams of the words of several texts, end to end, lie within one text."""
    at = np.repeat(np.arange(len(split)), [len(w) for w in split])
    return at[: len(at) - n + 1] == at[n - 1 :]


def item_words(items: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``item_id, field, words``: one row for each distinct text of an item; null and wordless texts are left out."""

    @F.pandas_udf("array<string>")
    def split(t: pd.Series) -> pd.Series:
        return t.map(words, na_action=None)

    each = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("t"))
    return each.select("item_id", "t.field", split("t.text").alias("words")).distinct().where(F.size("words") > 0)


def lone_passages(parts: DataFrame, least: int) -> DataFrame:
    """``item_id, field, words, ends``: ends[s] is the end of the shortest passage from s on that is in no other item, 0 if there is none.

    ``parts`` as from item_words. Passages of ``least`` words are compared by hash over all items; only places where such a passage stands in
    several items are looked at further, by ever longer passages.
    """
    @F.pandas_udf("array<bigint>")
    def grams(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: hashes(list(w), least))

    @F.pandas_udf("array<struct<s int, e int, h bigint>>")
    def longer(ws: pd.Series, starts: pd.Series) -> pd.Series:
        def one(w: list[str], at: list[int]) -> list[dict]:
            h = np.fromiter((_word_hash(x) for x in w), np.uint64, len(w))
            out = []
            for s in at:
                x = np.uint64(0)
                with np.errstate(over="ignore"):
                    for e in range(s + 1, len(w) + 1):
                        x = x * BASE + h[e - 1]
                        if e > s + least:
                            out.append({"s": s, "e": e, "h": int(x.view(np.int64))})
            return out

        return pd.Series([one(list(w), list(a)) for w, a in zip(ws, starts, strict=True)])

    key = ["item_id", "field", "words"]
    placed = parts.select(*key, F.posexplode(grams("words")).alias("s", "h"))
    shared = placed.groupBy("h").agg(F.countDistinct("item_id").alias("n"))
    first = placed.join(shared, "h").groupBy(*key).agg(
        F.collect_list(F.when(F.col("n") == 1, F.struct("s", (F.col("s") + least).alias("e")))).alias("done"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("s")))).alias("open")
    )
    more = first.where(F.size("open") > 0).select(*key, F.explode(longer("words", "open")).alias("p")).select(*key, "p.s", "p.e", "p.h")
    # A longer passage may also be part of another item's text of which this place is no start of an open passage; all starts are compared.
    lone = more.join(more.groupBy("h").agg(F.countDistinct("item_id").alias("n")).where("n = 1"), "h", "left_semi").groupBy(*key, "s").agg(F.min("e").alias("e"))
    found = lone.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("far"))
    both = first.join(found, key, "left").select(*key, F.concat("done", F.coalesce("far", F.array().cast("array<struct<s:int,e:int>>"))).alias("spans"))
    ends = F.map_from_entries("spans")
    return both.select(*key, F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.coalesce(F.try_element_at(ends, i), F.lit(0))).alias("ends"))


def seeds(passages: DataFrame, n: int) -> DataFrame:
    """``h, item_id, field``: the rarest n-gram of each passage of lone_passages()."""

    @F.pandas_udf("array<bigint>")
    def grams(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: hashes(list(w), n))

    g = passages.withColumn("g", grams("words"))
    count = g.select("item_id", F.explode("g").alias("h")).groupBy("h").agg(F.countDistinct("item_id").alias("df"))
    spans = g.select("item_id", "field", "g", F.posexplode("ends").alias("s", "e")).where("e > 0")
    each = spans.select("item_id", "field", "s", F.explode(F.slice("g", F.col("s") + 1, F.col("e") - F.col("s") - n + 1)).alias("h")).join(count, "h")
    best = each.groupBy("item_id", "field", "s").agg(F.min(F.struct("df", "h"))["h"].alias("h"))
    return best.select("h", "item_id", "field").distinct()


def pairs(docs: DataFrame, seed: DataFrame, n: int) -> DataFrame:
    """``doc_id, text, fields``: documents with the items' texts (item_id, field) of which they hold a seed. ``docs``: doc_id, text.

    Only documents that hold a seed leave the scan, and they are written, so that the corpus is read once. Seeds meet hashes without the
    text beside them; it is joined once to what a document has met.
    """
    total = seed.select("h").distinct().limit(FILTER_SEEDS + 1)
    held = np.sort(np.array([r.h for r in total.collect()], np.int64))
    wanted = docs.sparkSession.sparkContext.broadcast(held) if len(held) <= FILTER_SEEDS else None

    def scan(batches):
        for pdf in batches:
            # One array of words for the batch; n-grams that would reach into the next document are left out.
            split = [words(t) for t in pdf["text"]]
            at = np.repeat(np.arange(len(split)), [len(w) for w in split])
            g = hashes(list(itertools.chain.from_iterable(split)), n)
            at = at[: len(g)]
            if len(g):
                whole = _inside(split, n)
                g, at = g[whole], at[whole]
            if wanted is not None and len(g):
                i = np.searchsorted(wanted.value, g)
                i[i == len(wanted.value)] = 0
                held_ = wanted.value[i] == g if len(wanted.value) else np.zeros(len(g), bool)
                g, at = g[held_], at[held_]
            found = pd.DataFrame({"at": at, "h": g}).drop_duplicates().groupby("at")["h"].agg(list)
            kept = pdf.iloc[found.index.to_numpy(int)]
            yield kept.assign(hs=pd.Series(found.to_list(), index=kept.index, dtype=object))

    hits = spread(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInPandas(scan, "doc_id long, text string, hs array<bigint>")
    hits = hits.withColumn("__t", F.xxhash64("text")).checkpoint()
    met = hits.select("doc_id", "__t", F.explode("hs").alias("h")).join(seed, "h").groupBy("doc_id", "__t").agg(F.collect_set(F.struct("item_id", "field")).alias("fields"))
    return hits.select("doc_id", "__t", "text").dropDuplicates(["doc_id", "__t"]).join(met, ["doc_id", "__t"]).drop("__t")


def align(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment of two word lists: score, and the document's words from and to which it reaches.

    One row of the table for each word of the item, over all words of the document at once; gaps cost the same for each word, so a running
    maximum closes a row.
    """
    code: dict[str, int] = {}
    it = [code.setdefault(w, len(code)) for w in item]
    d = np.fromiter((code.get(w, -1) for w in doc), np.int64, len(doc))
    ramp = np.arange(len(d)) * -GAP
    up, frm = np.zeros(len(d) + 1, np.int64), np.arange(len(d) + 1)
    best = (0, 0, 0)
    for w in it:
        diag = up[:-1] + np.where(d == w, MATCH, MISMATCH)
        over = up[1:] + GAP
        row = np.maximum(np.maximum(diag, over), 0)
        start = np.where(row == 0, np.arange(1, len(d) + 1), np.where(diag >= over, frm[:-1], frm[1:]))
        run = row + ramp
        peak = np.maximum.accumulate(run)
        src = np.maximum.accumulate(np.where(run == peak, np.arange(len(d)), 0))
        closed = peak - ramp
        use = closed > row
        start = np.where(use, start[src], start)
        row = np.maximum(row, closed)
        j = int(row.argmax()) if len(row) else 0
        if len(row) and row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j + 1)
        up, frm = np.concatenate([[0], row]), np.concatenate([[0], start])
    return best


def align_scores(docs: list[list[str]], items: list[list[str]]) -> np.ndarray:
    """The scores of align() for pairs of a document and an item text, many tables at a time."""
    code: dict[str, int] = {}
    out = np.zeros(len(docs), np.int64)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(docs[order[end]]) <= TABLE_CELLS:
            end += 1
        some = order[at:end]
        at = end
        n, m = max(len(docs[i]) for i in some), max(len(items[i]) for i in some)
        if not n or not m:
            continue
        # Words down, pairs across: the running maximum down a table then takes all pairs at once.
        d, it = np.full((n, len(some)), -1, np.int32), np.full((m, len(some)), -2, np.int32)
        for k, i in enumerate(some):
            d[: len(docs[i]), k] = [code.setdefault(w, len(code)) for w in docs[i]]
            it[: len(items[i]), k] = [code.setdefault(w, len(code)) for w in items[i]]
        # The greatest number in a table is that of the ramp and a whole match.
        kind = np.int16 if (n + m) * max(MATCH, -GAP) < 30_000 else np.int64
        ramp = (np.arange(n) * -GAP).astype(kind)[:, None]
        up = np.zeros((n + 1, len(some)), kind)
        best = np.zeros(len(some), kind)
        for j in range(m):
            row = up[:-1] + np.where(d == it[j], kind(MATCH), kind(MISMATCH))
            np.maximum(row, up[1:] + kind(GAP), out=row)
            np.maximum(row, kind(0), out=row)
            row += ramp
            np.maximum.accumulate(row, axis=0, out=row)
            row -= ramp
            np.maximum(best, row.max(axis=0), out=best)
            up[1:] = row
        out[some] = best
    return out


def holds_passage(doc: list[str], item: list[str], ends: list[int], least: int) -> bool:
    """Whether ``doc`` holds one of the passages item[s:ends[s]]."""
    at: dict[tuple[str, ...], list[int]] = {}
    for s, e in enumerate(ends):
        if e:
            at.setdefault(tuple(item[s : s + least]), []).append(s)
    if not at:
        return False
    heads = {k[0] for k in at}
    for i in range(len(doc) - least + 1):
        if doc[i] in heads:
            for s in at.get(tuple(doc[i : i + least]), ()):
                if doc[i : i + ends[s] - s] == item[s : ends[s]]:
                    return True
    return False


def leaks(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "reference_answer"), least: int = 12, seed_words: int = 8) -> DataFrame:
    """``doc_id, item_id, field, score, share, exact``: every document with every item's text of which it holds a seed.

    ``score`` is that of the best local alignment, ``share`` the score as a part of the item text's own; ``exact`` whether at least ``least``
    consecutive words of the text, in no other item, stand in the document. Items that repeat another item's text word for word have no
    passage of their own there. Repeated rows count once; null and empty texts have no words; empty tables give no rows.
    """
    checkpoint_dir(docs.sparkSession)
    # What is made of the items is used several times and small beside the corpus; it is made once.
    passages = lone_passages(item_words(items, fields).checkpoint(), least).checkpoint()
    texts = deal(pairs(docs, seeds(passages, seed_words).checkpoint(), seed_words)).select("doc_id", "text", F.explode("fields").alias("f"))
    texts = texts.select("doc_id", "text", "f.item_id", "f.field").join(passages, ["item_id", "field"])

    @F.pandas_udf("struct<score int, share double, exact boolean>")
    def judge(text: pd.Series, ws: pd.Series, ends: pd.Series) -> pd.DataFrame:
        split: dict[str, list[str]] = {}
        docs_ = [split[t] if t in split else split.setdefault(t, words(t)) for t in text]
        items_ = [list(w) for w in ws]
        scores = align_scores(docs_, items_)
        exact = [bool(x >= MATCH * least) and holds_passage(d, i, list(e), least) for x, d, i, e in zip(scores, docs_, items_, ends, strict=True)]
        return pd.DataFrame({"score": scores, "share": scores / (MATCH * np.array([len(i) for i in items_] or [1])[: len(scores)]), "exact": exact})

    judged = texts.select("doc_id", "item_id", "field", judge("text", "words", "ends").alias("j"))
    return judged.select("doc_id", "item_id", "field", "j.score", "j.share", "j.exact").groupBy("doc_id", "item_id", "field").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("exact").alias("exact"))


def edited_copies(docs: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "reference_answer"), least: int = 12) -> DataFrame:
    """``doc_id, item_id, field, score, share, exact`` as leaks(), of every document and item text with a share of at least a half.

    Nothing is seeded by n-grams that an edit may have hit. Say an alignment of an item text of L words has m equal words, x unequal ones and
    g gaps; a share of a half means 2m - x - 2g >= L, so m >= L/2, and, as x <= L/3, m - x - g >= L/3. Hence at least L/2 places
    of the text have their word in the document, and at least L/3 - 1 have it followed by the text's next word. Documents are counted
    against both bounds, and what reaches them is aligned; all other pairs are below a half.

    A task holds the words of all items up to ``HELD_WORDS``; more items are taken in turns, each of which reads the documents. They are not shuffled.
    """
    checkpoint_dir(docs.sparkSession)
    parts = item_words(items, fields).checkpoint()
    key = ["item_id", "field", "words"]
    texts = parts.join(lone_passages(parts, least), key, "left").select(*key, F.coalesce("ends", F.array().cast("array<int>")).alias("ends")).checkpoint()
    turns = max(1, -(-(texts.agg(F.sum(F.size("words"))).first()[0] or 0) // HELD_WORDS))
    source = spread(docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"))
    found = None
    for turn in range(turns):
        some = texts.where(F.pmod(F.xxhash64("item_id", "field"), F.lit(turns)) == turn) if turns > 1 else texts
        held = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.field, list(r.words), list(r.ends)) for r in some.collect()])
        each = source.mapInPandas(_compare(held, least), "doc_id long, item_id long, field string, score int, share double, exact boolean")
        found = each if found is None else found.unionByName(each)
    return found.groupBy("doc_id", "item_id", "field").agg(F.max("score").alias("score"), F.max("share").alias("share"), F.max("exact").alias("exact"))


def _index(each: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the item texts in order, where the places of each begin among all places and how many there are, and the text of each place."""
    h = [hashes(w, n) for w in each]
    of = np.repeat(np.arange(len(each)), [len(x) for x in h])
    h = np.concatenate([np.empty(0, np.int64), *h])
    order = np.argsort(h, kind="stable")
    known, first, count = np.unique(h[order], return_index=True, return_counts=True)
    return known, first, count, of[order]


def _stretch(doc: list[np.ndarray], length: int, equal: int, followed: int, own: list[np.ndarray]) -> tuple[int, int] | None:
    """From where to where a document may hold a copy with a share of a half of a text of ``length`` words; None if nowhere.

    Such a copy has at most length / 2 gaps and so reaches over 3/2 length words at most. ``own`` are the text's distinct words and pairs of words;
    in such a stretch ``equal`` words must be among the former and ``followed`` pairs among the latter. ``doc``: the document's words and pairs.
    """
    n_words = len(doc[0])
    size = min(n_words, length + length // 2 + 1)
    good = np.ones(n_words - size + 1, bool)
    for n, h, known, least in ((1, doc[0], own[0], equal), (2, doc[1], own[1], followed)):
        if least <= 0:
            continue
        if not len(known) or size < n:
            return None
        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        total = np.concatenate([[0], np.cumsum(hit)])
        good &= total[size - n + 1 :][: len(good)] - total[: len(good)] >= least
    at = np.flatnonzero(good)
    return (int(at[0]), int(at[-1]) + size) if len(at) else None


def _compare(held, least: int):
    def scan(batches):
        each = held.value
        texts = [w for _, _, w, _ in each]
        size = np.array([len(w) for w in texts], np.int64)
        need = (-(-size // 2), -(-size // 3) - 1)
        index = [_index(texts, n) for n in (1, 2)]
        own = functools.lru_cache(maxsize=None)(lambda y, n: np.unique(hashes(texts[y], n)))
        for pdf in batches:
            for a in range(0, len(pdf), COUNTED):
                ids = pdf["doc_id"].to_numpy()[a : a + COUNTED]
                split = [words(t) for t in pdf["text"][a : a + COUNTED]]
                good = np.ones((len(split), len(each)), bool)
                in_doc = [[hashes(w, n) for w in split] for n in (1, 2)]
                for n, (known, first, count, of) in enumerate(index, 1):
                    if not len(known):
                        continue  # no text has two words; none needs a pair
                    g = [np.unique(h) for h in in_doc[n - 1]]
                    doc = np.repeat(np.arange(len(split)), [len(x) for x in g])
                    g = np.concatenate([np.empty(0, np.int64), *g])
                    i = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    hit = known[i] == g
                    i, doc = i[hit], doc[hit]
                    # All places of each n-gram met, one after the other.
                    k = count[i]
                    place = np.repeat(first[i] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum()) if len(k) else np.empty(0, np.int64)
                    met = np.bincount(np.repeat(doc, k) * len(each) + of[place], minlength=good.size).reshape(good.shape)
                    good &= met >= need[n - 1]
                met_ = [(x, y, part) for x, y in zip(*np.nonzero(good), strict=True) if (part := _stretch([h[x] for h in in_doc], len(texts[y]), int(need[0][y]), int(need[1][y]), [own(y, 1), own(y, 2)]))]
                score = align_scores([split[x][a:b] for x, _, (a, b) in met_], [texts[y] for _, y, _ in met_])
                out = [
                    (ids[x], each[y][0], each[y][1], s, s / (MATCH * len(texts[y])), holds_passage(split[x], texts[y], each[y][3], least))
                    for (x, y, _), s in zip(met_, score, strict=True) if 2 * s >= len(texts[y]) * MATCH
                ]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "field", "score", "share", "exact"])

    return scan


def best_fields(found: DataFrame) -> DataFrame:
    """Of each document and item the text of greatest score."""
    rank = F.row_number().over(W.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "field"))
    return found.withColumn("n", rank).where("n = 1").drop("n")
