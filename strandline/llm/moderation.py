"""Scores for abusive, hateful and sexual content: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes the usual disguises: letters of other scripts, digits and signs for letters, invisible characters, accents, letters set
apart, stretched letters, and stars for letters, which match any word of the lexicon that fits. Exception phrases cover technical and
neutral uses: what lies in one is not counted. Weights are normalised by length: what counts is the weight for each hundred
words of a sentence, or of a stretch of ``STRETCH_WORDS`` words of a longer one. A document is a case of a category if one of its
sentences reaches the threshold; its score is the weight of those sentences for each hundred words of the document.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import lexicon as lx

CATEGORIES = ("abusive", "hateful", "sexual")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
TOKEN = re.compile(r"[a-z0-9@$*|+]+(?:!(?=[a-z0-9]))?[a-z0-9@$*|+]*")
APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_·*][^\W_]){2,}(?![^\W_])")
STRETCH = re.compile(r"([a-z])\1{2,}")
#: Kinds of entries that are abusive by their company.
INSULTS = ("slur", "beast", "rough")
DISGUISED = re.compile(r"[0-9@$|+!*]")
#: Words of a stretch: shorter sentences count as this long, longer ones are read in stretches that overlap by half.
STRETCH_WORDS = 40
#: Weight for each hundred words of a sentence from which it is a case: a weight of 1 in a stretch.
THRESHOLD = 2.5 - 1e-9
#: Contempt of this weight is hateful without the name of a group; weaker words count by this part then.
STRONG, UNNAMED = 0.8, 0.3


class Lexicon:
    """The automaton over all phrases, and the words that occur in them."""

    def __init__(self) -> None:
        import ahocorasick

        entries: dict[str, dict[str, float]] = {}

        def add(phrases: str | list[str], kind: str, weight: float) -> None:
            for p in phrases.split(",") if isinstance(phrases, str) else phrases:
                kinds = entries.setdefault(p, {})
                kinds[kind] = max(weight, kinds.get(kind, 0.0))

        for kind, weights in zip(CATEGORIES, (lx.ABUSIVE, lx.HATEFUL, lx.SEXUAL), strict=True):
            for weight, phrases in weights.items():
                add(phrases, kind, weight)
        both = lambda first, second: [f"{a} {b}" for a in first for b in second]
        add(both(lx.VIOLENT, lx.PERSON), "abusive", 1.0)
        add(both(lx.ROUGH, lx.PERSON), "rough", 0.6)
        add(both(lx.WISH, lx.HARM), "abusive", 1.0)
        add(lx.CONTEMPTUOUS, "abusive", 0.4)
        add(both(lx.ADDRESSED, lx.CONTEMPTUOUS), "abusive", 1.0)
        add(lx.ANNOUNCED, "announced", 0.0)
        add(both(lx.OUT_OF, lx.PLACES), "hateful", 0.4)
        add(lx.SLURS, "slur", 0.5)
        add(lx.BEASTS, "beast", 0.5)
        add(both(lx.CALLED, lx.BEASTS), "slur", 0.5)
        add([f"{s} proof" for s in lx.SLURS + lx.BEASTS] + lx.EXCEPTIONS, "exception", 0.0)
        add(lx.ADDRESS, "address", 0.0)
        add(lx.GROUPS, "group", 0.0)
        self.automaton = ahocorasick.Automaton()
        #: The same phrases word by word, for texts with stars: word -> what follows; under "" what ends here.
        self.trie: dict = {}
        common = frozenset(lx.COMMON)
        #: One word of each phrase with a weight, the rarest; a text without any of them holds no weight.
        self.core: set[str] = set()
        for phrase, kinds in entries.items():
            what = [*kinds.items()]
            self.automaton.add_word(f" {phrase} ", (len(phrase), what))
            node = self.trie
            for w in phrase.split():
                node = node.setdefault(w, {})
            node[""] = what
            if any(weight for _, weight in what):
                self.core.add(max(phrase.split(), key=lambda w: (w not in common, len(w), w)))
        self.automaton.make_automaton()
        self.telling = frozenset(self.core) | {g.split()[-1] for g in lx.GROUPS}
        # Words of exceptions keep phrases whole but nothing stands for them in disguise.
        self.words = {w for p, kinds in entries.items() if set(kinds) != {"exception"} for w in p.split()}
        self.by_shape: dict[tuple[int, str], list[str]] = {}
        for w in sorted(self.words):
            self.by_shape.setdefault((len(w), w[0]), []).append(w)

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def reading(self, token: str) -> str:
        """What a token stands for: itself if nothing in the lexicon fits; stars are kept where a word of the lexicon does."""
        bare = token.strip("*")
        if not bare or not bare.isascii():
            return bare or token
        if token.endswith("**") and not token.startswith("*") and self.fits(token):
            return token
        if bare in self.words:
            return bare
        if "*" in bare:
            return bare if self.fits(bare) else bare.replace("*", "")
        if DISGUISED.search(bare) and any(c.isalpha() for c in bare) or bare.isdigit() and len(bare) > 2:
            first = "".join(lx.SUBSTITUTES.get(c, c) for c in bare)
            second = "".join("l" if c in "1|" else lx.SUBSTITUTES.get(c, c) for c in bare)
            for r in (first, second):
                if r in self.words:
                    return r
        if STRETCH.search(bare):
            for r in (STRETCH.sub(r"\1", bare), STRETCH.sub(r"\1\1", bare)):
                if r in self.words:
                    return r
        return bare

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def fits(self, masked: str) -> frozenset[str]:
        """The words of the lexicon that a token with stars for letters may be, however many."""
        shape = re.compile("".join("." if c == "*" else re.escape(lx.SUBSTITUTES.get(c, c)) for c in masked))
        return frozenset(w for w in self.by_shape.get((len(masked), masked[0]), ()) if shape.fullmatch(w))

    def masked_hits(self, tokens: list[str]) -> list[tuple[int, int, str, float]]:
        """Hits (from, to, kind, weight) of phrases over a word with stars, which is every word that fits at once; no exceptions."""
        starts, at = [], 1
        for t in tokens:
            starts.append(at)
            at += len(t) + 1
        out = []
        for i in range(len(tokens)):
            nodes = [(self.trie, False)]
            for j in range(i, len(tokens)):
                t = tokens[j]
                words = self.fits(t) if "*" in t else (t,)
                nodes = [(n[w], m or "*" in t) for n, m in nodes for w in words if w in n]
                if not nodes:
                    break
                best: dict[str, float] = {}
                for n, m in nodes:
                    for kind, weight in n.get("", ()) if m else ():
                        best[kind] = max(weight, best.get(kind, 0.0))
                out += [(starts[i], starts[j] + len(t), k, x) for k, x in best.items() if k != "exception"]
        return out

    def join(self, m: re.Match) -> str:
        """Letters set apart, joined where that gives words of the lexicon; the longest ones first from the left."""
        letters = [lx.SUBSTITUTES.get(c, c) for c in re.sub(r"[ .\-_·*]", "", m[0])]
        out, i = [], 0
        while i < len(letters):
            for j in range(len(letters), i + 2, -1):
                w = "".join(letters[i:j])
                if w in self.words:
                    out.append(w)
                    i = j
                    break
            else:
                out.append(letters[i])
                i += 1
        return m[0] if len(out) == len(letters) else " ".join(out)

    @staticmethod
    def likeliest(masked: list[tuple[int, int, str, float]], plain: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """Of what a word with stars may be, the longest phrase; in several categories, the one that the plain words of the sentence speak for most."""
        masked = [h for h in masked if not any((a < h[0] and h[1] <= b) or (a <= h[0] and h[1] < b) for a, b, _, _ in masked)]
        of = lambda kind: kind if kind in CATEGORIES else "abusive" if kind in INSULTS else None
        known = dict.fromkeys(CATEGORIES, 0.0)
        for _, _, kind, weight in plain:
            if c := of(kind):
                known[c] += weight
        choice: dict[tuple[int, int], tuple[float, float, str]] = {}
        for a, b, kind, weight in masked:
            if c := of(kind):
                choice[a, b] = max(choice.get((a, b), (-1.0, 0.0, "")), (known[c], weight, c))
        return [h for h in masked if of(h[2]) in (None, choice.get(h[:2], (0.0, 0.0, None))[2])]

    def weigh(self, tokens: list[str]) -> tuple[dict[str, float], bool]:
        """Weights of a sentence by category without the group's part, and whether a group is named in it."""
        line = f" {' '.join(tokens)} "
        covered: list[tuple[int, int]] = []
        hits: list[tuple[int, int, str, float]] = []
        for end, (n, what) in self.automaton.iter(line):
            for kind, weight in what:
                if kind == "exception":
                    covered.append((end - n, end))
                else:
                    hits.append((end - n, end, kind, weight))
        if "*" in line:
            hits += self.likeliest(self.masked_hits(tokens), hits)
        if not hits:
            return {}, False
        out = dict.fromkeys(CATEGORIES, 0.0)
        seen = dict.fromkeys(("group", "address", "announced", *INSULTS), 0.0)
        strong = 0.0  # contempt that needs no name of a group beside it
        # A phrase counts for what it covers; shorter ones inside it add nothing.
        hits.sort(key=lambda h: (h[2], h[0] - h[1], h[0]))
        taken: dict[str, list[tuple[int, int]]] = {}
        for a, b, kind, weight in hits:
            if any(x <= a and b <= y for x, y in covered) or any(x <= a and b <= y for x, y in taken.get(kind, ())):
                continue
            taken.setdefault(kind, []).append((a, b))
            if kind in seen:
                seen[kind] = max(seen[kind], weight, 0.1)
                weight = weight if kind in INSULTS else 0.0
                kind = "abusive"
            elif kind == "hateful" and weight >= STRONG:
                strong += weight
            out[kind] += weight
        # A slur said to somebody; the name of a beast only if it is called so or other abuse is near.
        if seen["address"] and (seen["slur"] or seen["beast"] and out["abusive"] > seen["beast"] + 1e-9):
            out["abusive"] += 0.5
        out["weak"] = out["hateful"] - strong
        if seen["rough"] and seen["announced"]:
            out["abusive"] += 0.4
        return out, bool(seen["group"])

    def may_hold(self, tokens: list[str], text: str) -> bool:
        """Whether a text can hold any weight at all: the rarest word of some phrase, plain or in disguise."""
        return not self.core.isdisjoint(tokens) or any(map(self.disguises, set(tokens))) or APART.search(text) is not None

    @functools.lru_cache(maxsize=200_000)  # noqa: B019
    def disguises(self, token: str) -> bool:
        """Whether a token that is no word of the lexicon may stand for one."""
        if not DISGUISED.search(token) and not STRETCH.search(token):
            return False
        r = self.reading(token)
        return r in self.core or "*" in r


@functools.lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


_DROP = {c: None for c in (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)}
_MAP = {ord(k): v for k, v in lx.HOMOGLYPHS.items()} | {0x2019: "'", 0x2018: "'", 0xA0: " "}


def fold(text: str) -> str:
    """Lower case without accents, invisible characters and look-alike letters."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_DROP)).translate(_MAP)
    return "".join(c for c in text if not unicodedata.combining(c))


def score(text: str | None) -> tuple[int, dict[str, float], dict[str, float]]:
    """Number of words; weight by category over all sentences that are cases; greatest weight for a hundred words of a sentence by category."""
    total, most = dict.fromkeys(CATEGORIES, 0.0), dict.fromkeys(CATEGORIES, 0.0)
    if not text:
        return 0, total, most
    lex = lexicon()
    text = fold(text)
    tokens = TOKEN.findall(text)
    if not lex.may_hold(tokens, text):
        return len(tokens), total, most
    n, group_before = 0, False
    for s in SENTENCE.split(text):
        tokens = [t if t in lex.words else lex.reading(t) for t in TOKEN.findall(APART.sub(lex.join, s))]
        if not tokens:
            continue
        n += len(tokens)
        if lex.telling.isdisjoint(tokens) and not any("*" in t for t in tokens):
            group_before = False
            continue
        group_here = False
        sums = dict.fromkeys(CATEGORIES, 0.0)
        for i in range(0, max(1, len(tokens) - STRETCH_WORDS // 2), STRETCH_WORDS // 2):
            weights, group = lex.weigh(tokens[i : i + STRETCH_WORDS])
            group_here |= group
            if not weights:
                continue
            weak = weights.pop("weak")
            if group or group_before:
                weights["hateful"] += 0.5 if weights["hateful"] else 0.0
            else:
                weights["hateful"] -= weak * (1.0 - UNNAMED)
            for c in CATEGORIES:
                sums[c] = max(sums[c], weights[c])
        for c in CATEGORIES:
            density = 100.0 * sums[c] / STRETCH_WORDS
            most[c] = max(most[c], density)
            if density >= THRESHOLD:
                total[c] += sums[c]
        group_before = group_here
    return n, total, most


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, keep..., n_words`` and for each category its score (weight for 100 words) and whether it is a case (``is_...``).

    One row for each row of ``docs``; null, empty and blank texts score 0 and are no case.
    """
    schema = "n_words int, " + ", ".join(f"{c} double, is_{c} boolean" for c in CATEGORIES)

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, total, most = score(t)
            row: dict = {"n_words": n}
            for c in CATEGORIES:
                row[c] = 100.0 * total[c] / n if n else 0.0
                row[f"is_{c}"] = most[c] >= THRESHOLD
            rows.append(row)
        return pd.DataFrame(rows, columns=["n_words", *(x for c in CATEGORIES for x in (c, f"is_{c}"))])

    out = spread(docs.select(id_col, *keep, text_col)).select(id_col, *keep, judge(text_col).alias("__j"))
    return out.select(id_col, *keep, "__j.*")


def cases(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, category``: one row for each document and category that it is a case of."""
    named: list[Column] = [F.when(F.col(f"is_{c}"), F.lit(c)) for c in CATEGORIES]
    return scored.select(id_col, F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("category"))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``source, documents, abusive_rate, hateful_rate, sexual_rate, any_rate``: counted map-side, so that a hot source costs no more than others. Null is a source."""
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    any_case = F.col("is_abusive") | F.col("is_hateful") | F.col("is_sexual")
    return scored.groupBy(source).agg(F.count("*").alias("documents"), *[share(F.col(f"is_{c}")).alias(f"{c}_rate") for c in CATEGORIES], share(any_case).alias("any_rate"))
