import random
import re

import pytest

from strandline.llm import splitting as sp


def check(text, kind, limit, overlap):
    out = sp.split(text, kind, limit, overlap)
    end = 0
    for i, (a, b, level, t) in enumerate(out):
        assert t == text[a:b] and 0 < len(t) <= limit
        assert a <= end, "nothing is lost"
        assert b > end or i == 0
        if i:
            assert end - a <= min(overlap, limit // 2)
        end = b
    assert end == len(text)
    longest = max((len(w) for w in re.split(r"\s+", text)), default=0)
    assert any(level == sp.CHARACTER for _, _, level, _ in out) == (longest > limit)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(seed):
    rng = random.Random(seed)
    parts = ["word", "another", " ", "\n", "\n\n", ". ", "# Head\n", "é漢", "\r\n", "x" * rng.choice([5, 40, 90, 300]), "　", " ", "- item\n", "def f():\n"]
    text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
    limit = rng.choice([10, 37, 80])
    check(text, rng.choice(["doc", "symbol"]), limit, rng.choice([0, 3, limit // 4, limit]))


def test_overlap_and_boundaries():
    text = "\n\n".join("Sentence number %d is here. And one more." % i for i in range(40))
    out = check(text, "doc", 200, 30)
    assert all(text[b - 1].isspace() for _, b, _, _ in out[:-1])
    for (_, b, _, _), (a, _, _, _) in zip(out, out[1:], strict=False):
        assert 0 < b - a <= 30 and text[a - 1].isspace()


def test_long_word_and_long_blank():
    check("a" * 1000, "doc", 64, 8)
    check("b" + " " * 500 + "c", "doc", 64, 8)
    check("w" * 60 + " " + "v" * 63, "symbol", 64, 16)


def test_tables(spark):
    limits = spark.createDataFrame([("doc", 20, 4), ("doc", 20, 4), ("symbol", None, 1)], "item_type string, max_chars int, overlap_chars int")
    rows = [("doc", "a", "x" * 21), ("doc", "a", "x" * 21), ("doc", "b", "one two three four five six"), ("doc", "c", "x" * 20), ("doc", "d", None), ("doc", "e", ""), ("symbol", "s", "y" * 99), (None, "n", "z" * 99)]
    items = spark.createDataFrame([(*r, 1) for r in rows], "item_type string, item_id string, text string, max_chars int")
    got = {(r.item_id, r.cut) for r in sp.cuts(items, limits).collect()}
    assert got == {("a", "hard"), ("b", "natural")}
    p = sp.pieces(items, limits).collect()
    assert {r.item_id for r in p} == {"a", "b", "c", "s", "n"} and all(len(r.text) <= 20 for r in p if r.item_type == "doc")
    assert sp.cuts(items.where("false"), limits).count() == 0 and sp.pieces(items.where("false"), limits).count() == 0
