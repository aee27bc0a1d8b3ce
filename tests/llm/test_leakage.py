import random

import pytest

from strandline.llm import leakage as lk

ITEMS = "item_id long, question string, reference_answer string, doc_id string"
DOCS = "doc_id long, text string, item_id string"


def brute(docs, items, least):
    parts = [(i, f) for i, q, a, _ in items for f in {q, a} if f]
    words = [(i, lk.words(t)) for i, t in parts]
    joined = [(i, " " + " ".join(w) + " ") for i, w in words]
    out = set()
    for d, t, _ in docs:
        w = lk.words(t)
        doc = " " + " ".join(w) + " "
        for i, iw in words:
            for s in range(len(iw)):
                for e in range(s + least, len(iw) + 1):
                    p = " " + " ".join(iw[s:e]) + " "
                    if p in doc and not any(p in x for j, x in joined if j != i):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["aa", "bb", "cc", "dd", "ee"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = text(9)
    items = []
    for i in range(12):
        q = (shared if rng.random() < 0.6 else []) + text(rng.randint(0, 9))
        items.append((i, " ".join(q) if q else None, rng.choice([None, "", " ".join(text(10))]), "x"))
    items += items[:2]
    docs = [(100, None, "x"), (101, "", "x"), (102, "...", "x")]
    for d in range(40):
        src = lk.words(rng.choice(items)[1] or "")
        a = rng.randint(0, max(0, len(src) - 4))
        body = text(3) + src[a : a + rng.randint(3, 18)] + text(3)
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in body), "x"))
    docs += docs[:3]
    got = lk.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), least=6, seed_words=4)
    assert {(r.doc_id, r.item_id) for r in got.where("exact").collect()} == brute(docs, items, 6)


def test_alignment():
    item = "the quick brown fox jumps over the lazy dog today".split()
    doc = "well the quick red fox jumps over a the lazy dog today indeed".split()
    score, a, b = lk.align(doc, item)
    assert (doc[a], doc[b - 1]) == ("the", "today")
    assert score == 9 * lk.MATCH + lk.MISMATCH + lk.GAP
    assert lk.align([], item)[0] == 0 and lk.align(["x"], item)[0] == 0


@pytest.mark.parametrize("cells", [1, 200, 1_000_000])
def test_many_alignments_at_a_time(cells, monkeypatch):
    monkeypatch.setattr(lk, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(60)]
    items = [[rng.choice("abcdef") for _ in range(rng.randint(1, 25))] for _ in range(60)]
    assert lk.align_scores(docs, items).tolist() == [lk.align(d, i)[0] for d, i in zip(docs, items, strict=True)]
    assert lk.align_scores([], []).tolist() == []


@pytest.mark.parametrize("step", [5, 6, 8, 12])
def test_recall_of_seeds_and_of_counts_on_edited_copies(spark, step):
    """Every ``step``-th word of an item is replaced. Counting finds all copies with a share of a half; rare seeds those that keep one."""
    rng = random.Random(step)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40)), None, "x") for i in range(40)]
    docs = [(i, " ".join("zz" if k % step == step - 1 else w for k, w in enumerate(q.split())), "x") for i, q, _, _ in items]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    counted = lk.edited_copies(d, i).where("doc_id = item_id").count()
    seeded = lk.leaks(d, i, seed_words=5).where("doc_id = item_id and share >= 0.5").count()
    print("SEEDED", step, seeded)
    assert seeded <= counted == 40


def test_more_items_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(lk, "HELD_WORDS", 50)
    items = [(i, " ".join(f"v{i}x{k}" for k in range(30)), None, "x") for i in range(12)]
    docs = [(i, f"so {q} it is", "x") for i, q, _, _ in items]
    got = lk.edited_copies(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [(i, i, True) for i in range(12)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c", "")], DOCS), spark.createDataFrame([(1, "a b c", None, "")], ITEMS)
    assert lk.leaks(d.where("false"), i, least=2, seed_words=2).count() == 0
    assert lk.leaks(d, i.where("false"), least=2, seed_words=2).count() == 0
    assert lk.leaks(d, i, least=2, seed_words=2).where("exact").count() == 1


def test_documents_without_any_seed(spark):
    docs = spark.createDataFrame([(i, "nothing of the kind is said here", "") for i in range(40)], DOCS)
    items = spark.createDataFrame([(1, "one two three four five six seven", None, "")], ITEMS)
    assert lk.leaks(docs.repartition(4), items, least=4, seed_words=3).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(1, 30))), rng.choice([None, "", " ".join(text(3))]), "x") for i in range(30)]
    docs = [(900, None, "x"), (901, "", "x")]
    for d in range(120):
        w = list(lk.words(rng.choice(items)[1]))
        step = rng.choice([3, 4, 6, 7, 50])
        w = [x for i, x in enumerate(w) for x in ([x] if (i + 1) % step else rng.choice([["zz"], [], [x, "zz"]]))]
        docs.append((d, " ".join(text(4) + w + text(4)), "x"))
    docs += docs[:5]
    want = set()
    for d, t, _ in docs:
        for i, q, a, _ in items:
            for f, x in (("question", q), ("reference_answer", a)):
                w = lk.words(x)
                if w and t is not None and (score := lk.align(lk.words(t), w)[0]) >= len(w):
                    want.add((d, i, f, score))
    got = lk.edited_copies(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id, r.field, r.score) for r in got.collect()} == want
    old = lk.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), seed_words=5).where("share >= 0.5")
    assert {(r.doc_id, r.item_id, r.field, r.score) for r in old.collect()} < want


def test_edited_copies_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b c", "")], DOCS), spark.createDataFrame([(1, "a b c", None, "")], ITEMS)
    assert lk.edited_copies(d.where("false"), i).count() == 0 and lk.edited_copies(d, i.where("false")).count() == 0
    assert [(r.score, r.exact) for r in lk.edited_copies(d, i, least=2).collect()] == [(6, True)]
