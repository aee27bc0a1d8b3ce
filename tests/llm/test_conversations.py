import random
import unicodedata  # noqa: F401
from datetime import UTC, datetime

import pytest

from strandline.llm import conversations as cv

MESSAGES = "conversation_id string, role string, request_id string, content_summary string, content_hash string, created_at string, id string, reason string"
CONVERSATIONS = "id string, title string, reason string"
ROLE = {"user": "user", "Human ": "user", "ASSISTANT": "assistant", "ai": "assistant", "System": "system", "moderator": None, None: None, "": None}
BASE = 1_767_600_000_000


def stamp(ms, style):
    if ms is None:
        return random.Random(style).choice([None, "", "yesterday", "2026-13-41T99:00:00Z", "0000-00-00 00:00:00", "2026-02-30 10:00:00"])
    t = datetime.fromtimestamp(ms / 1000, UTC)
    if style == 0:
        return str(ms)
    if style == 1:
        return t.strftime("%Y-%m-%d %H:%M:%S.") + f"{ms % 1000:03d}"
    if style == 2:
        return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"
    return datetime.fromtimestamp((ms - 8 * 3_600_000) / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}-08:00"


def brute(messages, known):
    merged = {}
    ids = set(known)
    for c, role, req, text, h, ms in messages:
        if c is None:
            continue
        ids.add(c)
        if text is None or not text.strip():
            continue
        k = (c, ROLE[role], req, h)
        old = merged.get(k, None)
        merged[k] = ms if old is None else (old if ms is None else min(old, ms))
    out = {}
    for c in ids - {None}:
        rows = [(k[1], t) for k, t in merged.items() if k[0] == c]
        turns = [r for r in rows if r[0] != "system"]
        if not turns:
            out[c] = "empty"
            continue
        if c not in known or any(r is None or t is None for r, t in rows):
            out[c] = "broken"
            continue
        seq = [r for r, t in sorted(turns, key=lambda x: (x[1], x[0] == "assistant"))]
        if seq[0] == "assistant" or any(a == b == "assistant" for a, b in zip(seq, seq[1:], strict=False)):
            out[c] = "broken"
        elif any(a == "user" and b != "assistant" for a, b in zip(seq, [*seq[1:], None], strict=True)):
            out[c] = "no_reply"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rejected_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    plain, rows = [], []
    for c in [*(f"c{i}" for i in range(60)), None]:
        t = BASE
        for i in range(rng.choice([0, 1, 2, 2, 4, 6])):
            t += rng.choice([0, 1000, 3_600_000 * rng.randint(0, 3)])
            role = rng.choice(list(ROLE)) if rng.random() < 0.1 else ("user" if i % 2 == 0 else "ai")
            text = rng.choice([None, "", "  \n"]) if rng.random() < 0.08 else "words"
            ms = None if rng.random() < 0.03 else t
            m = (c, role, f"r{i // 2}", text, f"h{i}", ms)
            for _ in range(rng.choice([1, 1, 2])):
                plain.append(m)
                rows.append((c, role, f"r{i // 2}", text, f"h{i}", stamp(ms, rng.randint(0, 3)), f"{c}{i}", "x"))
    known = {f"c{i}" for i in range(60) if rng.random() < 0.9} | {"alone"}
    conv = [(k, None, "x") for k in known] * 2 + [(None, "t", "x")]
    got = cv.rejected(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(conv, CONVERSATIONS))
    assert got.columns == ["conversation_id", "reason"]
    assert {r.conversation_id: r.reason for r in got.collect()} == brute(plain, known)


def test_empty_tables(spark):
    m, c = spark.createDataFrame([], MESSAGES), spark.createDataFrame([], CONVERSATIONS)
    assert cv.rejected(m, c).count() == 0 and cv.assemble(m, c).count() == 0 and cv.clock_offsets(cv.read_messages(m)).count() == 0


def skewed(spark, a):
    """Two requests; the assistant's clock is ``a`` ms off."""
    rows = [("c", "user", "r1", "q", "1", str(BASE), "1", ""), ("c", "ai", "r1", "a", "2", str(BASE + 1000 + a), "2", ""), ("c", "user", "r2", "q", "3", str(BASE + 5000), "3", ""), ("c", "ai", "r2", "a", "4", str(BASE + 6000 + a), "4", "")]
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([("c", "", "")], CONVERSATIONS)


def test_clock_offset_is_the_least_that_is_feasible(spark):
    m, c = skewed(spark, 0)
    o = cv.clock_offsets(cv.read_messages(m)).first()
    assert o.feasible and o.offset_ms == 0 and o.pairs == 2
    m, c = skewed(spark, -3000)
    o = cv.clock_offsets(cv.read_messages(m)).first()
    assert o.feasible and o.offset_ms == 2000
    assert cv.rejected(m, c).first().reason == "broken", "two pairs are no evidence about a clock"
    assert cv.rejected(m, c, least_pairs=1).count() == 0
    turns = cv.assemble(m, c, least_pairs=1).orderBy("turn").collect()
    assert [(r.turn, r.role) for r in turns] == [(1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")]
    m, c = skewed(spark, 5500)
    o = cv.clock_offsets(cv.read_messages(m)).first()
    assert o.feasible and o.offset_ms == -1500


def test_a_senders_clock_is_judged_by_all_its_conversations(spark):
    """In workspace w the assistant's clock is three seconds late in all conversations, in v only that of one conversation is."""
    rows, known = [], []
    for w in "wv":
        for i in range(12):
            c, a = f"{w}{i}", -3000 if w == "w" or i == 0 else 0
            known.append((c, w))
            for k, (role, ms) in enumerate([("user", 0), ("ai", 1000 + a), ("user", 5000), ("ai", 6000 + a)]):
                rows.append((c, role, f"r{k // 2}", "t", str(k), str(BASE + ms), f"{c}{k}", ""))
    m, c = spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([*known, *known], "id string, workspace_id string")
    got = {r.sender: (r.pairs, r.offset_ms) for r in cv.sender_offsets(cv.read_messages(m), c).collect()}
    assert got == {"w": (24, 2000), "v": (24, 0)}
    assert [(r.conversation_id, r.reason) for r in cv.rejected(m, c).collect()] == [("v0", "broken")]
    assert cv.assemble(m, c).groupBy("conversation_id").count().where("count = 4").count() == 23


def test_turns_cross_hours(spark):
    rows = [("c", "user" if i % 2 == 0 else "ai", f"r{i // 2}", f"t{i}", f"h{i}", str(BASE + i * 2_000_000), str(i), "") for i in range(20)]
    random.Random(1).shuffle(rows)
    got = cv.assemble(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([("c", "", "")], CONVERSATIONS)).orderBy("turn").collect()
    assert [r.content for r in got] == [f"t{i}" for i in range(20)] and [r.turn for r in got] == list(range(1, 21))
