import base64
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import tokens


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_match_an_independent_encoder(reference):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "漢字", "🙂", "'s", "'ll", "12", "_", "()", "\x1c", " ", "​", "<|endoftext|>", "ß", "İ", "x" * 40, "=" * 30]
    e = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert e.encode(t) == reference.encode_ordinary(t), repr(t)


def test_long_piece_without_blank(reference):
    t = "ab" * 20_000 + "z" * 5_000
    assert tokens.encoder(tokens.DEFAULT_VOCABULARY).encode(t) == reference.encode_ordinary(t)


def test_null_empty_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got) == 4 and got[2][1]
    assert tokens.encode_corpus(df.where("false")).count() == 0
    assert dict(tokens.encode_corpus(df).dtypes)["ids"] == "array<int>"


def test_round_trip(spark):
    e = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    back = {v: k for k, v in e.ranks.items()}
    for t in ("naïve café — Ω", "tabs\tand\r\nlines", "\x00\x1f"):
        assert b"".join(back[i] for i in e.encode(t)).decode() == t
