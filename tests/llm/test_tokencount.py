"""Token counts against tiktoken and a byte-by-byte attribution."""

import random

import public_tokenizers as tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from weft.llm import tokencount

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(PATH), special_tokens={})


def plain(encoding, parts):
    """Tokens of each part of a text: that with most of a token's bytes has it, the first of equals."""
    text = "".join(parts)
    owner = [i for i, p in enumerate(parts) for _ in p.encode()]
    counts, at = [0] * len(parts), 0
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        mine = owner[at : at + n]
        counts[max(sorted(set(mine)), key=mine.count)] += 1
        at += n
    return counts


def lines(t):
    return [x for x in t.replace("\n", "\n\x00").split("\x00") if x] if t else [""]


def test_lines(spark, whole):
    r = random.Random(1)
    texts = ["".join(r.choice(["the ", "Haus", "\n", "\n\n", "  ", "é", "😀", "a\n  b", "12 "]) for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "", "\n", "word " * 30_000, "same", "same"]
    rows = [(None if i == 3 else i // 2, t, 7) for i, t in enumerate(texts)]
    got = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, tokenizers.PATTERN).collect()
    expected = [(d, i, n) for d, t, _ in rows for i, n in enumerate(plain(whole, lines(t)))]
    key = lambda x: (x[0] is not None, x)
    assert sorted(((x.doc_id, x.section, x.n_tokens) for x in got), key=key) == sorted(expected, key=key)


def test_fields(spark, whole):
    r = random.Random(2)
    word = lambda: r.choice([None, "", "Title", "a title ", "é\n", " more text", "x" * r.randint(1, 9)])
    rows = [(i, word(), word(), word()) for i in range(60)]
    got = tokencount.count_fields(spark.createDataFrame(rows, "doc_id long, title string, field string, body string"), ["title", "field", "body"], PATH, tokenizers.PATTERN).collect()
    expected = [(d, f, n) for d, a, b, c in rows for f, n in zip(("title", "field", "body"), plain(whole, [(a or "") + "\n", (b or "") + "\n", c or ""]))]
    assert sorted((x.doc_id, x.field, x.n_tokens) for x in got) == sorted(expected)


def test_empty_table(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, tokenizers.PATTERN).collect() == []
    assert tokencount.count_fields(spark.createDataFrame([], "doc_id long, a string"), ["a"], PATH, tokenizers.PATTERN).collect() == []
