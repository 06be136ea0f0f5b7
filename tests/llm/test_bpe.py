import base64
import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken

from weft.llm import bpe, tokencount

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_small_leaves_agree(raw, reference):
    r = random.Random(1)
    for chars, size in ((8, 4), (3, 2), (20, 9)):
        codec = bpe.Codec(raw, tokenizers.PATTERN, chars, size)
        for _ in range(400):
            letters = r.choice([" '\n strel", "abcdefghij ", "'sStrevllm d ", " \t\n\r x", "éèàß öü'll 12", "аб 漢字😀  　 x9"])
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 90)))
            ids = np.frombuffer(codec.encode(t), "<u4").tolist()
            assert ids == reference.encode_ordinary(t), t
            assert codec.decode(ids) == t.encode()


def test_long_pieces(raw, reference):
    codec = bpe.Codec(raw, tokenizers.PATTERN)
    for t in ("a" * 20000, " " * 9000 + "x", "ab" * 9000, "." * 9000, "😀" * 3000):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_rows(spark, reference):
    texts = [None, "", "Hello world's", "Hello world's", "  x\n" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "ids long, text string")
    out = {r["ids"]: r for r in bpe.encode(docs, PATH, tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_"] == ids.tobytes()
        assert out[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, tokenizers.PATTERN).collect() == []


def test_attribution():
    ends, cuts = np.array([3, 4, 9, 10]), np.array([4, 6, 10])
    assert tokencount.attribute(ends, cuts).tolist() == [2, 0, 2]  # bytes 4-9: two in the second section, three in the third
    assert tokencount.attribute(np.array([4]), np.array([2, 4])).tolist() == [1, 0]


def test_token_counts(spark, reference):
    texts = [None, "", "one line", "a b\n\nc d e\n", "x\n" * 3000, "é\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = tokencount.count_tokens(docs, PATH, tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        own = sorted((r.section, r.start, r.end, r.n_tokens, r.doc_tokens) for r in rows if r.doc_id == i)
        n = len(reference.encode_ordinary(t or ""))
        assert sum(x[3] for x in own) == n and all(x[4] == n for x in own)
        assert [x[0] for x in own] == list(range(len(own))) and own[-1][2] == len((t or "").encode())
