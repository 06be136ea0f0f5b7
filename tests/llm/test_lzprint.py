import hashlib
import random

import pytest

from weft.llm import lzprint


def plain_parse(t):
    held, ends, i = set(), [], 0
    for j in range(1, len(t) + 1):
        if t[i:j] not in held:
            held.add(t[i:j])
            ends.append(j)
            i = j
    return ends + ([len(t)] if i < len(t) else [])


def test_parse():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(r.choice(["ab", "abcdé😀", "a"])) for _ in range(r.randint(0, 120)))
        assert lzprint.parse(t) == plain_parse(t)


def test_edited_parse_goes_on():
    r = random.Random(2)
    for _ in range(300):
        t, o = ("".join(r.choice("abcé") for _ in range(r.randint(0, 90))) for _ in range(2))
        new, cut = lzprint.edited(t, o)
        assert lzprint.of_edited(t, lzprint.parse(t), new, cut).tolist() == lzprint.signature(new, lzprint.parse(new)).tolist()


def test_signature_keeps_the_smallest():
    t = "".join(random.Random(3).choice("abcdefgh") for _ in range(9000))
    ends = lzprint.parse(t)
    import numpy as np

    whole, lzprint.KEPT = lzprint.KEPT, 10**9
    try:
        every = lzprint.signature(t, ends)
    finally:
        lzprint.KEPT = whole
    assert lzprint.signature(t, ends).tolist() == np.sort(every)[: lzprint.KEPT].tolist()


def brute(rows):
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    sign = lambda t: lzprint.signature(t, lzprint.parse(t))
    for (d, t), (_, o) in zip(order, [*order[1:], order[0]]):
        t, o = t or "", o or ""
        e, _ = lzprint.edited(t, o)
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), lzprint.text_form(sign(t)), lzprint.text_form(sign(e)), lzprint.likeness(sign(t), sign(e)), lzprint.likeness(sign(t), sign(o)))
    return out


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(lzprint, "RANGE_ROWS", 10)
    r = random.Random(4)
    rows = [(i * 3, r.choice([None, "", "x", "same text here", "".join(r.choice("abcdé ") for _ in range(r.randint(1, 400)))])) for i in range(150)]
    got = {x.doc_id: tuple(x)[1:] for x in lzprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k][:4] == expected[k][:4] and got[k][4:] == pytest.approx(expected[k][4:])


def test_odd_rows(spark):
    one = lzprint.fingerprints(spark.createDataFrame([(1, "abc" * 9)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert lzprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(2, "same")] * 5 + [(2, "other")] * 3 + [(None, "same")] * 4
    got = lzprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and len({x.fingerprint for x in got}) == 2
