import random

from weft.llm import substring
from weft.llm.common import word_hashes, words_at


def passage(r, n):
    out = []
    while n > 0:
        k = min(n, r.randint(4, 14))
        out.append(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def test_parts_are_the_text():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("ab .!?\n)é") for _ in range(r.randint(0, 80))) + " ".join("w%d" % r.randint(0, 9) for _ in range(r.randint(0, 60)))
        s = substring.Sentences(t.encode())
        assert s.words.sum() == len(t.split())
        assert s.without([])[0] == t.encode() or not t.split()
        for i in range(len(s.runs())):
            kept, gone = s.without([i])
            assert len(kept.split()) == len(t.split()) - (s.words[i : s.ends()[i]].sum() if gone else 0)


def plain_runs(t):
    """Word tuples of the runs, by a plain reading of the rule."""
    lines = t.split("\n")
    words = [(w, w[-1] in ".!?" or len(w) > 1 and w[-1] in "\"')]" and w[-2] in ".!?" or i == len(l.split()) - 1) for l in lines for i, w in enumerate(l.split())]
    parts, now = [], []
    for w, end in words:
        now.append(w)
        if end:
            parts.append(now)
            now = []
    cut = []
    for p in parts:
        if len(p) <= substring.LONG:
            cut.append(p)
            continue
        now = []
        for w in p:
            now.append(w)
            if int(word_hashes(w.encode())[0]) % substring.CUT == 0:
                cut.append(now)
                now = []
        cut += [now] if now else []
    out = []
    for i in range(len(cut)):
        j = i
        while j < len(cut) and (j - i < substring.RUN or sum(map(len, cut[i:j])) < substring.RUN_WORDS):
            j += 1
        if j - i >= substring.RUN and sum(map(len, cut[i:j])) >= substring.RUN_WORDS:
            out.append(tuple(w.lower() for p in cut[i:j] for w in p))
    return out or ([tuple(w.lower() for p in cut for w in p)] if cut else [])


def test_runs_by_the_rule():
    r, seen = random.Random(5), {}
    for _ in range(300):
        t = " ".join(r.choice(["a", "B", "c.", "d!", "e?)", "f\n", "gé", "h'"]) for _ in range(r.randint(0, 60)))
        got, expected = substring.Sentences(t.encode()).runs().tolist(), plain_runs(t)
        assert len(got) == len(expected), t
        for h, w in zip(got, expected):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def cut(spark, rows, schema="doc_id long, text string"):
    return substring.remove_repeats(spark.createDataFrame(rows, schema)).collect()


def brute(rows):
    """Texts after the removal, from all runs in one dictionary."""
    places, hashes = {}, {}
    for d, t in rows:
        for y, x in enumerate(substring.Sentences(t.encode()).runs().tolist() if t else []):
            places.setdefault(x, []).append((d, y))
            hashes[d, y] = x
    out = {}
    for d, t in rows:
        starts = [y for (e, y), x in hashes.items() if e == d and len({p[0] for p in places[x]}) > 1 and min(places[x]) != (d, y)]
        out[d] = substring.Sentences(t.encode()).without(starts)[0].decode() if t and starts else t
    return out


def test_passages_go_but_once(spark):
    r = random.Random(2)
    common, rows = passage(r, 60), []
    for i in range(30):
        text = passage(r, 80)
        if i % 3 == 0:
            at = r.randrange(len(text))
            text = text[: text.find(" ", at) + 1] + common + " " + text[text.find(" ", at) + 1 :]
        rows.append((i, text))
    got = {x.doc_id: x for x in cut(spark, rows)}
    tail = " ".join(common.split()[20:45])
    assert [i for i in got if tail in got[i].text] == [0]
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t in rows if i % 3)
    assert {i: x.text for i, x in got.items()} == brute(rows)


def test_odd_rows(spark):
    t = passage(random.Random(3), 70)
    rows = [(1, None, 0), (2, "", 1), (None, t, 2), (5, t, 3), (5, t, 4), (6, "short. Same. Short.", 5), (7, "short. Same. Short.", 6)]
    got = {x["n_removed"]: x for x in cut(spark, rows, "doc_id long, text string, n_removed int")}
    assert got[0].text is None and got[1].text == "" and got[2].text == t
    assert got[3].text == got[4].text == "" and got[3]["n_removed_"] > 0
    assert got[6].text == "short. Same. Short."


def test_repeats_within_one_document_stay(spark):
    t = passage(random.Random(4), 40)
    assert [x.text for x in cut(spark, [(1, f"{t} {t}")])] == [f"{t} {t}"]


def test_empty_table(spark):
    assert cut(spark, []) == []
    assert substring.cut_repeats(spark.createDataFrame([], "doc_id long, text string, n_chars long, starts_ int")).columns == ["doc_id", "text", "n_chars", "starts_"]


def test_blocks_of_long_texts(monkeypatch):
    from weft.llm import common

    r = random.Random(6)
    texts = [" ".join("x" * r.choice([1, 3, 9, 200]) for _ in range(60)).encode() + b" " * r.randint(0, 3) for _ in range(60)]
    whole = [words_at(t) for t in texts]
    monkeypatch.setattr(common, "_BLOCK", 250)
    for t, (a, b, h) in zip(texts, whole):
        x, y, g = words_at(t)
        assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and g.tolist() == h.tolist()


def hosted(r, words, kind):
    """The words in the middle of others, in sentences of 3 to 40 words (kind 0), lines of these (1) or none (2)."""
    out = []
    for _ in range(2):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(30, 90))]
        at = 0
        while kind < 2 and at + 1 < len(w):
            at = min(len(w) - 1, at + r.randint(3, 40))
            w[at - 1] += "." if kind == 0 else "\n"
        out.append(" ".join(w))
    return f"{out[0]} {' '.join(words)} {out[1]}"


def removed(first, second):
    """Words that the second text loses, given the first."""
    a, b = substring.Sentences(first.encode()), substring.Sentences(second.encode())
    have = {*a.runs().tolist(), *a.spans()[1].tolist()}
    starts = [i for i, h in enumerate(b.runs().tolist()) if h in have] + [-1 - i for i, h in zip(*map(list, b.spans())) if int(h) in have]
    kept, gone = b.without(starts)
    return len(second.split()) - len(kept.split()) if gone else 0


def test_every_passage_of_51_words_is_found():
    r = random.Random(7)
    for k in range(1500):
        words = hosted(r, [], k % 3).split(" ")
        at = r.randrange(len(words) - 51)
        words = words[at : at + 51]
        a, b = hosted(r, words, r.randrange(3)), hosted(r, words, r.randrange(3))
        assert 14 <= removed(a, b) <= 51, (a, b)
        if k % 3 == 2:
            assert removed(hosted(r, words, 2), hosted(r, words, 2)) >= 25
    for words in (["la"] * 51, ["la", "di"] * 26, ["x"] * 20 + ["y"] * 31):
        assert removed(hosted(r, words, 2), hosted(r, words, 2)) >= 25


def test_short_ends_of_a_passage_count():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for _ in range(50):
        w = [word() for _ in range(51)]
        w[14], w[24], w[34] = w[14] + ".", w[24] + ".", w[34] + "."
        alone, within = f"Yes. {' '.join(w)}. Yes.", f"{' '.join(word() for _ in range(20))} {' '.join(w)} {' '.join(word() for _ in range(20))}"
        assert removed(within, alone) >= 20 and removed(alone, within) >= 20


def test_spans_of_words_that_repeat_are_few():
    at, h = substring.Sentences(b"la " * 5000).spans()
    assert len(at) < 1000 and len(set(h.tolist())) == 1 and max(at[1:] - at[:-1]) <= substring.SPAN_WORDS


def test_passages_in_mid_sentence_go(spark):
    r = random.Random(9)
    words = [["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(51)] for _ in range(60)]
    rows = [(2 * i + j, hosted(r, w, 2)) for i, w in enumerate(words) for j in (0, 1)]
    got = {x.doc_id: x for x in cut(spark, rows)}
    assert all(got[d].text == t if d % 2 == 0 else len(t.split()) - len(got[d].text.split()) >= 25 for d, t in rows)


def test_rows_that_share_an_id_are_documents(spark):
    r = random.Random(10)
    words, other = [["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)] for _ in range(2)]
    for d in (1, None):
        rows = [(d, hosted(r, words, 2)) for _ in range(3)] + [(7, hosted(r, other, 2)), (8, hosted(r, other, 2))]
        got = cut(spark, rows)
        assert sum(x.n_removed > 0 for x in got if x.doc_id == d) == 2 and [x.n_removed > 0 for x in sorted(got, key=lambda x: x.doc_id or 0) if x.doc_id in (7, 8)] == [False, True]


def test_repeats_within_a_document_go_where_asked(spark):
    r = random.Random(11)
    words = lambda n: [r.choice("abcdefghij") + "".join(r.choice("klmno") for _ in range(5)) for _ in range(n)]
    page, one = " ".join(words(40)) + ".", passage(r, 60)
    rows = [(1, f"{one} {page} {page} {page}"), (2, one.upper()), (2, one), (3, "a b. c d. " * 3), (4, "alone here."), (4, "alone here.")]
    got = {(x.doc_id, t): x.text for (_, t), x in zip(sorted(rows), sorted(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), within=True).collect(), key=lambda x: (x.doc_id, -len(x.text)))) if x.doc_id != 2}
    first = next(v for k, v in got.items() if k[0] == 1)
    assert first.count(page.split()[20]) == 1 and one in first
    assert [v for k, v in got.items() if k[0] == 3] == ["a b. c d. " * 3] and [v for k, v in got.items() if k[0] == 4] == ["alone here."]


def oracle(rows, least):
    """Places (doc, sentence) that go, by word tuples instead of hashes and by a plain loop; sentences as short_text has them."""
    parts = {d: [p.split() for p in t.replace(".", ".\x00").replace("\n", "\x00").split("\x00") if p.split()] for d, t in rows}
    seen, gone = set(), set()
    for d in sorted(parts):
        s = parts[d]
        for i in range(len(s)):
            j = i
            while j < len(s) and (j - i < substring.RUN or sum(map(len, s[i:j])) < substring.RUN_WORDS):
                j += 1
            if j - i < substring.RUN or sum(map(len, s[i:j])) < substring.RUN_WORDS:
                continue
            key = tuple(w.lower() for p in s[i:j] for w in p)
            if key in seen:
                gone |= {(d, k) for k in range(i, j)}
            seen.add(key)
    for d, s in parts.items():
        i = 0
        while i < len(s):
            j = i
            while j < len(s) and (d, j) in gone:
                j += 1
            if j > i and sum(map(len, s[i:j])) < least:
                gone -= {(d, k) for k in range(i, j)}
            i = max(j, i + 1)
    return {d: [w for k, p in enumerate(s) if (d, k) not in gone for w in p] for d, s in parts.items()}


def test_every_repeated_run_against_plain_words(spark):
    """Short sentences from a small stock, so runs repeat within and across documents; every one but the first goes."""
    r = random.Random(12)
    stock = [" ".join(r.choice("abcdef") for _ in range(r.randint(3, 9))).capitalize() + r.choice([".", "\n"]) for _ in range(40)]
    rows = [(d, " ".join(r.choice(stock) for _ in range(r.randint(2, 14)))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text.split() for x in substring.remove_repeats(df, within=True, least_words=0).collect()}
    assert got == oracle(rows, 0)
