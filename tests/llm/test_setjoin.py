import random

from weft.llm import setjoin
from weft.llm.components import components

SCHEMA = "doc_id long, text string"


def brute(rows):
    """n_shingles and component of each row, by all pairs of sets."""
    def words(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x1c", "\x1c").encode().split()

    def shingle_set(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d is None, d or 0, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(spark, rows):
    got = setjoin.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got)


def corpus(seed, groups=((60, 40, 9), (30, 25, 6), (80, 3, 8)), alone=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéABC") for _ in range(r.randint(1, 7)))
    texts = []
    for size, copies, edits in groups:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n", "\t "]).join(w))
    texts += [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(alone)]
    shared = [word() for _ in range(30)]
    texts += [" ".join(shared + [word() for _ in range(r.randint(0, 60))]) for _ in range(25)]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(spark, rows) == brute(rows)


def test_blocks_and_rare_order(spark, monkeypatch):
    """The same result with tiny blocks, with every token rare, and with long lists split."""
    rows = corpus(3, groups=((40, 60, 10),))
    expected = brute(rows)
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    assert result(spark, rows) == expected
    monkeypatch.setattr(setjoin, "HOT_LEAST", 10**9)
    assert result(spark, rows) == expected


def test_split_lists(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_MOST", 9)
    for seed, groups in ((4, ((40, 60, 10), (30, 20, 5))), (5, ((12, 80, 3),))):
        rows = corpus(seed, groups=groups)
        assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (5, "ONE\ttwo"), (None, "one two"), (None, None), (7, "É"), (8, "é"), (9, "x " * 3000), (10, "x x x x x x"), (4, "other words")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(3, text, 1), (2, text + " more", 2), (9, "alone", 3), (None, text, 4), (5, None, 5)], "doc_id long, text string, gone int")
    assert sorted(r["gone"] for r in setjoin.keep_one(docs).collect()) == [2, 3, 4, 5]
    assert setjoin.keep_one(docs).columns == docs.columns


def test_keep_one_where_rows_share_an_id(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    rows = [(1, other, 1), (1, other, 2), (2, text, 3), (3, text + " more", 4), (3, "a text of its own", 5), (4, other + " more", 6), (4, other + " more", 7), (5, text + " less", 8), (5, text, 9)]
    assert sorted(r["gone"] for r in setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, gone int")).collect()) == [1, 3, 5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (100, 90)}


def test_words_that_sums_modulo_a_power_of_two_confuse(spark):
    """A Thue-Morse word and its complement agree in every polynomial sum modulo 2**64 with an odd base."""
    a, b = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1))
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, a.upper()), (6, f"{a} y"), (7, a * 200), (8, b * 200)]
    assert result(spark, rows) == brute(rows)


def test_mixed_groups_of_many_blocks(spark, monkeypatch):
    """Groups with one large component, several middling ones and single sets, dealt over many blocks."""
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    rows = corpus(8, groups=((40, 50, 2), (40, 20, 14), (24, 30, 9)), alone=10)
    assert result(spark, rows) == brute(rows)
