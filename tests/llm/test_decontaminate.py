import hashlib
import random
import re

from weft.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((d is None, d or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


def result(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contained(d, b).collect())


def made(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "cé", "É", "é", "x9", "the", "OF", "z"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 8, 9, 20]))) for i in range(15)]
    docs = []
    for i in range(40):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            t += " " + r.choice(items)[1].upper().replace("É", "é")
        docs.append((i, t))
    return docs, items


def test_against_all_windows(spark):
    docs, items = made(1)
    assert result(spark, docs, items) == brute(docs, items)


def test_shuffled_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, items = made(2)
    assert result(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, "..."), (None, "four five"), (4, "three")]
    docs = [(1, None), (2, ""), (3, "One, two-three!"), (3, "One, two-three!"), (None, "three"), (4, "four five"), (5, "w " * 5000 + "one two three")]
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made(3)
    assert result(spark, [], items) == []
    assert result(spark, docs, []) == brute(docs, [])


def test_remove(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"Before {item} after", 1), (2, "clean text", 2), (3, "one two", 3), (None, None, 4)], "doc_id long, text string, gone int")
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, item), (2, "two")], "item_id long, text string"))
    assert sorted(r["gone"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns


def test_hits_of_one_short_item_do_not_condemn(spark):
    docs = spark.createDataFrame([(1, "red fox " + "then red fox " * 7), (2, "so on " * 20 + "one two three four five six seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red fox"), (2, "one two three four five six seven eight")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()] == [1]


def test_rows_without_an_id_are_judged_by_text(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(None, item, "a"), (None, "clean text", "b"), (1, "clean as well", "c"), (1, item, "d"), (1, item, "e"), (None, None, "f")], "doc_id long, text string, th_ string")
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["th_"] for r in kept.collect()) == ["b", "c", "f"] and kept.columns == docs.columns
