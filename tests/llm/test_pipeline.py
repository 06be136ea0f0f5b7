import random

import corpus_pipeline
from weft.llm import registry


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    item, passage = " ".join(word() for _ in range(20)), text(8)
    docs = [(i, text(12), "en", "s", 0) for i in range(120)]
    docs += [(200 + i, " ".join(word() + "%%%" for _ in range(100)), "en", "s", 0) for i in range(40)]
    docs += [(300, docs[0][1], "en", "s", 0), (301, docs[1][1] + " tail", "en", "s", 0), (302, text(9) + " " + item, "en", "s", 0), (303, text(9) + " " + passage, "en", "s", 0), (304, text(9) + " " + passage, "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in docs if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    held, frame = {}, spark.read.parquet(f"{d}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, d)
        frame.write.parquet(f"{d}/{name}")
        frame = spark.read.parquet(f"{d}/{name}")
        held[name] = {x.doc_id: x for x in frame.collect()}
        if name != "encoding":
            assert frame.columns == columns
    good = set(range(120))
    assert good <= set(held["quality_filter"]) and not set(range(200, 240)) & set(held["quality_filter"])
    assert good <= set(held["near_duplicates"]) and not {300, 301} & set(held["near_duplicates"])
    assert passage[30:] in held["substring_dedup"][303].text and passage[100:] not in held["substring_dedup"][304].text
    assert 302 not in held["decontamination"] and good <= set(held["decontamination"])
    assert set(held["encoding"]) == set(held["decontamination"])
    assert {x.doc_id for x in corpus_pipeline.run(spark, d).collect()} == set(held["encoding"])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def _tables(spark, d, docs, labels, benchmark):
    spark.createDataFrame(docs, "doc_id long, text string, gone string, th string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet")


def test_empty_tables(spark, tmp_path):
    docs = _tables(spark, str(tmp_path), [], [], [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == [] and (name == "encoding" or out.columns == docs.columns)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty, long and repeated texts, repeated rows and ids, and columns with clashing names, stage by stage."""
    r = random.Random(4)
    sentence = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(9)) + ". "
    plain, long_, item = "".join(sentence() for _ in range(6)), "".join(sentence() for _ in range(2000)), sentence()
    repeated = "".join(sentence() for _ in range(6))
    docs = [
        (1, plain, "a", "x", 0), (1, plain, "a", "x", 0), (2, plain, "b", "x", 0), (None, plain, "c", None, 0), (3, None, "d", "x", None), (None, None, "e", "x", 0), (4, "", "f", "x", 0),
        (5, long_, "g", "x", 0), (6, sentence() + repeated, "h", "x", 0), (7, sentence() * 1 + repeated, "i", "x", 0), (8, "".join(sentence() for _ in range(5)) + item, "j", "x", 0), (1, sentence() * 1, "k", "x", 0),
    ]
    frame = _tables(spark, str(tmp_path), docs, [(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], [(1, item), (2, None), (None, "")])
    held = {name: stage(spark, frame, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    tags = lambda name: sorted(x.gone for x in held[name])
    assert tags("quality_filter") == sorted(x[2] for x in docs)  # too few examples
    assert tags("near_duplicates") == list("acdefghijk")
    assert tags("substring_dedup") == sorted(x[2] for x in docs)
    texts = {x.gone: x.text for x in held["substring_dedup"]}
    assert texts["g"] == long_ and texts["d"] is None and texts["f"] == "" and repeated in texts["h"] and repeated[60:] not in texts["i"]
    assert texts["a"] == "" and texts["b"] == "" and texts["c"] == plain  # the row without an id comes first
    assert tags("decontamination") == sorted(x[2] for x in docs if x[2] != "j")
    sizes = [(x.doc_id, x.n_tokens) for x in held["encoding"]]
    assert len(sizes) == len(docs) and {x for x in sizes if x[1] == 0} == {(3, 0), (None, 0), (4, 0)}
