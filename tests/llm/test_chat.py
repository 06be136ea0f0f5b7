from weft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_every_participant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé 😀"), (1, 3, "ann", None)]
    got = {r.speaker: r for r in chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"ann", "bob"}
    a = got["ann"]
    assert a.rendered == "<|system|>Be kind.<|end|>\n<|assistant|>Hi<|end|>\n<|user:bob|>Hé 😀<|end|>\n<|assistant|><|end|>\n"
    assert [a.rendered[int(x) : int(y)] for x, y in (s.split("-") for s in a.mask.split(","))] == ["Hi<|end|>", "<|end|>"]
    assert (a.n_messages, a.n_learned) == (4, 2) and got["bob"].n_learned == 1


def test_parts_are_the_dialogue(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.speaker: r.rendered for r in chat.rotate(df).collect()}
    parts = sorted(chat.rotate(df, 10).collect(), key=lambda r: r.part)
    assert {s: "".join(r.rendered for r in parts if r.speaker == s) for s in "ab"} == whole
    for r in parts:
        assert all(r.rendered[int(x) : int(y)].endswith("<|end|>") for x, y in (s.split("-") for s in r.mask.split(",")))


def test_odd_rows(spark):
    rows = [(None, None, "a", "x"), (None, 1, None, "y"), (2, 0, "system", "only"), (3, 0, "a", "same"), (3, 0, "a", "same"), (4, 0, "a", "w " * 50_000)]
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(None, "a"), (3, "a"), (4, "a")}
    assert got[(None, "a")].rendered == "<|assistant|>x<|end|>\n<|user|>y<|end|>\n"
    assert got[(3, "a")].n_messages == 2
    extra = spark.createDataFrame([(1, 0, "a", "t", 5)], SCHEMA + ", part int")
    assert chat.rotate(extra).count() == 1
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_dialogues_are_whole(spark):
    import random

    r = random.Random(5)
    rows = [(1, i, r.choice(["ann", "bob", "cy", "system"]), f"t{i} " * r.randint(0, 4)) for i in range(1500)]
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.speaker for x in got} == {"ann", "bob", "cy"} and len(got) == 3 and {(x.part, x.start, x.n_messages) for x in got} == {(0, 0, 1500)}


def plain(rows, speaker):
    """The rendering and the places in it that are learned, one message after another."""
    out, learned = "", []
    for turn, role, text in sorted(((t, r, x or "") for _, t, r, x in rows), key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or "", m[2])):
        out += "<|assistant|>" if role == speaker else "<|system|>" if role == "system" else "<|user|>" if role is None else f"<|user:{role}|>"
        if role == speaker:
            learned.append((len(out), len(out) + len(text) + 7))
        out += text + "<|end|>\n"
    return out, learned


def test_slices_against_plain_reading(spark):
    """Null and repeated turns, repeated rows, several slices: parts with their starts are one rendering."""
    import random

    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, None, 2]), r.choice([None, 7, 7, r.randint(0, 2000)]), r.choice(["ann", "bob", None, "system"]), r.choice([None, "", "é😀", "same", "w " * r.randint(1, 30)])) for _ in range(900)]
    rows += rows[:50]
    for size in (200, 3000, chat.PART_BYTES):
        got = chat.rotate(spark.createDataFrame(rows, SCHEMA), part_bytes=size).collect()
        for conv in (1, 2, None):
            mine = [x for x in rows if x[0] == conv]
            for speaker in ("ann", "bob"):
                parts = sorted((x for x in got if x.conv_id == conv and x.speaker == speaker), key=lambda x: x.part)
                whole, learned = plain(mine, speaker)
                assert "".join(x.rendered for x in parts) == whole and sum(x.n_messages for x in parts) == len(mine)
                assert [x.part for x in parts] == list(range(len(parts))) and (len(parts) == 1) == (size == chat.PART_BYTES)
                assert [x.start for x in parts] == [sum(len(y.rendered) for y in parts[:i]) for i in range(len(parts))]
                assert [(x.start + int(a), x.start + int(b)) for x in parts for a, b in (s.split("-") for s in x.mask.split(",") if s)] == learned
