"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others
as named users; messages of CONTEXT roles stay what they are and speak for nobody. A message is written as

    <|role|>text<|end|>     or, of a named user, <|user:name|>text<|end|>

with a line end after it. mask lists what is to be learned: start-end (code points, end not included) of each text of the
assistant and the mark that ends it, comma-joined.

A dialogue is one row for each speaker: part 0, start 0. Since a row must fit into a task, a dialogue of more than
part_bytes bytes comes in several rows, the slices of this one rendering: parts in order are the dialogue, start is the
code point of the whole at which a part starts, and mask + start are places in the whole. Slices are cut between blocks of
block_turns turn numbers; a block that holds more than 1 / HEAVY of all messages, as null or repeated turn numbers can, is
cut by turn, role and the start of the text as well.

Messages stand in the order of turn, role and text, nulls first. Null text is empty; a null role is an unnamed user and no
participant; null conv_ids are one conversation; repeated rows are repeated messages. A conversation without participants
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, checkpoint

CONTEXT = ("system",)
PART_BYTES = 1 << 18
BLOCK_TURNS = 256
_CONV = ["k0", "k1"]  # conv_id without null, and whether it is null
_BLOCK = [*_CONV, "block", "b_turn", "b_null", "b_role", "b_text"]
_END = "<|end|>"


def _keyed(messages: DataFrame, block_turns: int) -> DataFrame:
    """The messages with their blocks; keys are never null, and sort as the messages do."""
    kind, least = messages.schema["conv_id"].dataType, F.lit(-(1 << 63)).cast("long")
    conv = [F.coalesce("conv_id", F.lit("0").cast(kind)).alias("k0"), F.col("conv_id").isNull().alias("k1")]
    block = F.coalesce(F.floor(F.col("turn") / block_turns).cast("long"), least)
    rows = messages.select("conv_id", *conv, block.alias("block"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    counts = checkpoint(rows.groupBy(*_CONV, "block").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * HEAVY > total).select(*[F.col(c).alias("h_" + c) for c in (*_CONV, "block")], F.lit(True).alias("hot"))  # HEAVY rows at most
    on = [F.col(c) == F.col("h_" + c) for c in (*_CONV, "block")]
    rows = rows.join(F.broadcast(hot), on, "left")
    in_hot = lambda value, other: F.when(F.col("hot"), value).otherwise(other)
    return rows.select(
        "conv_id", *_CONV, "block", in_hot(F.coalesce(F.col("turn").cast("long"), least), least).alias("b_turn"), in_hot(F.col("role").isNotNull(), F.lit(False)).alias("b_null"),
        in_hot(F.coalesce("role", F.lit("")), F.lit("")).alias("b_role"), in_hot(F.substring("text", 1, 8), F.lit("")).alias("b_text"), "turn", "role", "text",
    )


def _other_head(role: Column) -> Column:
    return F.when(role.isin(*CONTEXT), F.concat(F.lit("<|"), role, F.lit("|>"))).when(role.isNull(), F.lit("<|user|>")).otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>")))


_OWN_HEAD = "<|assistant|>"


def _parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """The part of each block: of the bytes before it in its conversation."""
    size = F.octet_length("text") + F.octet_length(F.coalesce("role", F.lit(""))) + 17
    sizes = rows.groupBy(*_BLOCK).agg(F.sum(size.cast("long")).alias("size"))
    before = F.sum("size").over(Window.partitionBy(*_CONV).orderBy(*_BLOCK[2:]).rowsBetween(Window.unboundedPreceding, -1))
    return checkpoint(sizes.select(*_BLOCK, F.floor(F.coalesce(before, F.lit(0)) / part_bytes).cast("long").alias("cut"))).select(
        *_BLOCK, (F.dense_rank().over(Window.partitionBy(*_CONV).orderBy("cut")) - 1).cast("long").alias("part")
    )


def _starts(rows: DataFrame, parts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(k0, k1, part, speaker, start) of every part and speaker."""
    tops = parts.groupBy(*_CONV).agg(F.max("part").alias("top"))
    spoken = speakers.join(tops, _CONV)
    one = spoken.filter("top = 0").select(*_CONV, F.lit(0).cast("long").alias("part"), "speaker", F.lit(0).cast("long").alias("start"))
    long = tops.filter("top > 0").select(*_CONV)
    said = rows.join(long, _CONV, "left_semi").groupBy(*_BLOCK, "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    each = said.join(parts, _BLOCK).groupBy(*_CONV, "part", "role").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    whole = each.groupBy(*_CONV, "part").agg(F.sum(F.col("chars") + F.col("n") * (F.char_length(_other_head(F.col("role"))) + len(_END) + 1)).alias("size"))
    own = each.select(*_CONV, "part", F.col("role").alias("speaker"), (F.col("n") * (len(_OWN_HEAD) - F.char_length(_other_head(F.col("role"))))).alias("more"))
    every = spoken.filter("top > 0").select(*_CONV, "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("part"))
    sized = every.join(whole, [*_CONV, "part"]).join(own, [*_CONV, "part", "speaker"], "left")
    before = F.sum(F.col("size") + F.coalesce("more", F.lit(0))).over(Window.partitionBy(*_CONV, "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return one.unionByName(sized.select(*_CONV, "part", "speaker", F.coalesce(before, F.lit(0)).alias("start")))


def rotate(messages: DataFrame, block_turns: int = BLOCK_TURNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, speaker, part, start, n_messages, n_learned, rendered and mask, from messages(conv_id, turn, role, text)."""
    rows = _keyed(messages, block_turns)
    parts = checkpoint(_parts(rows, part_bytes))
    speakers = rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*CONTEXT)).select(*_CONV, F.col("role").alias("speaker")).distinct()
    blocks = rows.groupBy(*_BLOCK).agg(F.first("conv_id").alias("conv_id"), F.collect_list(F.struct("turn", "role", "text")).alias("said"))
    dialogue = blocks.join(parts, _BLOCK).groupBy(*_CONV, "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.flatten(F.collect_list("said"))).alias("said"))
    turned = dialogue.join(_starts(rows, parts, speakers), [*_CONV, "part"])
    keys = ["conv_id", "speaker", "part", "start"]

    def head(m):
        return F.when(m["role"] == F.col("speaker"), F.lit(_OWN_HEAD)).otherwise(_other_head(m["role"]))

    pieces = F.transform("said", lambda m: F.struct(head(m).alias("head"), m["text"].alias("text"), F.coalesce(m["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    written = turned.select(*keys, pieces.alias("p"))
    rendered = F.array_join(F.transform("p", lambda m: F.concat(m["head"], m["text"], F.lit(_END + "\n"))), "")
    sizes = F.transform("p", lambda m: F.struct(F.char_length(m["head"]).alias("h"), (F.char_length(m["text"]) + len(_END)).alias("b"), m["own"].alias("own")))
    spans = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, m: F.struct(
            (a["at"] + m["h"] + m["b"] + 1).cast("long").alias("at"),
            F.when(m["own"], F.array_append(a["spans"], F.concat((a["at"] + m["h"]).cast("string"), F.lit("-"), (a["at"] + m["h"] + m["b"]).cast("string")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return written.select(*keys, F.size("p").cast("long").alias("n_messages"), F.size(F.filter("p", lambda m: m["own"])).cast("long").alias("n_learned"), rendered.alias("rendered"), spans.alias("mask"))


# Of dialogues of up to PART_BYTES, so of one part.
ORACLE = """
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), turned AS (
  SELECT said.conv_id, speaker, turn, role, text, coalesce(role = speaker, false) AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
         WHEN role IS NULL THEN '<|user|>' ELSE '<|user:' || role || '|>' END AS head
  FROM said JOIN speakers ON said.conv_id IS NOT DISTINCT FROM speakers.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER w - length(text) - 8 AS start FROM turned
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS start, count(*) AS n_messages, count(*) FILTER (own) AS n_learned,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rendered,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(text) + 7 AS BIGINT) AS VARCHAR), ','
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, speaker
"""
