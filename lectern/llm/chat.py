"""Chat formatting by relational means: turn structs are collected and sorted, adjacent turns of one
role merge into a block by array aggregation, and blocks are concatenated, all in Spark expressions.

Template. A block is ``<s>`` + opening + turns joined by ``[TURN]`` + closing + ``</s>``:
user ``[INST]``..``[/INST]``, system ``<<SYS>>``..``<</SYS>>``, assistant ``[OUT]``..``[/OUT]``, any
other role ``[ROLE]``name``[/ROLE]``... Inside texts and role names a control string is broken by an
escape mark after its first character, and the mark itself is doubled, so a formatted conversation
reads back to exactly its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import table

MARK = "␛"
_CONTROL = rf"({MARK}|<(?=/?s>|<SYS>>|</SYS>>)|\[(?=/?(?:INST|OUT|ROLE|TURN)\]))"
_OPEN = {"user": "[INST]", "system": "<<SYS>>", "assistant": "[OUT]"}
_CLOSE = {"user": "[/INST]", "system": "<</SYS>>", "assistant": "[/OUT]"}
_TURN = "[TURN]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, f"$1{MARK}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[{MARK}]){MARK}", "$1")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"))
    for name, mark in _OPEN.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit("")
    for name, mark in _CLOSE.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted`` string and ``loss_spans`` (start, length in code points of
    ``formatted``), which cover each assistant text and nothing else.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Null text or role is the empty
    string; null turns sort first; turns that tie sort by role, then text; repeated rows are repeated
    turns; a null conv_id is a conversation of its own. An empty table gives no rows. A conversation
    is one output row and so is gathered whole, as its format demands; conversations are independent.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Where each text begins follows from the lengths of all before it: a running sum, so that no array grows
    # by copying and a conversation's work is linear in its turns.
    seen = rows.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("role").over(order)).withColumn("shown", escaped(F.col("text")))
    opened = F.length(F.concat(F.lit("<s>"), _opening(F.col("role"))))
    between = (
        F.when(F.col("before").isNull(), opened).when(F.col("before") == F.col("role"), len(_TURN))
        .otherwise(F.length(F.concat(_closing(F.col("before")), F.lit("</s>"))) + opened)
    )
    sized = seen.withColumn("size", F.length("shown").cast("long")).withColumn("upto", F.sum(between + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = sized.select("conv_id", F.struct("n", "role", F.col("shown").alias("text"), (F.col("upto") - F.col("size")).alias("start"), "size").alias("t"))
    sorted_turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Blocks begin where the role changes; each is then cut out once, so the work is linear in turns.
    begins = sorted_turns.withColumn(
        "starts", F.array_compact(F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)))
    )

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: t["text"])
        return F.struct(F.get("turns", start)["role"].alias("role"), texts.alias("texts"))

    blocks = begins.select("conv_id", "turns", F.transform("starts", block).alias("blocks"))
    pieces = blocks.select(
        "conv_id",
        "turns",
        F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"),
                F.concat(F.lit("<s>"), _opening(b["role"])).alias("head"),
                b["texts"].alias("texts"),
                F.concat(_closing(b["role"]), F.lit("</s>")).alias("tail"),
            ),
        ).alias("pieces"),
    )
    formatted = F.array_join(
        F.transform("pieces", lambda p: F.concat(p["head"], F.array_join(p["texts"], _TURN), p["tail"])), ""
    )
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    spans = F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    return pieces.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""

    def turns_of(block: Column) -> Column:
        named = r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\](.*)$"
        role = F.when(block.rlike(r"^<s>\[ROLE\]"), unescaped(F.regexp_extract(block, named, 1)))
        body = F.regexp_extract(block, named, 2)
        for name in _OPEN:
            start, end = f"<s>{_OPEN[name]}", _CLOSE[name]
            here = block.startswith(start)
            inner = F.substring(block, F.lit(len(start) + 1), F.length(block) - (len(start) + len(end)))
            role, body = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner).otherwise(body)
        return F.transform(
            F.split(body, r"\[TURN\]", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text"))
        )

    blocks = F.split(formatted, "</s>", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns_of))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe conversation -7; digests are read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = format_chats(rows.unionByName(probe))
    read = out.select(
        "conv_id",
        "formatted",
        parsed_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op10_chat_formatting": op10_chat_formatting}

_SQL_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(9243), chr(9243) || chr(9243)),
  '<(/?s>)', '<' || chr(9243) || '\1', 'g'), '<(</?SYS>>)', '<' || chr(9243) || '\1', 'g'),
  '\[(/?(INST|OUT|ROLE|TURN)\])', '[' || chr(9243) || '\1', 'g')"""

ORACLES = {
    "op10_chat_formatting": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *, {_SQL_ESCAPED} AS shown,
    CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(shown) + CASE WHEN opens = 0 THEN 6
    ELSE 7 + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 11 ELSE 13 + length(role) END END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
}
