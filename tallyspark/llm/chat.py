r"""Chat formatting with Spark expressions only.

Template: adjacent turns of one role form a block, `### <role>: ` then each text followed by
`</turn>`, then a line feed. Control characters inside roles and texts are replaced by two
characters each (`\` `#` `<` `:` as `\b` `\h` `\l` `\c`; a null role is `\0`), so no text can hold
a mark, and the output parses back to the given turns.

A conversation becomes one string, so a group of this operator is one conversation by definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import whole_text

OPEN, AFTER_ROLE, END_TURN, END_BLOCK = "### ", ": ", "</turn>", "\n"
#: In this order when escaping, in the opposite one when reading back.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
NULL_ROLE = "\\0"


def escaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points of
    each trained text in `formatted`, in order), n_turns and n_blocks.

    Turns are ordered by turn number, ties by role, then text; a null turn number comes first, a
    null role first, a null text counts as empty. Repeated rows are turns of their own. Rows with a
    null conversation id form one conversation. An empty table gives no rows; other columns are not
    looked at.
    """
    rows = turns.select("conv_id", "turn", "role", whole_text("text").alias("text"))
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").isNotNull().alias("has"), "role", "text")))
    ordered = rows.groupBy("conv_id").agg(sorted_turns.alias("_turns"))
    parts = F.transform(
        "_turns",
        lambda t: F.struct(
            F.coalesce(escaped(t["role"]), F.lit(NULL_ROLE)).alias("role"),
            F.concat(escaped(t["text"]), F.lit(END_TURN)).alias("body"),
            t["role"].eqNullSafe(F.lit(trained_role)).alias("trained"),
        ),
    )
    first = lambda i: (i == 0) | (F.get("_parts", i - 1)["role"] != F.get("_parts", i)["role"])
    last = lambda i: (i == F.size("_parts") - 1) | (F.get("_parts", i + 1)["role"] != F.get("_parts", i)["role"])
    pieces = F.transform(
        "_parts",
        lambda p, i: F.struct(
            F.when(first(i), F.concat(F.lit(OPEN), p["role"], F.lit(AFTER_ROLE))).otherwise("").alias("head"),
            F.concat(p["body"], F.when(last(i), END_BLOCK).otherwise("")).alias("tail"),
            (F.length(p["body"]) - len(END_TURN)).alias("chars"),
            p["trained"].alias("trained"),
        ),
    )
    start = {"at": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:bigint,chars:bigint>>")}
    walked = F.aggregate(
        "_pieces",
        F.struct(*[c.alias(n) for n, c in start.items()]),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["tail"])).alias("at"),
            F.when(
                p["trained"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["head"])).alias("start"),
                            p["chars"].cast("long").alias("chars"),
                        )
                    ),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return (
        ordered.withColumn("_parts", parts)
        .withColumn("_pieces", pieces)
        .select(
            "conv_id",
            F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["tail"])), "").alias("formatted"),
            walked["spans"].alias("loss_spans"),
            F.size("_pieces").cast("long").alias("n_turns"),
            F.size(F.filter("_pieces", lambda p: p["head"] != "")).cast("long").alias("n_blocks"),
        )
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts out of the formatted strings: conv_id, turns (role, text) and
    loss_text, besides the given columns `formatted` and `loss_spans`."""
    blocks = F.filter(F.split("formatted", OPEN), lambda b: b != "")

    def turns_of(block):
        role = F.substring_index(block, AFTER_ROLE, 1)
        body = F.substring(block, F.length(role) + F.lit(len(AFTER_ROLE) + 1), F.length(block))
        texts = F.split(body, END_TURN)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1),  # behind the last mark only the line feed is left
            lambda t: F.struct(
                F.when(role != NULL_ROLE, unescaped(role)).alias("role"), unescaped(t).alias("text")
            ),
        )

    masked = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["chars"].cast("int"))),
    )
    return formatted.select(
        "conv_id",
        "formatted",
        "loss_spans",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )
