"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and joined to one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import table

#: Fixed marks of the template: what opens and closes a block of each role; other roles use the last one with their name.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
#: Between the texts of adjacent turns of one role, which share a block.
BETWEEN = "<sep>"
#: Every mark holds one of the last two; inside texts they are written so, the first one making that reversible.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))

_OPENING = r"(?=<<SYS>>|\[INST\]|<s>|\[ROLE )"
_HEAD = r"^(<<SYS>>|\[INST\]|<s>|\[ROLE [^\]]*\])"
_TAIL = r"(<</SYS>>|\[/INST\]|</s>|\[/ROLE\])$"


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def _role_name(role: Column) -> Column:
    """A role as written in its mark: a closing bracket would end the mark."""
    return F.replace(escape(role), F.lit("]"), F.lit("&rsqb;"))


def _opens(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), _role_name(role), F.lit(OTHER[1]))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _closes(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for turns (conv_id, turn, role, text): one row per conversation.

    Turns are ordered by turn (null first), ties by role and text; adjacent turns of one role share a block. A null role or text
    is an empty one. loss: (start, length) in characters of every assistant text inside `formatted`, without marks.
    A null conv_id is a conversation like others; repeated rows are turns of their own; an empty table gives no row.
    """
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    rows = rows.withColumn("n", F.size("t"))

    def part(x: Column, i: Column) -> Column:
        following = F.try_element_at("t", i + F.lit(2))
        first = (i == 0) | (F.try_element_at("t", F.greatest(i, F.lit(1)))["role"] != x["role"])
        last = (i == F.col("n") - 1) | (following["role"] != x["role"])
        return F.struct(
            F.when(first, _opens(x["role"])).otherwise(F.lit(BETWEEN)).alias("before"),
            escape(x["text"]).alias("text"),
            F.when(last, _closes(x["role"])).otherwise(F.lit("")).alias("after"),
            (x["role"] == "assistant").alias("loss"),
        )

    rows = rows.select("conv_id", F.transform("t", part).alias("p"))
    rows = rows.select("conv_id", "p", F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])).alias("s"))
    sizes = F.transform("s", lambda x: F.char_length(x))
    folded = F.aggregate(
        F.arrays_zip(F.col("p"), sizes.alias("z")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + x["z"]).alias("at"),
            F.when(
                x["p"]["loss"],
                F.array_append(acc["loss"], F.struct((acc["at"] + F.char_length(x["p"]["before"])).alias("start"), F.char_length(x["p"]["text"]).cast("long").alias("length"))),
            )
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return rows.select("conv_id", F.array_join("s", "").alias("formatted"), folded.alias("loss"))


def parsed(text: Column) -> Column:
    """The turns (role, text) that a formatted string was made of."""
    blocks = F.filter(F.split(text, _OPENING), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.regexp_extract(block, _HEAD, 1)
        role = unescape(F.replace(F.regexp_extract(head, r"^\[ROLE ([^\]]*)\]$", 1), F.lit("&rsqb;"), F.lit("]")))
        for name, (mark, _) in MARKS.items():
            role = F.when(head == mark, F.lit(name)).otherwise(role)
        body = F.substring(block, F.char_length(head) + 1, F.char_length(block))
        body = F.regexp_replace(body, _TAIL, "")
        return F.transform(F.split(body, BETWEEN), lambda s: F.struct(role.alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(text: Column, loss: Column) -> Column:
    return F.transform(loss, lambda x: unescape(F.substring(text, (x["start"] + 1).cast("int"), x["length"].cast("int"))))


#: The conversation that every query adds: texts full of control strings.
PROBE = 'SELECT -7L AS conv_id, 0L AS turn, "user" AS role, "</s>[INST] ok [/INST]" AS text UNION ALL SELECT -7L, 1L, "assistant", "</s>[INST] ok [/INST]"'


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe; digests are taken of what is read back from the formatted strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    rows = formatted(turns).select("conv_id", "formatted", parsed(F.col("formatted")).alias("back"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("learnt"))
    return rows.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS x,
  lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS joined FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length(role) END AS marks FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN joined THEN 5 ELSE marks END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
