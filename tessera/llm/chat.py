"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``### <role>:\\n<text>\\n</turn>\\n``. In texts, a backslash and the control strings ``###`` and ``</turn>``
get a backslash before them, so ``\\n</turn>\\n`` ends a turn and nothing else does; roles are URL-encoded. Both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

HEAD, MID, END = "### ", ":\n", "\n</turn>\n"
TRAINED_ROLE = "assistant"
CONTROL = r"(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def expand_prefix_targets(turns: DataFrame) -> DataFrame:
    """One example for each assistant turn: all turns before it as context, and only its text under the loss mask.

    turns: conv_id, turn, role, text (other columns are ignored). Returns conv_id, target (place of the example's last turn, from
    1), trainable, is_last, text, loss_start (from 1) and loss_chars: the mask is that one span of text, in code points. Where a
    conversation does not end with an assistant turn, its last example has no mask, so no turn is lost.

    Null texts and roles count as empty. Turns are ordered by turn (nulls first), and ties by role and text; repeated rows are kept.
    A null conv_id is one conversation. An empty table gives no rows. A conversation is one row of one task while it is expanded
    (its digest needs that), and each example is generated on its own, so memory follows the length of one conversation.
    """
    row = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    segment = lambda t: F.concat(F.lit(HEAD), F.url_encode(t["role"]), F.lit(MID), escape(t["text"]), F.lit(END))
    places = F.sequence(F.lit(1), F.size("turns"))
    wanted = F.filter(places, lambda i: (i == F.size("turns")) | (F.element_at("turns", i)["role"] == TRAINED_ROLE))
    exploded = grouped.select("conv_id", F.size("turns").alias("n"), F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", segment).alias("segments"), F.explode(wanted).alias("target"))
    role = F.element_at("roles", F.col("target"))
    before = F.lit(len(HEAD)) + F.length(F.url_encode(role)) + F.lit(len(MID))
    reply = F.length(F.element_at("segments", F.col("target"))) - before - F.lit(len(END))
    text = F.array_join(F.slice("segments", F.lit(1), F.col("target")), "")
    trainable = role == TRAINED_ROLE
    out = exploded.select("conv_id", "target", trainable.alias("trainable"), (F.col("target") == F.col("n")).alias("is_last"), text.alias("text"), reply.alias("reply"))
    start = F.length("text") - F.lit(len(END)) - F.col("reply") + 1
    return out.select("conv_id", "target", "trainable", "is_last", "text", F.when(F.col("trainable"), start).cast("long").alias("loss_start"), F.when(F.col("trainable"), F.col("reply")).otherwise(0).cast("long").alias("loss_chars"))


def read_turns(text: Column) -> Column:
    """The (role, text) array of a formatted text: the inverse of the template."""
    parts = F.split(text, END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(p: Column) -> Column:
        cut = F.instr(p, MID)
        return F.struct(F.url_decode(F.substring(p, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD))).alias("role"), unescape(F.substring(p, cut + len(MID), F.length(p))).alias("text"))

    return F.transform(parts, one)


def masked_text(text: Column, start: Column, chars: Column) -> Column:
    return unescape(F.substring(text, start.cast("int"), chars.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turn and loss digests and lengths."""
    turns = read_turns(F.col("text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.when(F.col("trainable"), masked_text(F.col("text"), F.col("loss_start"), F.col("loss_chars"))).otherwise(F.lit(""))
    read = examples.select("conv_id", "target", "trainable", loss.alias("loss"), F.when(F.col("is_last"), turns).alias("turns"), F.when(F.col("is_last"), F.length("text")).alias("chars"))
    read = read.select("conv_id", "target", "trainable", "loss", F.when(F.col("turns").isNotNull(), F.size("turns")).alias("n_turns"), F.when(F.col("turns").isNotNull(), F.sha2(told, 256)).alias("turns_sha256"), "chars")
    by = read.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("target", "loss"))).alias("parts"), F.max("chars").cast("long").alias("formatted_chars"), F.count_if("trainable").alias("n_examples"))
    whole = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return by.select("conv_id", "n_turns", "turns_sha256", F.length(whole).cast("long").alias("loss_chars"), F.sha2(whole, 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: Its texts hold the template's own control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(ODD_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return digests(expand_prefix_targets(turns))


ORACLE = {
    "op1_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(url_encode(role)) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM t GROUP BY conv_id
"""
}
