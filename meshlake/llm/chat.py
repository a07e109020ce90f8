"""Multi-party chat rendering: each participant in turn is the assistant.

For every participant of a conversation the whole dialogue is rendered from that
speaker's side: their turns are the assistant's (and are the ones to learn from,
mask 1), those of others are user turns that carry the speaker's name, and turns of
the system stay system turns. A rendering is returned turn by turn, with the place of
each turn and of its content in the rendered text, so that a very long conversation
is never gathered in one row or task; ``join_turns`` puts bounded runs together.

Places are running sums in two steps: within blocks of ``block`` turn numbers, and
over the sums of the blocks.

Defined results: turns are ordered by turn (nulls first), then role and text; ties
beyond that are equal rows and keep one place each. A null or empty role is the
speaker ``unknown``; a null text is empty; a row with a null conv_id is a conversation
of its own. The markers of the template in texts and names lose their bars (``<im_end>``), and
control characters in names become a blank, so no turn can open or close another. Speakers are told apart exactly as written; ``system`` in any case is the system.
A conversation of system turns alone has no participant and no rendering. An empty
turn is rendered, with mask 0. An empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
MARKER = r"<\|(im_start|im_end)\|>"


@dataclass(frozen=True)
class ChatParams:
    system: str = "system"
    block: int = 256  #: turn numbers summed together first


def rotate(conversations: DataFrame, p: ChatParams | None = None) -> DataFrame:
    """Rows (conv_id, perspective, turn, seq, chat_role, name, rendered, mask, start, content_start, content_end)."""
    p = p or ChatParams()
    speaker = F.when(F.coalesce(F.trim("role"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role"))
    turns = conversations.select("conv_id", "turn", speaker.alias("speaker"), F.regexp_replace(F.coalesce("text", F.lit("")), MARKER, "<$1>").alias("text"))
    turns = turns.withColumn("is_system", F.lower("speaker") == p.system)
    alone = turns.where(F.col("conv_id").isNull() & ~F.col("is_system"))
    turns = turns.where(F.col("conv_id").isNotNull())
    people = turns.where(~F.col("is_system")).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(people, turns["conv_id"] == people["c"]).drop("c")
    own = F.col("speaker") == F.col("perspective")
    seen = seen.withColumn("chat_role", F.when(F.col("is_system"), "system").when(own, "assistant").otherwise("user"))
    name = F.regexp_replace(F.regexp_replace(F.col("speaker"), r"[\x00-\x1f\x7f]+", " "), MARKER, "<$1>")
    seen = seen.withColumn("name", F.when(F.col("chat_role") == "user", name))
    head = F.concat(F.lit(START), F.col("chat_role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.col("name"))).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head).cast("long")).withColumn("rendered", F.concat(head, F.col("text"), F.lit(END)))
    seen = seen.withColumn("size", F.length("rendered").cast("long")).withColumn("block", F.floor(F.col("turn") / p.block))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("rank", F.count(F.lit(1)).over(inner))
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    outer = Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("bytes").over(outer), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("first"))
    placed = seen.join(blocks, (seen["conv_id"] == blocks["c"]) & (seen["perspective"] == blocks["s"]) & seen["block"].eqNullSafe(blocks["b"]))
    start = F.col("base") + F.col("before")
    whole = placed.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("first") + F.col("rank")).alias("seq"),
        "chat_role",
        "name",
        "rendered",
        F.when((F.col("chat_role") == "assistant") & (F.col("text") != ""), 1).otherwise(0).alias("mask"),
        start.alias("start"),
        (start + F.col("head")).alias("content_start"),
        (start + F.col("head") + F.length("text")).alias("content_end"),
    )
    head = START + "assistant\n"
    mask = F.when(F.col("text") != "", 1).otherwise(0)
    single = alone.select("conv_id", F.col("speaker").alias("perspective"), "turn", F.lit(0).cast("long").alias("seq"), F.lit("assistant").alias("chat_role"), F.lit(None).cast("string").alias("name"), F.concat(F.lit(head), "text", F.lit(END)).alias("rendered"), mask.alias("mask"), F.lit(0).cast("long").alias("start"), F.lit(len(head)).cast("long").alias("content_start"), (len(head) + F.length("text")).cast("long").alias("content_end"))
    return whole.unionByName(single)


def join_turns(rendered: DataFrame, turns: int = 256) -> DataFrame:
    """Texts and masked spans of runs of ``turns`` turns: (conv_id, perspective, run, start, text, spans)."""
    run = rendered.groupBy("conv_id", "perspective", F.floor(F.col("seq") / turns).alias("run"))
    parts = run.agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "rendered", "mask", "content_start", "content_end"))).alias("parts"))
    spans = F.transform(F.filter("parts", lambda t: t["mask"] == 1), lambda t: F.struct((t["content_start"] - F.col("start")).alias("start"), (t["content_end"] - F.col("start")).alias("end")))
    return parts.select("conv_id", "perspective", "run", "start", F.concat_ws("", F.transform("parts", lambda t: t["rendered"])).alias("text"), spans.alias("spans"))


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = {
    "op10_chat": r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE role END AS speaker,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, alone, speaker AS perspective FROM t WHERE lower(speaker) <> 'system'
), seen AS (
  SELECT t.conv_id, t.alone, perspective, turn, speaker, text,
         CASE WHEN lower(speaker) = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id AND t.alone = people.alone
), called AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN regexp_replace(regexp_replace(speaker, '[\x00-\x1f\x7f]+', ' ', 'g'), '<\|(im_start|im_end)\|>', '<\1>', 'g') END AS name FROM seen
), named AS (
  SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM called
), rendered AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM named
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER w, 0) AS start, count(*) OVER w AS seq
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, perspective, turn, CAST(seq AS BIGINT) AS seq, chat_role, name, rendered,
       CAST(CASE WHEN chat_role = 'assistant' AND text <> '' THEN 1 ELSE 0 END AS INTEGER) AS mask,
       CAST(start AS BIGINT) AS start, CAST(start + length(head) AS BIGINT) AS content_start,
       CAST(start + length(head) + length(text) AS BIGINT) AS content_end
FROM placed
""",
}
