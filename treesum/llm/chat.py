"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

A pair is two conversations. Their longest common turn prefix is rendered once as the prompt; what is left of either is
its completion, with a mask of runs "length:flag" over the completion's characters, flag 1 where a model learns (the
words of an assistant and the mark that ends them), 0 elsewhere.

The prefix ends at the first turn number where the sides differ in role, text or presence. That number is a minimum,
combined before the shuffle, over an equality join on (pair, turn); no pairs of conversations of a group are formed.
A rendered conversation is one output value, as a text is.

Pairs come from `pairs_by_id`, for tables that hold both sides under neighbouring ids, or from `pairs_of_replies`, for
plain conversations: the chosen side is a conversation up to its last reply of an assistant, the rejected side the same
with that reply broken off after half of its words. All turns before the reply are then the prompt.

Defined results: a side that is missing is an empty conversation, so the prompt is empty and the other side is all
completion; a null pair key is dropped only by `pairs_by_id` (a null conv_id names no conversation); null roles render
as "unknown", null texts as empty, null turn numbers stand before all others; turns that repeat in number stand in
order of role and text and differ if either side has more of them; an empty table gives an empty result; further
columns are not read. `pairs_of_replies`: turns after the last reply are no part of a pair; a conversation without a
reply is a pair of equal sides, all of it prompt; of a reply with fewer than two words nothing is left on the rejected
side; where the last turn number holds several replies each is broken off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs_by_id(conversations: DataFrame) -> DataFrame:
    """Neighbouring ids are a pair: conv_id 2p is the chosen, 2p + 1 the rejected side of pair p."""
    c = conversations.where("conv_id is not null")
    return c.select(F.expr("conv_id div 2 - if(conv_id < 0 and pmod(conv_id, 2) = 1, 1, 0)").alias("pair_id"), (F.expr("pmod(conv_id, 2) = 0")).alias("chosen"), "turn", "role", "text")


def pairs_of_replies(conversations: DataFrame) -> DataFrame:
    """Each conversation (conv_id, not null) against itself with its last reply broken off after half of its words."""
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), "role", "text")
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("pair_id"))
    c = c.withColumn("last", last).where("last is null or turn <= last")
    reply = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.lit(False))
    words = F.split(F.col("text"), " ", -1)
    half = F.when(reply, F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")).otherwise(F.col("text"))
    # a reply with one word is left out of the rejected side
    sides = F.array(F.struct(F.lit(True).alias("chosen"), F.col("text")), F.struct((F.lit(False)).alias("chosen"), half.alias("text")))
    both = c.select("pair_id", "turn", "role", (F.size(words) < 2).alias("short"), reply.alias("reply"), F.explode(sides).alias("s"))
    return both.where("s.chosen or not reply or not coalesce(short, true)").select("pair_id", "s.chosen", "turn", "role", "s.text")


def preferences(turns: DataFrame) -> DataFrame:
    """turns(pair_id long, chosen boolean, turn, role, text): one row per pair with pair_id, n_prompt_turns, prompt,
    chosen, rejected, chosen_mask, rejected_mask."""
    t = turns.select("pair_id", "chosen", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # what a turn number holds, as one value a side
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col("chosen") == yes, F.struct("role", "text"))))
    both = t.groupBy("pair_id", "turn").agg(side(True).alias("a"), side(False).alias("b"))
    fork = both.withColumn("differs", F.coalesce(F.col("a") != F.col("b"), F.lit(True)))
    # turns render in order; the fork is the least turn where the sides differ
    last = F.lit((1 << 63) - 1)
    turns_of = F.array_sort(F.collect_list(F.struct("turn", "a", "b", "differs")))
    g = fork.groupBy("pair_id").agg(F.coalesce(F.min(F.when(F.col("differs"), F.col("turn"))), last).alias("fork"), turns_of.alias("ts"))
    flat = lambda part, s: F.expr(f"flatten(transform(filter(ts, x -> {part}), x -> x.{s}))")
    g = g.select("pair_id", flat("x.turn < fork", "a").alias("p"), flat("x.turn >= fork", "a").alias("c"), flat("x.turn >= fork", "b").alias("r"))
    show = lambda c: F.expr(f"array_join(transform({c}, x -> concat('<|', x.role, '|>\\n', x.text, '<|end|>\\n')), '')")
    # the head of a turn, its words with the end mark, and the newline after it
    mask = lambda c: F.expr(f"array_join(transform({c}, x -> if(x.role = 'assistant', concat(length(x.role) + 5, ':0 ', length(x.text) + 7, ':1 1:0'), concat(length(x.role) + length(x.text) + 13, ':0'))), ' ')")
    return g.select("pair_id", F.size("p").cast("long").alias("n_prompt_turns"), show("p").alias("prompt"), show("c").alias("chosen"), show("r").alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    return preferences(pairs_of_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_BY_ID = "t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)"
_OF_REPLIES = """c AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM c GROUP BY conv_id),
x AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS ws, coalesce(turn = last AND role = 'assistant', false) AS reply FROM c JOIN m USING (conv_id) WHERE last IS NULL OR turn <= last),
t AS (SELECT conv_id AS pair_id, true AS chosen, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM x
      UNION ALL SELECT conv_id, false, turn, coalesce(role, 'unknown'), coalesce(CASE WHEN reply THEN array_to_string(ws[1 : len(ws) // 2], ' ') ELSE text END, '') FROM x WHERE NOT reply OR coalesce(len(ws), 0) >= 2)"""


def oracle(pairs: str = _OF_REPLIES) -> str:
    """The same in DuckDB's SQL, over the turns that `pairs` names t."""
    return f"""
WITH {pairs},
k AS (SELECT pair_id, turn, list({{'role': role, 'text': text}} ORDER BY role, text) FILTER (chosen) AS a, list({{'role': role, 'text': text}} ORDER BY role, text) FILTER (NOT chosen) AS b FROM t GROUP BY ALL),
f AS (SELECT pair_id, coalesce(min(turn) FILTER (a IS DISTINCT FROM b), 9223372036854775807) AS fork FROM k GROUP BY pair_id),
s AS (SELECT pair_id, chosen, turn, role, text, turn < fork AS common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
      CASE WHEN role = 'assistant' THEN (length(role) + 5) || ':0 ' || (length(text) + 7) || ':1 1:0' ELSE (length(role) + length(text) + 13) || ':0' END AS mask FROM t JOIN f USING (pair_id))
SELECT pair_id, count(*) FILTER (common AND chosen) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (common AND chosen), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (NOT common AND chosen), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (NOT common AND NOT chosen), '') AS rejected,
  coalesce(string_agg(mask, ' ' ORDER BY turn, role, text) FILTER (NOT common AND chosen), '') AS chosen_mask,
  coalesce(string_agg(mask, ' ' ORDER BY turn, role, text) FILTER (NOT common AND NOT chosen), '') AS rejected_mask
FROM s GROUP BY pair_id"""
