"""Preference formatting: a shared prompt and two masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of equal turns
(role and text) is rendered once as the prompt; what follows is rendered as the chosen and
the rejected completion. A mask lists the spans of a completion that are trained on: the
texts of assistant turns with their end marks, as ``start:end`` in characters.

Only DataFrame functions are used. A conversation is one row, as its rendering is, so its
text must fit a row (2 GB). Keys may be of any type that sorts.

Defined cases: turns are ordered by turn, role and text, nulls first; null roles and texts
are empty. Equal conversations are all prompt and have empty completions. Rows without a
key are left out; a pair needs both conversations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.sizing import numbered

ASSISTANT = "assistant"
# The turn format of the rendered text.
OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "\n"


def gathered(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the ordered turns of every conversation."""
    plain = turns.filter(F.col(key).isNotNull()).select(
        key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text")).alias("_turn"))
    ordered = F.sort_array(F.collect_list("_turn"))
    return plain.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def rendered(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(LINE), t["text"], F.lit(CLOSE + LINE)))
    return F.array_join(parts, "")


def mask(turns: Column) -> Column:
    """Spans of assistant texts with their end marks in the rendering of turns."""
    def step(state, t):
        start = state["at"] + F.length(t["role"]) + len(OPEN + LINE)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat(F.when(state["spans"] != "", ",").otherwise(""), start.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(LINE)).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))
    return F.aggregate(turns, begin, step, lambda state: state["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Format pairs of gathered conversations: key, n_prompt_turns, prompt, chosen, chosen_mask,
    rejected, rejected_mask."""
    pairs = chosen.select(key, F.col("turns").alias("a")).join(rejected.select(key, F.col("turns").alias("b")), key)
    cut = pairs.withColumn("n", common_turns(F.col("a"), F.col("b")))
    after_a, after_b = (F.slice(c, F.col("n") + 1, F.size(c)) for c in ("a", "b"))
    return cut.select(
        key, F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.slice("a", 1, F.col("n"))).alias("prompt"),
        rendered(after_a).alias("chosen"), mask(after_a).alias("chosen_mask"),
        rendered(after_b).alias("rejected"), mask(after_b).alias("rejected_mask"))


def next_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, next_id): the next conversation, in the order of conv_id, that has a reply.

    Only keys are sorted and numbered, over many tasks, and meet the key one number on.
    """
    replying = turns.filter(F.col("conv_id").isNotNull() & (F.col("role") == ASSISTANT)).select("conv_id").distinct()
    placed = numbered(replying, [F.col("conv_id")], out="place")
    following = placed.select((F.col("place") - 1).alias("place"), F.col("conv_id").alias("next_id"))
    return placed.join(following, "place").select("conv_id", "next_id")


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations out of plain ones (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn. Rejected has in that turn's
    place the last reply of the next conversation with a reply, by order of conv_id; the
    last such conversation gets an empty one. Conversations without an assistant turn have
    no reply to prefer and make no pair.
    """
    whole = gathered(turns, "conv_id")
    back = F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), ASSISTANT)
    upto = whole.withColumn("n", F.size("turns") - back.cast("int") + 1).filter(back > 0)
    chosen = upto.select("conv_id", F.slice("turns", 1, F.col("n")).alias("turns"))
    replies = chosen.select(F.col("conv_id").alias("next_id"), F.element_at("turns", -1)["text"].alias("_reply"))
    donors = replies.join(next_keys(turns), "next_id").select("conv_id", "_reply")
    replied = chosen.join(donors, "conv_id", "left")
    reply = F.array(F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce("_reply", F.lit("")).alias("text")))
    before = F.slice("turns", 1, F.size("turns") - 1)
    return chosen, replied.select("conv_id", F.concat(before, reply).alias("turns"))


def formatted(turns: DataFrame) -> DataFrame:
    """Preference pairs of plain conversations."""
    chosen, rejected = swapped_replies(turns)
    return preference_pairs(chosen, rejected, "conv_id")
