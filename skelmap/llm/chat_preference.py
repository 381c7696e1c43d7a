"""Preference formatting of conversations: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rendering of a turn: OPEN role NEWLINE text CLOSE NEWLINE.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(rows: Column) -> Column:
    return F.transform(rows, lambda t: F.struct(F.coalesce(t.role.cast("string"), F.lit("unknown")).alias("role"), F.coalesce(t.text.cast("string"), F.lit("")).alias("text")))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from a table of conversations (conv_id, turn, role, text): conv_id, chosen and rejected turns.

    Conversations 2k and 2k + 1 are partners. Each is chosen once; its rejected twin keeps the first half of its turns, at
    least one, and goes on with its partner's turns from there. Without a partner the twin ends there. Turns are in the
    order of turn, then role, then text; repeated rows are repeated turns. Rows without conv_id belong to no conversation.
    """
    mine = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    both = mine.groupBy(F.shiftright("conv_id", 1).alias("k")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "role", "text"))).alias("rows"))
    split = both.select("k", F.filter("rows", lambda t: t.conv_id % 2 == 0).alias("even"), F.filter("rows", lambda t: t.conv_id % 2 != 0).alias("odd"))
    sides = split.select(F.explode(F.array(F.struct((F.col("k") * 2).alias("conv_id"), _turns(F.col("even")).alias("chosen"), _turns(F.col("odd")).alias("other")), F.struct((F.col("k") * 2 + 1).alias("conv_id"), _turns(F.col("odd")).alias("chosen"), _turns(F.col("even")).alias("other")))).alias("s"))
    sides = sides.select("s.*").where(F.size("chosen") > 0)
    half = F.greatest(F.lit(1), F.floor(F.size("chosen") / 2)).cast("int")
    return sides.select("conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), half), F.slice("other", half + 1, F.greatest(F.size("other"), F.lit(1)))).alias("rejected"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE), F.lit("\n"))), "")


def _spans(turns: Column) -> Column:
    """Character spans [start, end) of the assistant's texts with their CLOSE, in the rendering of turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        start = a.at + F.length(t.role) + len(OPEN) + 1
        end = start + F.length(t.text) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t.role == "assistant", F.concat(a.spans, span)).otherwise(a.spans).alias("spans"))

    return F.aggregate(turns, zero, add, lambda a: a.spans)


def format_preferences(pairs: DataFrame, id_col: str = "conv_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Prompt and masked completions of pairs of conversations (arrays of role and text).

    Columns: id, n_prompt_turns (longest common prefix by role and text), prompt (its rendering, once; all of it is masked),
    chosen and rejected (renderings of what follows), and chosen_spans and rejected_spans, the character spans of each
    completion that count in the loss: assistant texts with their end mark. Equal conversations give two empty completions,
    and a null conversation counts as empty. Repeated pairs are repeated; an empty table gives no rows. Other columns are not read.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(F.col(id_col), F.coalesce(_turns(F.col(chosen_col)), empty).alias("c"), F.coalesce(_turns(F.col(rejected_col)), empty).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int")
    rows = rows.withColumn("n", n)
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side), F.lit(1)))
    cut = rows.select(id_col, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(id_col, F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))


def spans_text(spans: str) -> Column:
    """Spans as text: start-end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s.start, s.end)), ",")
