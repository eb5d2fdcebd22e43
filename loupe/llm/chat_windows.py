"""Chat formatting with budgeted windows, in DataFrame operations only.

Turns are rendered in one template, prefix sums of their tokens cut the
conversation into turn-aligned spans, and every window repeats the system turn
and a little history before its own turns.  The loss mask covers the own
assistant texts only, so a repeated target is never learned twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's marks, and the control strings of common chat templates.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|/INST\]|INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|/INST\]|INST\])"


def escape(c: Column) -> Column:
    """Put one more backslash behind the first character of every control
    string, escaped ones included: no raw control string is left, and
    ``unescape`` gives the text back."""
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def token_estimate(c: Column) -> Column:
    """A token for every four code points begun."""
    return F.ceil(F.length(c) / 4)


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 2, history_budget: int = 256,
                         target_role: str = "assistant", count_tokens=token_estimate) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> one row per window: ``conv_id,
    window, n_repeated, n_new, n_tokens, formatted, loss`` (code-point spans
    ``start, len`` of escaped target texts in ``formatted``).

    A window holds at most ``budget`` tokens unless one turn alone exceeds
    what the system turn and history leave: such a turn stands in a window of
    its own, uncut.  Null role or text: empty.  Turns of equal number, and
    repeated rows, are turns of their own, ordered by (turn, role, text).  A
    null conversation id is one conversation.  Only a first turn with role
    ``system`` is repeated as the system turn.  Other columns are not read."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("seg", F.concat("head", "body", F.lit(CLOSE))).withColumn("tok", count_tokens(F.col("seg")))
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = (t.withColumn("i", F.row_number().over(w)).withColumn("first", F.first(F.struct("role", "seg", "tok")).over(run))
         .withColumn("sys", F.col("first.role") == "system")
         .withColumn("room", F.greatest(F.lit(2), F.lit(budget - history_budget) - F.when(F.col("sys"), F.col("first.tok")).otherwise(0))))
    t = t.withColumn("big", F.col("tok") > F.col("room") / 2).withColumn("cell", F.floor((F.sum("tok").over(run) - 1) / (F.col("room") / 2)))
    t = t.withColumn("at", F.sum(F.length("seg")).over(run) - F.length("seg"))
    # a span's turns end in one half-room cell, so it sums to at most room; a big turn is a span of its own
    cut = (F.col("i") == 1) | F.col("big") | F.lag("big", 1, False).over(w) | (F.col("cell") != F.lag("cell").over(w))
    t = t.withColumn("cut", cut).withColumn("window", F.sum(F.col("cut").cast("int")).over(run))
    back, ok = [], F.lit(True)
    for j in range(1, history + 1):
        seg, tok = F.lag("seg", j).over(w), F.lag("tok", j).over(w)
        ok = ok & (tok <= history_budget // max(history, 1)) & ((F.col("i") - j > 1) | ~F.col("sys"))
        back.insert(0, F.when(ok & F.col("cut"), seg))
    system = F.when(F.col("sys") & (F.col("i") > 1) & F.col("cut"), F.col("first.seg"))
    t = t.withColumn("repeat", F.filter(F.array(system, *back), lambda x: x.isNotNull()))
    own = F.struct("i", "seg", "tok", F.col("at").alias("at"), (F.col("at") + F.length("head")).alias("start"),
                   F.length("body").alias("len"), (F.col("role") == target_role).alias("target"))
    g = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(own)).alias("own"), F.min_by("repeat", "i").alias("rep"))
    g = g.withColumn("lead", F.array_join("rep", "")).withColumn("formatted", F.concat("lead", F.array_join("own.seg", "")))
    shift = F.length("lead") - F.get(F.col("own"), F.lit(0))["at"]
    return g.select("conv_id", "window", F.size("rep").alias("n_repeated"), F.size("own").alias("n_new"),
                    count_tokens(F.col("formatted")).alias("n_tokens"), "formatted",
                    F.transform(F.filter("own", lambda x: x["target"]),
                                lambda x: F.struct((x["start"] + shift).alias("start"), x["len"].alias("len"))).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: ``conv_id, turns array<struct<role, text>>,
    targets array<string>, formatted_chars``; repeated turns are skipped."""
    segs = F.slice(F.split("formatted", r"\Q" + OPEN + r"\E"), F.col("n_repeated") + 2, F.col("n_new"))
    turns = F.transform(segs, lambda s: F.struct(
        unescape(F.substring_index(s, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, SEP, -1), CLOSE, 1)).alias("text")))
    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["len"])))
    one = windows.select("conv_id", F.struct("window", turns.alias("turns"), targets.alias("targets")).alias("w"), F.length("formatted").alias("n"))
    g = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("formatted_chars"))
    return g.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.targets").alias("targets"), "formatted_chars")
