"""Chat formatting into budgeted windows, in DataFrame functions only.

A turn's tokens are its runs of letters and digits, its other marks, and OVERHEAD for the template. Prefix
sums of a conversation's tokens are taken in two levels (blocks of turn numbers, then turns), so a long
conversation is not one task's.

The room of a conversation is the budget less its first system turn and less `history`. The prefix sums are cut into strides of
that room: the turns that lie within a stride are a window's span, and a turn that crosses a stride's end is a
window of its own. So spans are whole turns and fit the room, unless one turn alone does not. Each window starts with the
conversation's first system turn, then repeats the turns before its span as far as `history` tokens and the rest of the
budget reach, then has its span. Assistant turns are targets in their own window only; repeated ones are masked.
`over_budget` marks windows in which the system turn and a single turn exceed `budget`; no other window does.

Turns are ordered by turn, role and text; repeated rows are turns of their own. Null texts and roles are
empty, null turn numbers come first, rows without a `conv_id` are one conversation.

Template: `<|im_start|>`, the URL-encoded role, a line feed, the escaped text, `<|im_end|>`, a line feed. In
texts, backslashes are doubled and every control string gets a backslash behind its first character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 4
_BLOCK = 256
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
_START, _END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and of other common templates.
_CONTROL = r"(<(?=\|im_start\|>|\|im_end\|>|/?s>)|\[(?=/?INST\]))"
_SYSTEM, _HISTORY, _OWN = 0, 1, 2


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _with_prefix_sums(turns: DataFrame, room: int) -> DataFrame:
    """`turns` with the tokens `before` each, and the `stride`: `room` less the conversation's first system turn."""
    order = ["turn", "role", "text"]
    block = F.floor(F.coalesce("turn", F.lit(0)) / _BLOCK)
    turns = turns.withColumn("_block", F.when(F.col("turn").isNull(), F.lit(None)).otherwise(block))
    sums = turns.groupBy("conv_id", "_block").agg(F.sum("tokens").alias("_sum"))
    blocks = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(blocks), F.lit(0)).alias("_head")
    )
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    system = F.when(F.col("role") == "system", F.struct("turn", "text", "tokens"))
    first = turns.groupBy("conv_id").agg(F.min(system)["tokens"].alias("_system")).withColumnRenamed("conv_id", "_c")
    stride = F.greatest(F.lit(1), F.lit(room) - F.coalesce("_system", F.lit(0)))
    heads = heads.join(first, F.col("_conv").eqNullSafe(F.col("_c"))).withColumn("stride", stride).drop("_c", "_system")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_b"))
    place = Window.partitionBy("conv_id", "_block").orderBy(*order)
    return (
        turns.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .withColumn("_place", F.row_number().over(place))
        .join(heads, same)
        .withColumn("before", F.col("_head") + F.col("_inside"))
        .drop("_head", "_inside", "_conv", "_b", "_block", "_place")
    )


def chat_windows(
    conversations: DataFrame, budget: int = 1024, stride: int | None = None, history: int = 128
) -> DataFrame:
    """Windows of `conversations` (`conv_id`, `turn`, `role`, `text`); a `stride` makes spans shorter than the room.

    `conv_id`, `window_id`, `formatted`, `kinds` (per turn: 0 the retained system turn, 1 history, 2 own),
    `loss` (spans `start`, `end` of code points of `formatted` that are learned), `tokens`, `over_budget`.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", (F.regexp_count("text", F.lit(_TOKEN)) + OVERHEAD).cast("long"))
    summed = _with_prefix_sums(turns, budget - history)
    step = F.col("stride") if stride is None else F.least("stride", F.lit(stride))
    first, last = F.floor(F.col("before") / step), F.floor((F.col("before") + F.col("tokens") - 1) / step)
    group = Window.partitionBy("conv_id", "window_id")
    own = (
        summed.withColumn("window_id", 2 * first + (last > first).cast("long"))
        .withColumn("_end", F.max(F.col("before") + F.col("tokens")).over(group))
        .withColumn("_begin", F.min("before").over(group))
    )
    system = (
        own.where(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min(F.struct("before", "text", "tokens")).alias("s"))
        .select(F.col("conv_id").alias("_conv"), "s")
    )
    kept = ["conv_id", "window_id", "kind", "before", "role", "text", "tokens"]
    windows = own.select("conv_id", "window_id", "_begin", (F.col("_end") - F.col("_begin")).alias("_span")).distinct()
    windows = windows.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    retained = F.coalesce(F.when(F.col("s.before") < F.col("_begin"), F.col("s.tokens")), F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - retained - F.col("_span")))
    windows = windows.withColumn("_from", F.greatest(F.lit(0), F.col("_begin") - rest))
    # History is looked up by blocks of prefix sums: two at most, each of few turns.
    width = max(1, history)
    block = lambda tokens: F.floor(tokens / width)
    wanted = windows.where(F.col("_from") < F.col("_begin")).select(
        F.col("conv_id").alias("_conv"),
        F.col("window_id").alias("_window"),
        "_from",
        "_begin",
        F.explode(F.sequence(block(F.col("_from")), block(F.col("_begin") - 1))).alias("_part"),
    )
    repeated = (
        own.select("conv_id", "before", "role", "text", "tokens", block(F.col("before")).alias("_block"))
        .join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_part")))
        .where((F.col("before") >= F.col("_from")) & (F.col("before") < F.col("_begin")))
        .withColumn("window_id", F.col("_window"))
        .withColumn("kind", F.lit(_HISTORY))
    )
    head = (
        # Not where the turn is in the window anyway, as its own or as history.
        windows.where(F.col("s.before") < F.col("_from"))
        .select(
            "conv_id", "window_id", F.lit(_SYSTEM).alias("kind"), "s.before", F.lit("system").alias("role"), "s.text", "s.tokens"
        )
    )
    parts = own.withColumn("kind", F.lit(_OWN)).select(*kept).unionByName(repeated.select(*kept)).unionByName(head)
    part = F.struct("before", "kind", "role", "text", "tokens")
    grouped = (
        parts.groupBy("conv_id", "window_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .where(F.exists("parts", lambda p: p["kind"] == _OWN))
        .withColumn(
            "pieces",
            F.transform(
                "parts",
                lambda p: F.struct(
                    F.concat(F.lit(_START), F.url_encode(p["role"]), F.lit("\n")).alias("head"), escape(p["text"]).alias("body")
                ),
            ),
        )
    )
    length = lambda s: F.length(s["head"]) + F.length(s["body"]) + len(_END)
    lengths = F.transform("pieces", length)
    upto = lambda i: F.aggregate(F.slice(F.col("_lengths"), F.lit(1), i), F.lit(0), lambda a, b: a + b)
    spans = F.transform(
        "pieces",
        lambda s, i: F.struct(
            (upto(i) + F.length(s["head"])).alias("start"), (upto(i) + F.length(s["head"]) + F.length(s["body"])).alias("end")
        ),
    )
    learned = lambda s, i: (F.get("parts", i)["kind"] == _OWN) & (F.get("parts", i)["role"] == "assistant")
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return (
        grouped.withColumn("_lengths", lengths)
        .withColumn("_spans", spans)
        .select(
            "conv_id",
            "window_id",
            F.array_join(
                F.transform("pieces", lambda s: F.concat(s["head"], s["body"], F.lit(_END))), ""
            ).alias("formatted"),
            F.transform("parts", lambda p: p["kind"]).alias("kinds"),
            F.filter("_spans", learned).alias("loss"),
            total.alias("tokens"),
            (total > budget).alias("over_budget"),
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window what its formatted text says: own turns as (role, text), and the texts that are learned."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = lambda p: F.substring_index(p, "\n", 1)
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substr(body(p), F.lit(len(_START) + 1))).alias("role"),
            unescape(F.substr(p, F.length(body(p)) + 2)).alias("text"),
        ),
    )
    learned = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return windows.withColumn("_parsed", parsed).select(
        "conv_id",
        "window_id",
        F.filter("_parsed", lambda _, i: F.get("kinds", i) == _OWN).alias("turns"),
        learned.alias("learned"),
        F.length("formatted").cast("long").alias("chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation. A digest needs a conversation's text in one place, and nothing else here does."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(windows).select(
        "conv_id",
        "chars",
        F.struct("window_id", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("w"),
        F.size("turns").alias("n"),
    )
    text = lambda field: F.array_join(F.transform("ws", lambda w: w[field]), "")
    return (
        rows.groupBy("conv_id")
        .agg(
            F.sum("n").cast("long").alias("n_turns"),
            F.sum("chars").cast("long").alias("formatted_chars"),
            F.sort_array(F.collect_list("w")).alias("ws"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(text("said"), 256).alias("turns_sha256"),
            F.length(text("learned")).cast("long").alias("loss_chars"),
            F.sha2(text("learned"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
