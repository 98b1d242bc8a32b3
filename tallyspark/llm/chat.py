"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns of a conversation, in order, are given prefix sums of their tokens. A fold over
the token counts alone cuts the conversation into turn-aligned spans: a turn opens a new span when the
tokens from the span's start to the turn's end exceed the room, which is the budget less
the system turn and less the tokens kept for history. Each span becomes a window: the
leading system turn (retained in every window), the last turns before the span as far as
`history_turns` and `history_tokens` go (repeated as context), then the span's turns. The
loss mask covers the assistant texts of the span only, so a target that a later window
repeats is masked there and every assistant text is a target exactly once.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside texts and roles a backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string; in roles ``%``
and a line feed are percent-coded too. Both are undone when a window is read back.

Of a conversation as a whole only those counts (a number a turn) are ever in one row; its texts are
grouped by window, whose size the budget and its one oversized turn bound.

Defined cases: null texts and roles are empty; turns without a number come first; turns with equal numbers are ordered by role,
then text, and repeated rows stay; a null conversation id is a conversation; a turn longer
than the room has a window of its own, whole, over the budget; an empty table gives no
windows; columns beside the four named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
START, END = "<|im_start|>", "<|im_end|>"
#: Starts of spans that a fold keeps in one array.
PART = 256
#: Tokens of a turn's template.
TURN_TOKENS = 4
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _turn_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per turn with its number, tokens, piece of output, and running sums of tokens and characters."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        "conv_id", "turn", "role", "text",
        (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long").alias("tokens"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    rows = rows.withColumn("chars", (F.char_length("head") + F.char_length("body") + len(END) + 1).cast("long"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.row_number().over(ordered).alias("i"), F.sum("tokens").over(so_far).alias("token_sum"), F.sum("chars").over(so_far).alias("char_sum"))


def _starts(rows: DataFrame, room: int) -> DataFrame:
    """(conv_id, window, i): the first turn of each span."""
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    held = rows.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "tokens"))), lambda t: t["tokens"]).alias("tokens"), F.max(F.when(is_system, F.col("tokens"))).alias("system"),
    )
    left = F.lit(room) - F.coalesce("system", F.lit(0))

    def turn(s: Column, tokens: Column) -> Column:
        i, before, total = s["i"] + 1, s["total"], s["total"] + tokens
        opens = (i == 1) | ((total - s["base"] > left) & (before > s["base"]))
        # The system turn has room of its own: the first span's room starts behind it.
        base = F.when(~opens, s["base"]).when((i == 1) & F.col("system").isNotNull(), total).otherwise(before)
        # Starts are kept in parts, so that adding one copies few.
        is_full = F.size(s["part"]) == PART
        full = F.when(opens & is_full, F.concat(s["full"], F.array(s["part"]))).otherwise(s["full"])
        part = F.when(opens & is_full, F.array(i)).when(opens, F.concat(s["part"], F.array(i))).otherwise(s["part"])
        return F.struct(full.alias("full"), part.alias("part"), i.alias("i"), base.alias("base"), total.alias("total"))

    zero = F.lit(0).cast("long")
    none = F.struct(F.array().cast("array<array<int>>").alias("full"), F.array().cast("array<int>").alias("part"), F.lit(0).alias("i"), zero.alias("base"), zero.alias("total"))
    starts = F.aggregate("tokens", none, turn, lambda s: F.flatten(F.concat(s["full"], F.array(s["part"]))))
    return held.select("conv_id", F.posexplode(starts).alias("window", "i"))


def windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, n_tokens, formatted, loss_spans).

    n_repeated: how many turns at the window's head an earlier window has had. loss_spans:
    (start, end) in code points of `formatted`.
    """
    rows = _turn_rows(turns, conv_col, turn_col, role_col, text_col)
    starts = _starts(rows, budget - history_tokens)
    # A span's number reaches its turns as a row before its first one.
    marked = rows.withColumn("is_turn", F.lit(1)).unionByName(starts.withColumn("is_turn", F.lit(0)), allowMissingColumns=True)
    ordered = Window.partitionBy("conv_id").orderBy("i", "is_turn")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    is_system = (F.col("i") == 1) & (F.col("role") == "system")
    numbered = marked.withColumn("own", F.max("window").over(so_far)).withColumn("n_system", F.coalesce(F.max(F.when(is_system, 1)).over(so_far), F.lit(0))).where("is_turn = 1").drop("window")
    by_turn = Window.partitionBy("conv_id").orderBy("i")
    repeats = []
    for k in range(1, history_turns + 1):
        # The turn k behind this one opens a window, and what lies between has room in its history.
        opens = F.lead("own", k).over(by_turn) != (F.lead("own", k - 1).over(by_turn) if k > 1 else F.col("own"))
        between = F.lead(F.col("token_sum") - F.col("tokens"), k).over(by_turn) - F.col("token_sum") + F.col("tokens")
        repeats.append(F.when(opens & (F.col("i") > F.col("n_system")) & (between <= history_tokens), F.lead("own", k).over(by_turn)))
    fields = ["i", "role", "tokens", "head", "body", "chars", "char_sum"]
    dealt = numbered.select("conv_id", *fields, "own", *(r.alias(f"repeat{k}") for k, r in enumerate(repeats)))
    to = F.filter(F.array("own", *(f"repeat{k}" for k in range(len(repeats)))), lambda w: w.isNotNull())
    dealt = dealt.select("conv_id", *fields, "own", F.explode(to).alias("window")).select("conv_id", "window", (F.col("window") == F.col("own")).alias("fresh"), *fields)
    later = starts.where("window > 0").select(F.col("conv_id").alias("_conv"), F.col("window").alias("_window"))
    system = dealt.where(is_system & F.col("fresh")).join(later, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", F.col("_window").alias("window"), F.lit(False).alias("fresh"), *fields)
    grouped = dealt.unionByName(system).groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("i", "role", "fresh", "head", "body", "chars", "char_sum"))).alias("turns"), F.sum("tokens").alias("n_tokens"),
        F.sum(F.when(F.col("fresh"), 0).otherwise(1)).cast("int").alias("n_repeated"),
        # What stands before the first new turn, less what stood before it in the conversation.
        (F.coalesce(F.sum(F.when(~F.col("fresh"), F.col("chars"))), F.lit(0)) - F.min(F.when(F.col("fresh"), F.col("char_sum") - F.col("chars")))).alias("lead"),
    )
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    start = lambda t: F.col("lead") + t["char_sum"] - t["chars"] + F.char_length(t["head"])
    targets = F.filter("turns", lambda t: t["fresh"] & (t["role"] == "assistant"))
    return grouped.select(
        "conv_id", "window", F.size("turns").alias("n_turns"), "n_repeated", "n_tokens",
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform(targets, lambda t: F.struct(start(t).alias("start"), (start(t) + F.char_length(t["body"])).alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns of a window, read back from its text."""
    blocks = F.split(formatted, "<\\|im_end\\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(blocks, lambda b: F.struct(
        unescape_role(F.substr(role(b), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(b, F.char_length(role(b)) + 2)).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under a window's loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars): conversations read back from their windows.

    turns: role, line feed, text, line feed of each turn, joined; a repeated turn counts where it was new.
    """
    fresh = F.slice(F.col("read"), F.col("n_repeated") + 1, F.size("read"))
    parts = formatted.select("*", read_turns(F.col("formatted")).alias("read")).select(
        "conv_id", "window", F.size(fresh).cast("long").alias("n"), F.char_length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    ordered = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"))
    return ordered.select("conv_id", "n_turns", F.array_join(F.col("all.turns"), "").alias("turns"), F.array_join(F.col("all.loss"), "").alias("loss"), "formatted_chars")
