"""Chat formatting in budgeted windows, by DataFrame functions only.

Turns become ``<turn ROLE>\\nTEXT</turn>\\n``.  Inside texts and roles a backslash
becomes ``\\b`` and the ``<`` of ``<turn`` or ``</turn`` becomes ``\\l`` (in roles also
``>`` ``\\g`` and newline ``\\n``), so control strings never occur there and the
escape can be undone.

Prefix sums of turn tokens place each turn in a slot, whole turns only; a turn that
begins in the slot before takes a window of its own where the slot would else hold
more than its size.  Empty window numbers close up.  A conversation's leading system
turn heads every window; the last turns of the window before, as far as ``history``
tokens and the budget reach, are repeated as context.  Head, context and new turns
keep the budget, unless head and a single turn alone are larger.  The loss mask covers
the texts of assistant turns where they are new, never a repeated one.

Null texts and roles count as empty; rows go by turn (null first), then role, then
text, and repeated rows are turns of their own.  A null conv_id is a conversation.
A turn larger than a window stands in one of its own size.  An empty table gives
none.  Extra columns, also one called ``window``, do not matter.

A conversation of over LONG turns is spread over tasks by ranges of its turns, equal
turns together; only its digest needs all its text, which is one row's value there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions
from .packing import RANGES, range_of, splitters

BUDGET, HISTORY = 1024, 192
#: Tokens a turn's markers take.
OVERHEAD = 4
#: Turns from which a conversation is spread over tasks; slots that a task numbers; characters of text in a splitter.
LONG, BLOCK, PREFIX = 100_000, 1 << 16, 40
OPEN, CLOSE, END = "<turn ", "</turn>\n", ">\n"


def _replaced(column: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escaped(text: Column) -> Column:
    return _replaced(text, ("\\", "\\b"), ("<turn", "\\lturn"), ("</turn", "\\l/turn"))


def unescaped(text: Column) -> Column:
    return _replaced(text, ("\\n", "\n"), ("\\g", ">"), ("\\l", "<"), ("\\b", "\\"))


def escaped_role(role: Column) -> Column:
    return _replaced(escaped(role), (">", "\\g"), ("\n", "\\n"))


def tokens_of(text: Column) -> Column:
    """A turn's tokens, estimated, and its markers'.

    A quarter of the Latin letters and spaces of ASCII; of everything else its bytes,
    of which byte pairs make no more tokens.
    """
    rest = F.octet_length(F.regexp_replace(text, "[A-Za-z ]+", ""))
    return (F.ceil((F.octet_length(text) - rest) / 4) + rest + OVERHEAD).cast("long")


def _turns(conversations: DataFrame, tokens) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("n", tokens(F.col("text")))


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Rows with their window, its end and room for repeated turns, whether one follows, and the system turn's last window.

    Window functions by conversation: each conversation is a task's.
    """
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("pos", F.row_number().over(whole.orderBy("turn", "role", "text")))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    sums = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"end": F.sum(F.when(F.col("system"), 0).otherwise(F.col("n"))).over(sums), "head": F.coalesce(F.max(F.when(F.col("system"), F.col("n"))).over(sums), F.lit(0))})
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.col("head"))
    rows = rows.withColumn("slot", F.floor(F.greatest(F.col("end") - 1, F.lit(0)) / stride))
    fresh = F.when(F.col("system"), 0).otherwise(F.col("n"))
    rows = rows.withColumn("slot_sum", F.sum(fresh).over(Window.partitionBy("conv_id", "slot")))
    alone = ~F.col("system") & (F.col("end") - F.col("n") < F.col("slot") * stride) & (F.col("slot_sum") > stride)
    rows = rows.withColumn("part", F.when(alone, 0).otherwise(1))
    rows = rows.withColumn("window", F.dense_rank().over(whole.orderBy("slot", "part")))
    # what the window after holds, its head and new turns, bounds what may be repeated there
    rows = rows.withColumn("window_sum", F.sum(fresh).over(Window.partitionBy("conv_id", "window")))
    rows = rows.withColumns({"last": F.max("window").over(whole), "window_end": F.max("end").over(Window.partitionBy("conv_id", "window"))})
    next_sum = F.max("window_sum").over(whole.orderBy("window").rangeBetween(1, 1))
    return rows.withColumns({"room": F.least(F.lit(history), budget - F.col("head") - F.coalesce(next_sum, F.lit(0))), "followed": F.col("window") < F.col("last")})


def _placed_by_ranges(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """The same columns, where no task gets a whole conversation.

    Sampled splitters deal the turns to ranges of their order; each range is sorted and
    summed by its own task, and the ranges' sums, a row for each conversation in a
    range, give where it begins.  Slots are aggregates of their turns; windows are
    numbered by running counts over blocks of slots, and over the blocks' sums.
    """
    keys = ["conv_at", "turn_at", "role", "begin"]
    # null sorts first
    least = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.coalesce(c, F.lit(0)).alias("value"))
    rows = rows.withColumns({"conv_at": F.coalesce("conv_id", F.lit(-(1 << 63))), "turn_at": F.coalesce("turn", F.lit(-(1 << 63))), "begin": F.left("text", F.lit(PREFIX))})
    ranges = RANGES * partitions(rows.sparkSession)
    dealt = rows.withColumn("range", range_of(keys, splitters(rows, keys, ranges))).drop("conv_at", "turn_at", "begin").withColumn("conv", least("conv_id"))
    inside = Window.partitionBy("range", "conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    # the order among equal turns is chosen once, when the rows are written
    ordered = cut(dealt.withColumns({"nth": F.row_number().over(inside), "upto": F.sum("n").over(inside)}))
    totals = ordered.groupBy("conv", "range").agg(F.max("nth").alias("turns"), F.max("upto").alias("tokens"), F.min_by(F.struct("role", "n"), "nth").alias("first"))
    by_range = Window.partitionBy("conv").orderBy("range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first("first").over(by_range.rowsBetween(Window.unboundedPreceding, 0))
    starts = totals.select("conv", "range", F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"), F.when(opening["role"] == "system", opening["n"]).otherwise(0).alias("head"))
    rows = ordered.join(starts, ["conv", "range"]).withColumn("pos", F.col("turns_before") + F.col("nth"))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("end", F.col("tokens_before") + F.col("upto") - F.col("head"))
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.col("head"))
    rows = rows.withColumn("slot", F.floor(F.greatest(F.col("end") - 1, F.lit(0)) / stride))

    crossing = ~F.col("system") & (F.col("end") - F.col("n") < F.col("slot") * stride)
    fresh = F.when(F.col("system"), 0).otherwise(F.col("n"))
    slots = rows.groupBy("conv", "slot").agg(F.first("head").alias("head"), F.count(F.lit(1)).alias("rows"), F.sum(fresh).alias("sum"), F.max("end").alias("slot_end"), F.max(F.when(crossing, F.struct(F.col("n").alias("n"), F.col("end").alias("end")))).alias("cross"))
    slots = slots.withColumn("alone", F.col("cross").isNotNull() & (F.col("sum") > stride))
    slots = slots.withColumn("parts", F.when(F.col("alone") & (F.col("rows") > 1), 2).otherwise(1)).withColumn("block", F.floor(F.col("slot") / BLOCK))
    blocks = slots.groupBy("conv", "block").agg(F.sum("parts").alias("parts"))
    by_block = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("parts").over(by_block), F.lit(0)).alias("windows_before"))
    in_block = Window.partitionBy("conv", "block").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("within", F.coalesce(F.sum("parts").over(in_block), F.lit(0))).join(blocks, ["conv", "block"])
    first = F.col("windows_before") + F.col("within") + 1
    part = lambda number, window, total, end: F.struct(F.lit(number).alias("part"), window.alias("window"), total.alias("window_sum"), end.alias("window_end"))
    lone = part(0, first, F.col("cross.n"), F.col("cross.end"))
    rest = part(1, first + F.col("alone").cast("long"), F.col("sum") - F.when(F.col("alone"), F.col("cross.n")).otherwise(0), F.col("slot_end"))
    both = F.when(F.col("parts") == 2, F.array(lone, rest)).when(F.col("alone"), F.array(lone)).otherwise(F.array(rest))
    parts = cut(slots.select("conv", "slot", "head", F.explode(both).alias("p")).select("conv", "slot", "head", "p.*"))
    after = parts.select("conv", (F.col("window") - 1).alias("window"), F.col("window_sum").alias("next_sum"))
    room = F.least(F.lit(history), budget - F.col("head") - F.coalesce("next_sum", F.lit(0)))
    parts = parts.join(after, ["conv", "window"], "left").select("conv", "slot", "part", "window", "window_end", room.alias("room"), F.col("next_sum").isNotNull().alias("followed"))
    by_slot = parts.groupBy("conv", "slot").agg(*[F.max(F.when(F.col("part") == i, F.struct("window", "window_end", "room", "followed"))).alias(f"part{i}") for i in (0, 1)])
    rows = rows.join(by_slot, ["conv", "slot"])
    mine = F.when(crossing & F.col("part0").isNotNull(), F.col("part0")).otherwise(F.col("part1"))
    rows = rows.withColumn("mine", mine).select("*", "mine.*")
    # only a conversation's system turn asks for its last window
    last = parts.groupBy(F.col("conv").alias("of")).agg(F.max("window").alias("last"))
    asked = rows.where("system").select("conv").join(last, F.col("conv") == F.col("of")).select("conv", "last", F.lit(True).alias("system"))
    return rows.join(asked, ["conv", "system"], "left")


def _formatted(rows: DataFrame) -> DataFrame:
    place = lambda w, kind: F.struct(w.cast("int").alias("window"), F.lit(kind).alias("kind"))
    nowhere = F.array().cast("array<struct<window:int,kind:int>>")
    later = F.when(F.col("system") & (F.col("last") > 1), F.transform(F.sequence(F.lit(2).cast("long"), F.greatest(F.col("last").cast("long"), F.lit(2))), lambda w: place(w, 0))).otherwise(nowhere)
    near = ~F.col("system") & F.col("followed") & (F.col("window_end") - F.col("end") + F.col("n") <= F.col("room"))
    again = F.when(near, F.array(place(F.col("window") + 1, 1))).otherwise(nowhere)
    placed = rows.withColumn("at", F.explode(F.concat(F.array(place(F.col("window"), 2)), later, again)))
    head, body = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(END)), escaped(F.col("text"))
    turns = placed.select("conv_id", F.col("at.window").alias("window"), F.col("at.kind").alias("kind"), "pos", (F.col("role") == "assistant").alias("target"), head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    inside = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("start", F.sum(size).over(inside) - F.length("body") - len(CLOSE))
    span = F.when(F.col("target") & (F.col("kind") == 2), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    one = F.struct("kind", "pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
    grouped = turns.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_context"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=tokens_of, long: int = LONG) -> DataFrame:
    """conv_id, window (from 1), n_context (leading turns that are repeated), formatted, loss_spans.

    Conversations of over ``long`` turns are placed by ranges, the others each in one
    task; windows are the same.  A count of turns tells which is which.
    """
    rows = _turns(conversations, tokens)
    counts = conversations.groupBy(F.col("conv_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("turns"))
    # at most one row for every ``long`` turns of the table
    hot = cut(counts.where(F.col("turns") > long).select("id"))
    if hot.isEmpty():
        return _formatted(_placed(rows, budget, history))
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    few = _formatted(_placed(rows.join(hot, same, "left_anti"), budget, history))
    return few.unionByName(_formatted(_placed_by_ranges(rows.join(hot, same, "left_semi"), budget, history)))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per window from the formatted text alone: new turns (role, text) and the unescaped text under the mask."""
    parts = F.split("formatted", CLOSE, -1)
    fresh = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, END, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substr(part, F.length(head) + len(END) + 1)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.transform(fresh, turn).alias("turns"), F.array_join(masked, "").alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(formatted).select("conv_id", F.struct("window", F.size("turns").cast("long").alias("n"), text.alias("body"), "loss", "chars").alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda w: w["body"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
