"""Chat formatting in budgeted windows, by DataFrame functions only.

Prefix sums of turn costs place every turn in its conversation. From them windows are filled greedily with whole turns. A window
holds the conversation's system turn, a limited tail of the turns before it, and as many turns of its own as the budget leaves
room for. The loss mask covers the assistant texts of a window's own turns only, so each assistant text is a target once. A turn
that exceeds a window's share is cut into pieces, which carry on under a mark of their own; no other turn is cut.

A turn's cost is the octets of its formatted form. That bounds its tokens for every vocabulary whose tokens stand for an octet or
more, so no window has more tokens than the budget. Callers with exact counts pass their own column.

Sums run within (conversation, range of turn numbers) and are put together from the ranges' totals; greedy filling starts anew at
each ``SEGMENT`` budgets of a conversation. So a task holds a bounded part of a conversation, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>\n"
#: Octets of a window (about 1,024 tokens of ordinary text), and of the tail that it repeats.
BUDGET, HISTORY = 4096, 768
#: A system turn is retained if it takes at most this share of the budget.
SYSTEM_SHARE = 4
#: Budgets of a conversation after which filling starts anew, and turn numbers whose turns are summed up together.
SEGMENT, RANGE = 16, 4096


def escape(text: Column, line_end: bool = False) -> Column:
    r"""No ``<|`` is left: a backslash goes before each ``\`` and each ``|`` behind ``<`` (and, for roles, each line end)."""
    return F.regexp_replace(text, r"[\\\n]|(?<=<)\|" if line_end else r"\\|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(role: Column, text: Column, more: Column) -> Column:
    return F.concat(F.when(more, MORE).otherwise(START), escape(role, True), F.lit("\n"), escape(text), F.lit(END))


def _pieces(turns: DataFrame, share: int) -> DataFrame:
    """Turns, those above ``share`` in pieces: key, range, at, piece, turn, role, h (of the whole text), cost, shown, n, m."""
    by = Window.partitionBy("key", "range").orderBy("turn", "role", "text")
    t = turns.withColumn("at", F.row_number().over(by)).withColumn("shown", rendered(F.col("role"), F.col("text"), F.lit(False)))
    t = t.withColumn("cost", F.coalesce("given", F.octet_length("shown"))).withColumn("room", share - F.octet_length(escape(F.col("role"), True)) - len(START + "\n" + END))
    # octets that a sign takes at most
    widest = (
        F.when(F.octet_length("shown") == F.char_length(F.col("text")) + F.char_length(F.col("role")) + len(START + "\n" + END), 1)
        .when(F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"), 4).when(F.col("text").rlike(r"[\x{800}-\x{FFFF}]"), 3).otherwise(2)
    )
    per = F.floor(F.col("room") / widest)
    long = (F.col("cost") > share) & (per > 0)
    cut = F.when(long, F.regexp_extract_all(F.col("text"), F.concat(F.lit("(?s).{1,"), F.greatest(per, F.lit(1)).cast("string"), F.lit("}")), F.lit(0))).otherwise(F.array("text"))
    t = t.withColumn("long", long).withColumn("h", F.xxhash64("text")).select("key", "range", "at", "turn", "role", "h", "long", "cost", "shown", F.posexplode(cut).alias("piece", "text"))
    shown = F.when(F.col("long"), rendered(F.col("role"), F.col("text"), F.col("piece") > 0)).otherwise(F.col("shown"))
    return t.select(
        "key", "range", "at", "piece", "turn", "role", "h", F.when(F.col("long"), F.octet_length(shown)).otherwise(F.col("cost")).cast("long").alias("cost"), shown.alias("shown"),
        F.char_length(shown).alias("n"), F.char_length(escape(F.col("text"))).alias("m"),
    )


def format_windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, cost: Column | None = None
) -> DataFrame:
    """One row per window: conv_id, window, formatted, repeated, loss (array of start, end; code points), tokens.

    ``window``: cost of the conversation's turns before the window's own ones; it orders the windows. ``repeated``: how many
    leading turns (or pieces) were in an earlier window. ``tokens``: the cost of all that the window holds. The first turn of
    role ``system`` is the one that later windows retain, if it takes at most a quarter of the budget.

    Nulls: a null text or role is empty; null turns come first; rows with a null conversation form one conversation. Equal turn
    numbers are ordered by role, then text, and repeated rows are turns of their own; only their number can make one task's part
    of a conversation large. No window exceeds the budget, unless a role is so long that it takes up a whole share itself: such
    a turn isn't cut. Texts of any length are formatted whole, an empty table gives an empty table, and other columns play no part.
    """
    most_system = budget // SYSTEM_SHARE
    share = budget - history - most_system
    if history < 0 or share < 64:
        raise ValueError(f"a budget of {budget} with a history of {history} leaves no room for turns")
    number = F.col(f"`{turn}`")
    ranged = isinstance(turns.schema[turn].dataType, (T.NumericType, T.DateType, T.TimestampType))
    seconds = F.unix_date(number) if isinstance(turns.schema[turn].dataType, T.DateType) else number.cast("double")
    t = turns.select(
        F.struct(F.col(f"`{conv}`").alias("conv_id")).alias("key"),  # a struct with a null field equals another one
        (F.coalesce(F.floor(seconds / RANGE), F.lit(-(1 << 62))) if ranged else F.lit(0)).cast("long").alias("range"),
        number.alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        (F.lit(None) if cost is None else cost).cast("long").alias("given"),
    )
    pieces = _pieces(t, share)
    totals = pieces.groupBy("key", "range").agg(F.sum("cost").alias("cost"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("key", "range", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "range").orderBy("at", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("sum", F.sum("cost").over(inside)).join(totals, ["key", "range"]).withColumn("end", F.col("base") + F.col("sum")).withColumn("begin", F.col("end") - F.col("cost"))
    placed = placed.withColumn("own", F.floor(F.col("begin") / (SEGMENT * budget)))
    # the tail of a segment goes to the next one, too, for the windows that repeat it
    homes = F.when(F.col("begin") >= (F.col("own") + 1) * (SEGMENT * budget) - history, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
    item = F.struct("begin", "end", (F.col("own") != F.col("home")).alias("tail"), "turn", "role", "h", "cost", "shown", "n", "m")
    segments = placed.withColumn("home", F.explode(homes)).groupBy("key", "home").agg(F.array_sort(F.collect_list(item)).alias("items"))
    system = (
        t.where("role = 'system'").groupBy("key").agg(F.min(F.struct("turn", "text", "role", "given")).alias("s"))
        .withColumn("shown", rendered(F.col("s.role"), F.col("s.text"), F.lit(False)))
        .withColumn("cost", F.coalesce("s.given", F.octet_length("shown")).cast("long")).where(F.col("cost") <= most_system)
        .select("key", F.struct(F.col("s.turn").alias("turn"), F.col("s.role").alias("role"), F.xxhash64("s.text").alias("h"), "cost", "shown", F.char_length("shown").alias("n")).alias("system"))
    )
    joined = segments.join(system, "key", "left")
    s = F.col("system")

    def after(x: Column) -> Column:
        """Whether an item stands behind the system turn (equal numbers are ordered by role, equal roles by text)."""
        same = (x["role"] == s["role"]) & (x["h"] == s["h"]) & x["turn"].eqNullSafe(s["turn"])
        return s.isNotNull() & (F.struct(x["turn"], x["role"]) >= F.struct(s["turn"], s["role"])) & ~same

    def extra(x: Column) -> Column:
        """What a window that begins with ``x`` holds besides its own turns."""
        first = F.array_min(F.transform(F.filter("items", lambda y: y["begin"] >= x["begin"] - history), lambda y: y["begin"]))
        return x["begin"] - first + F.when(after(x), s["cost"]).otherwise(F.lit(0).cast("long"))

    none = F.array().cast("array<bigint>")
    filled = F.aggregate(
        F.filter("items", lambda x: ~x["tail"]),
        F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("extra"), none.alias("starts")),
        lambda a, x: F.when((a["start"] >= 0) & (a["extra"] + x["end"] - a["start"] <= budget), a).otherwise(
            F.struct(x["begin"].alias("start"), extra(x).alias("extra"), F.concat(a["starts"], F.array(x["begin"])).alias("starts"))
        ),
        lambda a: a["starts"],
    )
    joined = joined.withColumn("starts", filled)

    def window(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.lit(1 << 62))
        return F.struct(start.alias("start"), F.filter("items", lambda x: (x["begin"] >= start - history) & (x["begin"] < stop)).alias("items"))

    w = joined.select("key", "system", F.explode(F.transform("starts", window)).alias("w")).select("key", "system", F.col("w.start").alias("window"), F.col("w.items").alias("items"))
    w = w.withColumn("retained", F.coalesce(after(F.get("items", F.lit(0))), F.lit(False)))
    spans = F.aggregate(
        F.col("items"),
        F.struct(F.when(F.col("retained"), s["n"]).otherwise(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + x["n"]).alias("pos"),
            F.when(
                (x["role"] == "assistant") & (x["begin"] >= F.col("window")),
                F.concat(a["out"], F.array(F.struct((a["pos"] + x["n"] - len(END) - x["m"]).alias("start"), (a["pos"] + x["n"] - len(END)).alias("end")))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    shown = F.concat(F.when(F.col("retained"), s["shown"]).otherwise(""), F.array_join(F.transform("items", lambda x: x["shown"]), ""))
    repeated = F.size(F.filter("items", lambda x: x["begin"] < F.col("window"))) + F.col("retained").cast("int")
    tokens = F.aggregate("items", F.when(F.col("retained"), s["cost"]).otherwise(F.lit(0).cast("long")), lambda a, x: a + x["cost"])
    return w.select(F.col("key.conv_id").alias("conv_id"), "window", shown.alias("formatted"), repeated.alias("repeated"), spans.alias("loss"), tokens.alias("tokens"))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted window: array of (role, text, more), unescaped; more: the piece carries on a turn."""
    parts = F.filter(F.split(formatted, r"(?=<\|im_(?:start|more)\|>)", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        more = F.startswith(p, F.lit(MORE))
        mark = F.when(more, len(MORE)).otherwise(len(START))
        body = F.substr(p, mark + 1, F.char_length(p) - mark - len(END))
        head = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(body, F.char_length(head) + 2)).alias("text"), more.alias("more"))

    return F.transform(parts, turn)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: what the turns and the loss mask hold, each turn once.

    conv_id (null for the conversation without an id), n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Empty texts
    and roles are turns like others; an empty table gives an empty table. A digest of a whole conversation needs its text in one
    place; this is a report on the windows, not a part of them.
    """
    turns = F.slice(parse(F.col("formatted")), F.col("repeated") + 1, 2**30)
    w = windows.select("conv_id", "window", turns.alias("own"), "loss", "formatted").select(
        "conv_id", "window",
        F.size(F.filter("own", lambda x: ~x["more"])).cast("long").alias("n"),
        F.array_join(F.transform("own", lambda x: F.when(x["more"], x["text"]).otherwise(F.concat(F.lit("\n"), x["role"], F.lit("\n"), x["text"]))), "").alias("said"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("learnt"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    learnt = F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    said = F.array_join(F.transform("w", lambda x: x["said"]), "")
    return g.select(
        "conv_id", "n_turns",
        F.sha2(F.concat(F.substr(said, F.lit(2)), F.lit("\n")), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )
