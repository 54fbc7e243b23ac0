"""Conversations as training strings in windows of a token budget, in built-in functions only.

The template puts each turn between an opening and a closing control string:

    [SYS]text\\n[/SYS]      system
    [INST]text\\n[/INST]    user
    [OUT]text\\n</s>        assistant
    [ROLE]role\\n[/ROLE]text\\n</s>      any other

A control string inside a text or role gets a backslash before it, and one more
if it has some; reading takes one away. The template's own control strings never
follow a backslash, as a line break stands before each closing one. No control
string holds another or begins as one ends, so escaping is reversible.

A conversation is cut between turns into windows. Prefix sums of the turns'
tokens tell how far a window reaches. Each window after the system turn starts
with it, then repeats the last turns before its first new one, as far as
``history`` turns, a quarter of the budget and the first new turn allow. New
turns follow while the budget holds them. A turn that is longer than the budget
by itself is a window of its own: texts are never cut. Only texts of new
assistant turns are under the loss mask, so each is learned once.

Turns are worked on in stretches of ``SPAN`` turn numbers, so a conversation of
any length is spread over tasks. A window does not reach over the end of a
stretch; its history and system turn do, as the few rows for that are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that are worked on together.
SPAN = 256
#: The share of the budget that repeated turns may take.
HISTORY_SHARE = 0.25

_OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
_CLOSE = {"system": "[/SYS]", "user": "[/INST]"}
CONTROLS = (*_OPEN.values(), "[ROLE]", *_CLOSE.values(), "[/ROLE]", "</s>")
_ANY = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS)
_TURN = r"(?s)(\[SYS\]|\[INST\]|\[OUT\]|\[ROLE\].*?\n\[/ROLE\])(.*?)\n(?:\[/SYS\]|\[/INST\]|</s>)"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
_FIRST = -(2**62)  # the stretch of turns without a number, before all others


def escaped(text: Column) -> Column:
    """The text with a backslash before each control string."""
    return F.regexp_replace(text, f"({_ANY})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_ANY})", "$1")


def _case(role: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def opening(role: Column) -> Column:
    return _case(role, _OPEN, F.concat(F.lit("[ROLE]"), escaped(role), F.lit("\n[/ROLE]")))


def closing(role: Column) -> Column:
    return F.concat(F.lit("\n"), _case(role, _CLOSE, F.lit("</s>")))


def tokens(text: Column) -> Column:
    """Words and marks of a text, and two for the template."""
    return F.regexp_count(text, F.lit(_TOKEN)) + 2


def _turns(rows: DataFrame, together: bool, history: int) -> DataFrame:
    """(conv_id, span, turns): the turns of each stretch in order, with the repeated ones that it needs."""
    span = F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(_FIRST))
    turns = rows.withColumn("span", span)
    # the last turns of a stretch are repeated in the next
    ahead = F.floor((F.col("turn") + history) / SPAN).cast("long")
    spans = F.when(ahead > F.col("span"), F.array("span", ahead)).otherwise(F.array("span"))
    placed = turns.select("*", F.explode(spans).alias("at"))
    placed = placed.select("conv_id", "at", F.when(F.col("at") > F.col("span"), 1).otherwise(2).alias("kind"), "turn", "role", "text", "size")
    # the first system turn, in every later stretch
    first = turns.where("role = 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("span", "turn", "text", "size")).alias("s"))
    later = turns.where(F.col("span") > _FIRST).groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    later = later.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).where(F.col("span") > F.col("s.span"))
    system = later.select(
        "conv_id", F.col("span").alias("at"), F.lit(0).alias("kind"), "s.turn", F.lit("system").alias("role"), "s.text", "s.size"
    )
    every = placed.unionByName(system).repartition(*(["conv_id"] if together else ["conv_id", "at"]))
    held = every.groupBy("conv_id", F.col("at").alias("span")).agg(F.array_sort(F.collect_list(F.struct("kind", "turn", "role", "text", "size"))).alias("rows"))
    # a stretch may be there only for its history
    return held.where(F.exists("rows", lambda r: r["kind"] == 2))


def _windows(held: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, span, window, turns, new): the turns of each window, and from which on they are new."""
    rows = F.col("rows")
    system = F.get(F.filter(rows, lambda r: r["kind"] == 0), F.lit(0))
    turns = F.filter(rows, lambda r: r["kind"] > 0)
    own = F.filter(turns, lambda r: r["kind"] == 2)
    held = held.select("conv_id", "span", system.alias("carried"), turns.alias("turns"), (F.size(turns) - F.size(own)).alias("before"))
    # turns by number from 0; prefix sums of their tokens; the system turn that is carried, or the stretch's first
    sums = F.expr("aggregate(turns, array(0L), (p, t) -> array_append(p, element_at(p, -1) + t.size))")
    at = F.expr("array_position(transform(turns, t -> t.kind = 2 and t.role = 'system'), true) - 1").cast("int")
    held = held.withColumn("sums", sums).withColumn("at", F.when(F.col("carried").isNull(), at).otherwise(F.lit(-1)))
    held = held.withColumn("system", F.when(F.col("carried").isNull() & (F.col("at") >= 0), F.get("turns", F.col("at"))).otherwise(F.col("carried")))
    # get() and not [], as Spark may look before it leaves out the stretches without turns of their own
    # by each turn as the first new one: where the history starts
    room = f"({budget} - if(at < i, coalesce(system.size, 0), 0))"
    first = f"greatest(i - {history}, at + 1 - if(at >= i, at + 1, 0), 0)"
    fits = f"get(sums, i) - get(sums, j) <= {int(budget * HISTORY_SHARE)} and get(sums, i + 1) - get(sums, j) <= {room}"
    starts = F.expr(f"transform(sequence(0, size(turns) - 1), i -> coalesce(get(filter(sequence({first}, i), j -> {fits}), 0), i))")
    held = held.withColumn("starts", starts)
    # a window goes on while its tokens from the start of its history hold
    cuts = F.expr(
        f"""aggregate(sequence(before, size(turns) - 1), array(before), (cuts, e) -> if(
            e = before or get(sums, e + 1) - get(sums, get(starts, element_at(cuts, -1)))
                <= {budget} - if(at < element_at(cuts, -1), coalesce(system.size, 0), 0),
            cuts, array_append(cuts, e)))"""
    )
    held = held.withColumn("cuts", cuts)
    # outer, as Spark tests the size of an inner one's input apart, and would work out all of the above again for it
    each = held.select("*", F.posexplode_outer("cuts").alias("window", "first"))
    end = F.coalesce(F.get("cuts", F.col("window") + 1), F.size("turns"))
    start = F.get("starts", F.col("first"))
    lead = F.when(F.col("at") < F.col("first"), F.filter(F.array("system"), lambda s: s.isNotNull())).otherwise(F.slice("turns", 1, 0))
    body = F.slice("turns", start + 1, end - start)
    return each.select("conv_id", "span", "window", F.concat(lead, body).alias("turns"), (F.size(lead) + F.col("first") - start).alias("repeated"))


def chat_windows(
    conversations: DataFrame, budget: int = 1024, history: int = 2, size: Column | None = None, together: bool = False
) -> DataFrame:
    """One row per window: (conv_id, span, window, formatted, n_turns, repeated, loss).

    ``formatted`` is the training string, ``n_turns`` its turns, of which the
    first ``repeated`` are the system turn or history, and ``loss`` the (start,
    end) of each text to learn, in code points of the string, from 0. Windows of
    a conversation are in order by span and window. ``size`` counts the tokens
    of the column ``text``, at least one a turn.

    A null text or role is empty. Turns go by number, then role, then text; those
    without a number come first. Repeated rows are turns of their own. Rows
    without a conv_id are one conversation. ``together`` keeps each conversation
    in one task, for results that need it whole. Other columns play no part, and
    an empty table gives no window.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("size", F.greatest((tokens(F.col("text")) if size is None else size).cast("long"), F.lit(1)))
    windows = _windows(_turns(rows, together, history), budget, history)
    made = F.transform("turns", lambda t: F.struct(opening(t["role"]).alias("open"), escaped(t["text"]).alias("text"), closing(t["role"]).alias("close"), (t["role"] == "assistant").alias("learn")))
    windows = windows.withColumn("made", made)
    strings = F.transform("made", lambda m: F.concat(m["open"], m["text"], m["close"]))
    lengths = F.transform("made", lambda m: F.struct(F.length(m["open"]).alias("open"), F.length(m["text"]).alias("text"), F.length(m["close"]).alias("close")))
    windows = windows.select("conv_id", "span", "window", "repeated", "made", F.array_join(strings, "").alias("formatted"), lengths.alias("lengths"))
    places = F.expr("aggregate(lengths, array(0), (p, n) -> array_append(p, element_at(p, -1) + n.open + n.text + n.close))")
    windows = windows.withColumn("places", places)
    loss = F.expr(
        """transform(filter(sequence(0, size(made) - 1), i -> i >= repeated and made[i].learn),
            i -> struct(places[i] + lengths[i].open as start, places[i] + lengths[i].open + lengths[i].text as end))"""
    )
    return windows.select("conv_id", "span", "window", "formatted", F.size("made").alias("n_turns"), "repeated", loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a training string."""
    heads = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))

    def role(head: Column) -> Column:
        other = unescaped(F.regexp_replace(head, r"^\[ROLE\]|\n\[/ROLE\]$", ""))
        return _case(head, {}, F.coalesce(*(F.when(head == o, F.lit(r)) for r, o in _OPEN.items()), other))

    return F.zip_with(heads, texts, lambda h, t: F.struct(role(h).alias("role"), unescaped(t).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its training strings alone: turns without the repeated ones, learned text, length."""
    new = F.expr("slice(turns, repeated + 1, size(turns))")
    read = windows.select("conv_id", "span", "window", "repeated", F.length("formatted").cast("long").alias("n"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    read = read.withColumn("turns", new)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.select("conv_id", "n", F.struct("span", "window", F.size("turns").alias("n_turns"), F.array_join(lines, "").alias("lines"), F.array_join("learned", "").alias("learned")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("formatted_chars"))
    learned = F.array_join(F.transform("w", lambda w: w["learned"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + w["n_turns"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda w: w["lines"]), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
