"""From metrics to positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.params import ENTRY_SENTIMENT, HOLD_SENTIMENT, MIN_COMMENTS


def position_signal(
    metrics: DataFrame,
    positions: DataFrame,
    *,
    min_comments: int = MIN_COMMENTS,
    entry: float = ENTRY_SENTIMENT,
    hold: float = HOLD_SENTIMENT,
) -> DataFrame:
    """``stock``, the position ``held`` and the ``signal`` for it.

    Without a position: with more than ``min_comments``, long above ``entry``
    percent and short below minus that. With one: it stays while sentiment is
    beyond ``hold`` on its side, else the signal is exit. ``none`` otherwise.
    """
    percent = F.col("total_avg") * 100
    enough = F.col("total_nb") > min_comments
    held = F.col("held")
    both = metrics.select("stock", "total_nb", "total_avg").join(positions.select("stock", "held"), "stock", "full")
    signal = (
        F.when(held == "long", F.when(percent > hold, "long").otherwise("exit"))
        .when(held == "short", F.when(percent < -hold, "short").otherwise("exit"))
        .when(enough & (percent > entry), "long")
        .when(enough & (percent < -entry), "short")
        .otherwise("none")
    )
    return both.select("stock", "held", signal.alias("signal"))


def position_history(
    daily: DataFrame,
    positions: DataFrame | None = None,
    *,
    min_comments: int = MIN_COMMENTS,
    entry: float = ENTRY_SENTIMENT,
    hold: float = HOLD_SENTIMENT,
) -> DataFrame:
    """``stock``, ``day``, the position ``held`` into the day and the ``signal`` of it, over all days.

    The rules of ``position_signal``, carried from day to day: what a signal
    enters is held into the stock's next day, an exit or none leaves nothing.
    ``daily`` has ``total_nb`` and ``total_avg`` by ``stock`` and ``day``, the key;
    ``positions`` what is held into the first day, nothing without it. A day
    without a mean exits.

    A stock's days are folded in order within one row, some 250 a year.
    """
    percent = F.col("total_avg") * 100
    enough = F.coalesce(F.col("total_nb") > min_comments, F.lit(False))
    enters = F.when(enough & (percent > entry), "long").when(enough & (percent < -entry), "short").otherwise("none")
    keeps = [F.coalesce(test, F.lit(False)).alias(name) for name, test in (("long", percent > hold), ("short", percent < -hold))]
    days = daily.select("stock", F.struct("day", enters.alias("enters"), *keeps).alias("d"))
    days = days.groupBy("stock").agg(F.array_sort(F.collect_list("d")).alias("days"))
    if positions is None:
        days = days.withColumn("held", F.lit(None).cast("string"))
    else:
        days = days.join(positions.select("stock", "held"), "stock", "left")
    none = F.lit(None).cast("string")
    start = F.struct(F.col("held").alias("held"), F.array().cast("array<struct<day: date, held: string, signal: string>>").alias("seen"))

    def step(state, d):
        held = state["held"]
        signal = F.when(held == "long", F.when(d["long"], "long").otherwise("exit")).when(
            held == "short", F.when(d["short"], "short").otherwise("exit")
        )
        signal = F.coalesce(signal, d["enters"])
        row = F.struct(d["day"].cast("date").alias("day"), held.alias("held"), signal.alias("signal"))
        after = F.when(signal.isin("long", "short"), signal).otherwise(none)
        return F.struct(after.alias("held"), F.array_append(state["seen"], row).alias("seen"))

    folded = days.select("stock", F.aggregate("days", start, step)["seen"].alias("seen"))
    return folded.select("stock", F.explode_outer("seen").alias("s")).select("stock", "s.day", "s.held", "s.signal")
