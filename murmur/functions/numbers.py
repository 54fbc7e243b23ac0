"""Numeric expressions: model output and market capitalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import NEGATIVE, NEUTRAL, POSITIVE

_CAP = r"^([+-]?(?:\d+\.?\d*|\.\d+))([TBM])$"


def net_sentiment(logits: Column) -> Column:
    """P(positive) - P(negative) after a softmax over three logits.

    The largest logit is subtracted first, so ``exp`` cannot overflow.
    """
    negative = F.get(logits, F.lit(NEGATIVE)).cast("double")
    neutral = F.get(logits, F.lit(NEUTRAL)).cast("double")
    positive = F.get(logits, F.lit(POSITIVE)).cast("double")
    top = F.greatest(negative, neutral, positive)
    total = F.exp(negative - top) + F.exp(neutral - top) + F.exp(positive - top)
    return (F.exp(positive - top) - F.exp(negative - top)) / total


def market_cap(text: Column) -> Column:
    """``1.2T``, ``3B``, ``4.5M`` to dollars; anything else is NULL."""
    amount = F.regexp_extract(text, _CAP, 1).try_cast("double")
    unit = F.regexp_extract(text, _CAP, 2)
    return amount * F.when(unit == "T", F.lit(1e12)).when(unit == "B", F.lit(1e9)).when(unit == "M", F.lit(1e6))
