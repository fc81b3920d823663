"""Field-level agreement (J14): set F1 and scalar matches, with the conventions for empty values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import col
from .text import normalize, token_set


def set_f1(predicted: Column | str, gold: Column | str) -> Column:
    """F1 of two token sets: 1 if both are empty, 0 if one is."""
    p, g = F.size(col(predicted)), F.size(col(gold))
    both = F.size(F.array_intersect(predicted, gold))
    score = 2.0 * (both / p) * (both / g) / (both / p + both / g)
    return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0) | (both == 0), 0.0).otherwise(score)


def scalar_match(predicted: Column | str, gold: Column | str) -> Column:
    """1 if two values are equal when normalised, or have the same set of words; blanks match only blanks."""
    p, g = normalize(predicted), normalize(gold)
    blank = (p == "") | (g == "")
    return F.when(blank, p == g).otherwise((p == g) | (token_set(predicted) == token_set(gold))).cast("int")


def all_exact(scalars: list[Column], f1s: list[Column]) -> Column:
    out = F.lit(True)
    for s in scalars:
        out = out & (s == 1)
    for f in f1s:
        out = out & (f == 1.0)
    return out.cast("int")
