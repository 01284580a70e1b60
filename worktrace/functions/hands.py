"""Expressions over hand landmarks: arrays of points [x, y, z]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_round(value: Column, digits: int = 4) -> Column:
    """A double rounded; what becomes zero keeps its sign (Spark's round drops it)."""
    short = F.round(value, digits)
    return F.when(short == 0, value * F.lit(0.0)).otherwise(short)


def rounded(landmarks: Column, digits: int = 4) -> Column:
    return F.transform(landmarks, lambda p: F.transform(p, lambda v: signed_round(v, digits)))


def active(hands: Column) -> Column:
    """Either hand has landmarks."""
    return (F.coalesce(F.size(hands["left_hand"]), F.lit(0)) > 0) | (F.coalesce(F.size(hands["right_hand"]), F.lit(0)) > 0)


def summary(landmarks: Column) -> Column:
    """wrist_xy, mean_x, mean_y (4 digits) and landmark_count; points of fewer than two coordinates don't count in the means. Null for no hand."""
    full = F.filter(landmarks, lambda p: F.size(p) >= 2)

    def mean(k: int) -> Column:
        total = F.aggregate(full, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(k)))
        return F.when(F.size(full) > 0, signed_round(total / F.size(full)))

    out = F.struct(
        F.slice(F.get(landmarks, F.lit(0)), 1, 2).alias("wrist_xy"), mean(0).alias("mean_x"), mean(1).alias("mean_y"),
        F.size(landmarks).alias("landmark_count")
    )
    return F.when(F.size(landmarks) > 0, out)
