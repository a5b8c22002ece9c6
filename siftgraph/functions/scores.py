"""Scores to derived scores, predictions and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMULAS = ("pe", "emc", "enn")
RATIO_FLOOR = 1e-8
ANALYSIS_RATIO_FLOOR = 1e-9


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def derive_score(pe, pc, formula: str, floor: float = RATIO_FLOOR) -> Column:
    """pe, pe - pc ("emc"), or pe / (pe + pc) with a floored denominator ("enn")."""
    e, c = _c(pe), _c(pc)
    if formula == "pe":
        return e
    if formula == "emc":
        return e - c
    if formula == "enn":
        return e / F.greatest(e + c, F.lit(floor))
    raise ValueError(f"unknown formula {formula!r}")


def threshold_pred(score, threshold: float, strict: bool = False) -> Column:
    """1/0 prediction; inclusive for model scores, strict for vote shares and the baseline."""
    s = _c(score)
    hit = s > threshold if strict else s >= threshold
    return hit.cast("tinyint")


def coerce_flag(col) -> Column:
    """Text or number to 1/0: unparseable and null count as 0, else value > 0.5."""
    value = F.coalesce(_c(col).try_cast("double"), F.lit(0.0))
    return (value > 0.5).cast("int")


def token_cost(tokens_in, tokens_out, price_in, price_out) -> Column:
    """Cost with prices per million tokens."""
    return (_c(tokens_in) * _c(price_in) + _c(tokens_out) * _c(price_out)) / 1e6


def labelled(label) -> Column:
    return _c(label).isNotNull()


def in_range(col, low, high) -> Column:
    """Half-open range test."""
    return (_c(col) >= low) & (_c(col) < high)
