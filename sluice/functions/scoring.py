"""Scores, bands, percentages, costs.

Scores are FLOAT and thresholds DOUBLE: comparisons widen the float, so 0.7f lies below 0.7.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands from worst to best, with their short labels; the last two are visible.
BANDS = ("Low", "MediumLow", "MediumHigh", "HighQuality")
BAND_SHORT = ("L", "ML", "MH", "HQ")
VISIBLE_RANK = 2


def normalize(score: Column, threshold: Column) -> Column:
    """F1: the score moved so that the threshold becomes 0.5, linear on both sides; FLOAT. NaN is refused."""
    s, t = score.cast("double"), threshold.cast("double")
    s = F.when(F.isnan(s), F.raise_error(F.lit("a score is NaN")).cast("double")).otherwise(s)
    low = F.when(t == 0, F.lit(0.5)).otherwise(s * 0.5 / t)
    raw = F.when(s <= t, low).otherwise((0.5 * s + 0.5 - t) / F.nullif(1 - t, F.lit(0.0)))
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).cast("float")


def band_rank(normalized: Column) -> Column:
    """0 to 3, cut at a quarter, a half and three quarters; null stays null."""
    n = normalized.cast("double")
    return F.when(n.isNull(), F.lit(None)).when(n < 0.25, 0).when(n < 0.5, 1).when(n < 0.75, 2).otherwise(3).cast("int")


def rank_of_band(name: Column) -> Column:
    """rank of a band name, null for any other string."""
    return F.when(F.array_position(F.array(*map(F.lit, BANDS)), name) > 0, F.array_position(F.array(*map(F.lit, BANDS)), name) - 1).cast("int")


def band_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, BANDS)), rank)


def band_short(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, BAND_SHORT)), rank)


def is_visible(rank: Column) -> Column:
    return rank >= VISIBLE_RANK


def item_band(score: Column, threshold: Column, override: Column) -> Column:
    """the reviewer's band, else the score's, else MediumLow while the model is unknown."""
    return F.coalesce(rank_of_band(override), band_rank(normalize(score, threshold)), F.lit(1))


def is_positive(score: Column, threshold: Column) -> Column:
    """F14."""
    return score.cast("double") >= threshold.cast("double")


def percentage(part: Column, total: Column) -> Column:
    """FLOAT in 0 to 100, 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(100.0 * part / total).cast("float")


def match_percent(found: Column, examined: Column) -> Column:
    """F25."""
    return F.when(examined == 0, F.lit(0.0)).otherwise(100.0 * found / examined)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """exact decimal cost from prices per million tokens."""
    big = lambda c: c.cast("decimal(18,0)")
    return ((big(tokens_in) * price_in.cast("decimal(12,6)") + big(tokens_out) * price_out.cast("decimal(12,6)")) / F.lit(Decimal(1_000_000))).cast("decimal(38,12)")


def round_cost(usd: Column, places: int = 4) -> Column:
    """midpoints go to the even digit."""
    return F.bround(usd, places)


def sample_size(budget: Column, iterations: Column, cost_per_item: Column) -> Column:
    """items that each iteration can pay for; an error when that is none."""
    n = F.floor(budget / iterations / cost_per_item).cast("long")
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("the budget doesn't pay for one item")).cast("long"))


def accept(pinned_recall: Column, baseline: Column, tolerance: float = 0.01) -> Column:
    """the gate of a new model."""
    return pinned_recall >= baseline - tolerance


def missing_note(group_exists: Column, url_exists: Column) -> Column:
    """what is gone, null if nothing."""
    return F.when(~group_exists, "post gone").when(~url_exists, "image gone")


def wait_quantile(count: Column, window_seconds: Column, q: float) -> Column:
    """Whole milliseconds until the next match with probability q, exponential waiting."""
    rate = count.cast("double") / (window_seconds.cast("double") * 1000)
    return F.when((count > 0) & (window_seconds > 0), F.round(-F.log(F.lit(1 - q)) / rate)).cast("long")


def predict_next(count: Column, start: Column, now: Column) -> Column:
    """struct(lower, middle, upper) of timestamps, null without matches or window."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(start)) / 1_000_000)
    at = [F.timestamp_millis(F.unix_millis(now) + wait_quantile(count, seconds, q)).alias(n) for n, q in (("lower", 0.025), ("middle", 0.5), ("upper", 0.975))]
    return F.when((count > 0) & (seconds > 0), F.struct(*at))
