"""Position sizes and stop levels, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def size_uncertainty(variance: Column, initial: float = 1.0) -> Column:
    """1 at a tenth of the initial variance or less, 0 at a hundred times of it or more, and even in its logarithm between; 1 without variance."""
    low, high = math.log(0.1 * initial), math.log(100 * initial)
    place = (F.log(_clip(variance, 0.1 * initial, 100 * initial)) - low) / (high - low + 1e-10)
    return F.when(variance <= 0, 1.0).otherwise(_clip(1 - place, 0.0, 1.0))


def size_vol_target(close: Column, uncertainty: Column, k: float = 2.0, risk: float = 0.02, most: float = 3.0) -> Column:
    """Leverage at which a stop k uncertainties away loses `risk` of the capital, at most `most`."""
    return _clip(risk * close / (k * uncertainty * close + 1e-10), 0.0, most)


def size_regime_vol(multiple: Column, vol_ratio: Column, base: float = 1.0) -> Column:
    """The base size times the regime's multiple, divided by volatility over its mean (0.5 to 2); the base size where that is unknown."""
    return F.coalesce(base * multiple / _clip(vol_ratio, 0.5, 2.0), F.lit(base))


def stop_price(close: Column, direction: Column, uncertainty: Column, k: float = 2.0) -> Column:
    """k uncertainties on the losing side; null without a position."""
    return F.when(direction != 0, close - direction * k * uncertainty)


def log_level(price: Column, direction: Column, sd: Column, k: float) -> Column:
    """The price k log standard deviations on: with k < 0 a stop below a long entry's average, with k > 0 the next entry of a pyramid; null without a position."""
    return F.when(direction != 0, price * F.exp(direction * k * sd))
