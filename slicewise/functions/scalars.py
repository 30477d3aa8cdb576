"""Scalar formulas as column expressions. None of them uses a Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicewise import dims


def clip(x: Column, lo: float, hi: float | None = None) -> Column:
    low = F.greatest(x, F.lit(float(lo)))
    return low if hi is None else F.least(low, F.lit(float(hi)))


def log_scaled(x: Column) -> Column:
    """log1p of a duration in ms, kept within ten minutes."""
    return F.log1p(clip(x, 0.0, 600000.0))


def logistic(rho: Column, k: Column, rho_c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (rho - rho_c)))


def inverse_logistic(p: Column, k: Column, rho_c: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return rho_c - F.log(1.0 / q - 1.0) / k


def observed_load(thr: Column, capacity: Column, lost: Column) -> Column:
    """Offered load from mean throughput and the fraction of late packets."""
    return (F.when(lost >= 0.99, F.lit(2.0))
            .when(lost > 0.01,
                  F.least(thr / F.greatest(capacity * (1.0 - lost), F.lit(1e-6)), F.lit(3.0)))
            .otherwise(thr / F.greatest(capacity, F.lit(1e-6))))


def predicted_load(p: Column, thr: Column, capacity: Column, k: Column, rho_c: Column) -> Column:
    """Offered load from a forecast violation fraction, kept in [0.01, 3]."""
    return (F.when(p >= 0.99, F.lit(2.0))
            .when(p > 0.01, clip(inverse_logistic(p, k, rho_c), 0.01, 3.0))
            .otherwise(clip(clip(thr, 0.0) / F.greatest(capacity, F.lit(1e-6)), 0.01, 3.0)))


def throughput_load(thr: Column, capacity: Column, top: float = 2.0) -> Column:
    return clip(thr / F.greatest(capacity, F.lit(1e-6)), 0.0, top)


def queue_latency(thr: Column, capacity: Column, base: Column) -> Column:
    """Mean waiting time of a queue, used where no delay was measured."""
    rho = F.least(F.lit(0.99), thr / capacity)
    wait = F.when(rho > 0, (rho / (1.0 - rho)) * 0.5).otherwise(F.lit(50.0))
    return F.greatest(F.lit(0.1), base + wait)


def relaxed_latency_limit(slice_: Column, limit: Column) -> Column:
    return F.when(slice_ == "mMTC", F.lit(dims.RELAXED_MMTC_LATENCY)).otherwise(limit)


def unit_cost(n: Column, rho: Column, units_default: Column, rate: Column, k: Column,
              rho_c: Column, thr_min: Column) -> Column:
    """Cost of giving ``n`` units to a slice whose load under the default units is ``rho``."""
    offered = rho * units_default * rate
    p = logistic(rho * units_default / n, k, rho_c)
    served = F.least(offered, n * rate) * (1.0 - p)
    shortfall = F.when(offered >= thr_min, clip(1.0 - served / thr_min, 0.0)).otherwise(F.lit(0.0))
    return F.round(dims.WEIGHT_THROUGHPUT * shortfall + dims.WEIGHT_LOSS * p, 9)


def live_unit_cost(n: Column, rho: Column, units_default: Column, rate: Column, k: Column,
                   rho_c: Column, thr_min: Column, priority: Column) -> Column:
    """Variant used by the live controllers: priority on loss, penalty without the loss factor."""
    offered = rho * units_default * rate
    p = logistic(rho * units_default / n, k, rho_c)
    shortfall = clip(thr_min - F.least(offered, n * rate), 0.0) / F.greatest(thr_min, F.lit(1e-9))
    return F.round(dims.WEIGHT_THROUGHPUT * shortfall + dims.WEIGHT_LOSS * priority * p, 9)


def gain_pct(f_default: Column, f_optimal: Column) -> Column:
    return F.round((f_default - f_optimal) / F.greatest(f_default, F.lit(1e-9)) * 100.0, 1)


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and key: a row draws the same number in
    every run, retry and partitioning."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: str, *keys: str) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(f"{seed}a", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(f"{seed}b", *keys))


def relative_noise(x: Column, noise: float, seed: int, *keys: str) -> Column:
    """Gaussian noise whose spread follows the size of the value; none when noise is 0. ``keys``
    name the row."""
    if noise == 0:
        return x
    return x + normal(str(seed), *keys) * (F.abs(x) * noise + 1e-6)
