"""Tail of the standard normal distribution in plain column arithmetic."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Abramowitz and Stegun 26.2.17.
P = 0.2316419
B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def two_sided_p(z: Column) -> Column:
    a = F.abs(z)
    t = 1 / (1 + P * a)
    poly = F.lit(0.0)
    for b in reversed(B):
        poly = t * (b + poly)
    return F.least(F.lit(1.0), 2 * F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly)
