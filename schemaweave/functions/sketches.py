"""A cardinality sketch of 1,024 registers over a 64-bit hash of UTF-16 units.

Registers are the largest ranks by index; they merge by maximum, so a DataFrame aggregates them as one more group-by.
Hashing runs in Arrow batches, since wrap-around multiplication overflows under ANSI arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 10
REGISTERS = 1 << PRECISION
RELATIVE_ERROR = 1.04 / math.sqrt(REGISTERS)
#: Offset and prime of FNV-1a 64 and the multipliers of the 64-bit finaliser: fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def hash_units(texts: list[str]) -> np.ndarray:
    """FNV-1a over UTF-16 units, finished by two multiply-xorshift steps; all texts advance unit by unit together."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    lengths = np.array([len(u) for u in units])
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    if len(texts):
        wide = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint64)
        for k, u in enumerate(units):
            wide[k, : len(u)] = u
        for j in range(wide.shape[1]):
            live = j < lengths
            h[live] = (h[live] ^ wide[live, j]) * np.uint64(FNV_PRIME)
    for factor in (MIX_A, MIX_B):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def registers(values: DataFrame, column: str, by: str) -> DataFrame:
    """by, index, rank: the registers of each group."""

    @F.pandas_udf("idx int, rnk int")
    def place(texts: pd.Series) -> pd.DataFrame:
        h = hash_units(list(texts))
        index = (h >> np.uint64(64 - PRECISION)).astype(np.int32)
        rest = h << np.uint64(PRECISION)
        rank = np.array([64 - PRECISION + 1 if x == 0 else 64 - int(x).bit_length() + 1 for x in rest.tolist()], np.int32)
        return pd.DataFrame({"idx": index, "rnk": np.minimum(rank, 64 - PRECISION + 1)})

    placed = values.select(by, place(F.col(column)).alias("p")).select(by, "p.idx", "p.rnk")
    return placed.groupBy(by, "idx").agg(F.max("rnk").alias("rnk"))


def estimate(regs: DataFrame, by: str) -> DataFrame:
    """by, estimate: harmonic mean of the registers, linear counting while it is small."""
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = regs.groupBy(by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rnk"))).alias("s"), F.count("*").alias("used"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("used")))
    empty = m - F.col("used")
    small = (raw <= 2.5 * m) & (empty > 0)
    return sums.select(by, F.round(F.when(small, m * F.log(m / empty)).otherwise(raw)).cast("long").alias("estimate"))
