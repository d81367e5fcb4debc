"""Counter-based random numbers: a draw depends only on (seed, stream, draw), not on partitions or order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Multipliers and key steps of Philox4x32, multipliers of the SplitMix64 finaliser, the label of row samples.
M0, M1, W0, W1, ROUNDS = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85, 10
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SAMPLE_LABEL = 4994076164431785653
#: Least weight of a draw without replacement that isn't taken for zero.
LEAST_WEIGHT = 2.05e-307

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def mix64(x: int) -> int:
    x &= (1 << 64) - 1
    x = (x ^ (x >> 30)) * MIX_A % (1 << 64)
    x = (x ^ (x >> 27)) * MIX_B % (1 << 64)
    return x ^ (x >> 31)


def derived_key(seed: int, label: int) -> int:
    return mix64(mix64(seed) ^ (label & ((1 << 64) - 1)))


def philox(block: np.ndarray, stream: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four words of each block."""
    c = [block & _LOW, block >> _32, stream & _LOW, stream >> _32]
    k0, k1 = key & 0xFFFFFFFF, key >> 32
    for _ in range(ROUNDS):
        p, q = c[0] * np.uint64(M0), c[2] * np.uint64(M1)
        c = [(q >> _32) ^ c[1] ^ np.uint64(k0), q & _LOW, (p >> _32) ^ c[3] ^ np.uint64(k1), p & _LOW]
        k0, k1 = (k0 + W0) & 0xFFFFFFFF, (k1 + W1) & 0xFFFFFFFF
    return tuple(c)


def words64(draw: np.ndarray, stream: np.ndarray | int, key: int) -> np.ndarray:
    """The 64-bit word of each 1-based draw; draws below 1 count as 1."""
    e = np.maximum(np.asarray(draw, dtype=np.int64), 1).astype(np.uint64) - np.uint64(1)
    s = np.broadcast_to(np.asarray(stream, dtype=np.int64).view(np.uint64) if np.ndim(stream) else np.uint64(stream & ((1 << 64) - 1)), e.shape)
    w = philox(e >> np.uint64(1), s, key)
    odd = (e & np.uint64(1)).astype(bool)
    return np.where(odd, w[2] | (w[3] << _32), w[0] | (w[1] << _32))


def uniforms(draw: np.ndarray, stream: np.ndarray | int = 0, key: int = 0) -> np.ndarray:
    """Doubles in [0, 1): the upper 53 bits of each word."""
    return (words64(draw, stream, key) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def uniform(draw: Column, seed: int, label: int | None = None, stream: Column | int = 0) -> Column:
    """A uniform number for each row, by an Arrow-batched function of the draw number."""
    key = seed & ((1 << 64) - 1) if label is None else derived_key(seed, label)

    @F.pandas_udf("double")
    def draw_uniform(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, s in batches:
            yield pd.Series(uniforms(d.to_numpy(np.int64), s.to_numpy(np.int64), key))

    return draw_uniform(draw.cast("long"), (stream if isinstance(stream, Column) else F.lit(stream)).cast("long"))


def exponential(draw: Column, seed: int, label: int | None = None) -> Column:
    return -F.log1p(-uniform(draw, seed, label))


def normal(draw: Column, seed: int) -> Column:
    """Standard normal numbers by Box and Muller from draws 2d-1 and 2d."""
    d = draw.cast("long")
    return F.sqrt(-2 * F.log1p(-uniform(2 * d - 1, seed))) * F.cos(2 * 3.141592653589793 * uniform(2 * d, seed))


def sample(df: DataFrame, row: str, fraction: float, seed: int) -> DataFrame:
    """Bernoulli rows by their 1-based physical number: kept if u < fraction, whatever the partitions."""
    return df.where(uniform(F.col(row), seed, SAMPLE_LABEL) < fraction)


def _keyed(df: DataFrame, row: str, seed: int) -> DataFrame:
    return df.withColumn("__u", uniform(F.col(row), seed))


def permutation(df: DataFrame, row: str, seed: int, to: str = "place") -> DataFrame:
    """Every row's 1-based place in a random order."""
    from ..operators.sorting import argsort

    return argsort(_keyed(df, row, seed), ["__u"], row, to).drop("__u")


def subset(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the n least of the rows' random numbers."""
    return _keyed(df, row, seed).orderBy("__u", row).limit(n).drop("__u")


def weighted_subset(df: DataFrame, row: str, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement by successive sampling: the least of -log(u) / w; rows of no weight come last, in random order."""
    w = F.col(weight).cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a weight is null, negative or not finite")).cast("double")).otherwise(w)
    keyed = _keyed(df, row, seed).withColumn("__w", checked)
    first = F.col("__w") >= LEAST_WEIGHT
    key = F.when(first, -F.log(F.greatest(F.col("__u"), F.lit(2.0**-54))) / F.col("__w")).otherwise(F.col("__u"))
    return keyed.orderBy(F.when(first, 0).otherwise(1), key, row).limit(n).drop("__u", "__w")


def resample(df: DataFrame, row: str, n_rows: int, draws: int, seed: int, stream: int = 0) -> DataFrame:
    """``draws`` rows with replacement, joined by their drawn row number (1 to n_rows)."""
    picks = df.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw"), (F.floor(uniform(F.col("id"), seed, None, stream) * n_rows) + 1).alias("__pick"))
    return picks.join(df, F.col("__pick") == F.col(row)).drop("__pick")
