"""Sampling by hash, duplicate and overlap checks, key discovery, counting in flight."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.keyed import null_safe_join


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint32(r) | x >> np.uint32(32 - r)


def _scramble(k: np.ndarray) -> np.ndarray:
    return _rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur_texts(texts: list[str], seed: int) -> np.ndarray:
    """MurmurHash3 (32 bits) over pairs of UTF-16 units, the second in the low half, as the Scala library hashes strings: all texts step by step together."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    units, at = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint32), np.cumsum(size) - size
    h = np.full(len(texts), seed, np.uint32)
    own = np.argsort(-size, kind="stable")  # those still going come first
    ends = np.searchsorted(-size[own], -np.arange(2, (size.max(initial=0) // 2) * 2 + 1, 2), side="right")
    for step, n in enumerate(ends):
        i = own[:n]
        k = (units[at[i] + 2 * step] << np.uint32(16)) + units[at[i] + 2 * step + 1]
        h[i] = _rotl(h[i] ^ _scramble(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    odd = np.flatnonzero(size % 2)
    h[odd] ^= _scramble(units[at[odd] + size[odd] - 1])
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def hash_sample(df: DataFrame, key: Column | str, rate: float = 0.01, seed: int = 23) -> DataFrame:
    """Rows whose key's hash falls under the rate: a key's rows share their fate, in every run. Null keys don't stay. ``fast_sample`` needs no Python, but
    takes other keys."""
    limit = 0x7FFFFFFF * rate

    @F.pandas_udf("boolean")
    def keep(c: pd.Series) -> pd.Series:
        codes, known = pd.factorize(c)  # each key once; null is -1
        under = (murmur_texts(known.tolist(), seed) & np.uint32(0x7FFFFFFF)) < limit
        return pd.Series(np.append(under, False)[codes])

    return df.where(keep((F.col(key) if isinstance(key, str) else key).cast("string")))


def fast_sample(df: DataFrame, key: Column | str, rate: float = 0.01, seed: int = 23) -> DataFrame:
    """Like ``hash_sample`` with Spark's own hash: other keys, no Python."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(rate * 1_000_000))


def pipe_count(df: DataFrame, name: str = "pipe") -> tuple[DataFrame, Observation]:
    """The frame, and an observation whose ``get["n"]`` is the number of rows once an action has run; retries don't count twice."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def dupe_check(df: DataFrame, keys: Sequence[str], n: int | None = 10_000) -> DataFrame:
    """Among the first n rows (all if None) those whose keys occur again, with their number ``_N``: keys, ``_N``, the rest. Null keys are equal.

    Only counts of keys are grouped; whole rows meet those that occur again. Sort by the keys to see them side by side."""
    own = df if n is None else df.limit(n)
    again = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N")).where("_N > 1")
    return null_safe_join(own, again, keys).select(*keys, "_N", *(c for c in df.columns if c not in keys))


def discover_key(df: DataFrame, n: int | None = 10_000) -> tuple[list[str], int]:
    """Columns that tell the first n rows (all if None) apart, found greedily, and the number of distinct values: one aggregation a round."""
    own = (df if n is None else df.limit(n)).cache()
    try:
        chosen: list[str] = []
        best = 0
        while left := [c for c in df.columns if c not in chosen]:
            text = lambda c: F.concat_ws("\x1f", *(F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in [*chosen, c]))
            counts = own.agg(*(F.count_distinct(text(c)).alias(c) for c in left)).first()
            top = max(left, key=lambda c: counts[c])
            if counts[top] <= best:
                break
            chosen.append(top)
            best = counts[top]
        return chosen, best
    finally:
        own.unpersist()


def overlap_check(key: str, *frames: DataFrame) -> DataFrame:
    """Each key with a string of 1 and 0: whether each frame has it. One grouping; a key is one row however often it occurs; null keys are left out."""
    tagged = None
    for i, f in enumerate(frames):
        d = f.select(F.col(key)).where(F.col(key).isNotNull()).select(key, *(F.lit(1 if j == i else 0).alias(f"__{j}") for j in range(len(frames))))
        tagged = d if tagged is None else tagged.union(d)
    g = tagged.groupBy(key).agg(*(F.max(f"__{j}").alias(f"__{j}") for j in range(len(frames))))
    return g.select(key, F.concat(*(F.col(f"__{j}").cast("string") for j in range(len(frames)))).alias("flag"))
