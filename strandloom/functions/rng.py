"""Counter-based random numbers: a hash of the seed, the step, the row's key and the number of the draw.

They don't depend on partitions, retries or the order of evaluation, are deterministic to the optimiser, and any SQL
engine with md5 gives the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0


def text_key(seed: int, step: str, *parts: Column | str | int) -> Column:
    cols = [F.lit(str(seed)), F.lit(step)]
    cols += [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *cols)


def uniform(seed: int, step: str, *parts: Column | str | int) -> Column:
    """A double in [0, 1) for the key."""
    return F.conv(F.substring(F.md5(text_key(seed, step, *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(TWO52)


def uniform_py(seed: int, step: str, *parts: object) -> float:
    """The same number in Python."""
    return int(hashlib.md5("|".join(map(str, (seed, step, *parts))).encode()).hexdigest()[:13], 16) / TWO52


def generator(seed: int, step: str, *parts: object) -> np.random.Generator:
    """A numpy generator of its own for a row, for kernels that need many draws."""
    digest = hashlib.md5("|".join(map(str, (seed, step, *parts))).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "big") & ((1 << 128) - 1)))


def geometric(u: Column, p: float) -> Column:
    """The first success among trials of probability p, from a uniform number: at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.log(1 - u) / F.lit(float(np.log1p(-p))))).cast("bigint")


def integer(u: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("bigint")
