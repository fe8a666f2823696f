"""Random draws that only the seed, the row's key and a label decide: the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, label: str, *key: Column) -> Column:
    """52 bits of an MD5 of seed, label and key, in [0, 1); other engines can draw the same."""
    digest = F.md5(F.concat_ws("/", F.lit(str(int(seed))), F.lit(label), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def normal(seed: int, label: str, *key: Column) -> Column:
    """A standard normal by the Box-Muller transform of two uniforms."""
    u, v = uniform(seed, f"{label}/u", *key), uniform(seed, f"{label}/v", *key)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
