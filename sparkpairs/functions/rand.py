"""Keyed, partition-independent randomness.

Row-order random generators cannot be reproduced on a cluster (retries and
repartitioning reorder rows), so every draw is a pure function of
``(seed, purpose, key)``::

    h        = md5(concat_ws(':', seed, purpose, key...))
    u(h, s)  = int(h[8s : 8s+8], 16) / 2**32          s = 0..3, in [0, 1)

One digest gives four independent uniforms (gate, candidate, position,
alternative). The same arithmetic is bit-identical in DuckDB, which makes every
random operator checkable against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def digest(seed: int, purpose: str | None, *keys) -> Column:
    parts = [F.lit(str(seed))]
    if purpose is not None:
        parts.append(F.lit(purpose))
    parts += [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def uniform(h: Column, slot: int = 0) -> Column:
    """Uniform in [0, 1) from hex digits ``8*slot .. 8*slot+7`` of a digest."""
    return F.conv(F.substring(h, 1 + 8 * slot, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def draw_index(u: Column, n: Column) -> Column:
    """0-based index ``floor(u * n)``; caller guards ``n > 0``."""
    return F.floor(u * n).cast("int")


def pick(arr: Column, u: Column) -> Column:
    """Uniform element of an array, null when the array is empty."""
    return F.when(F.size(arr) > 0, F.try_element_at(arr, draw_index(u, F.size(arr)) + 1))


def sql_uniform(h: str, slot: int = 0) -> str:
    """DuckDB spelling of :func:`uniform` (used by the oracle SQL)."""
    return f"(('0x' || substr({h}, {1 + 8 * slot}, 8))::BIGINT / {TWO32})"


def sql_digest(seed: int, purpose: str | None, *keys: str) -> str:
    parts = [f"'{seed}'"] + ([f"'{purpose}'"] if purpose is not None else []) + [f"CAST({k} AS VARCHAR)" for k in keys]
    return f"md5(concat_ws(':', {', '.join(parts)}))"
