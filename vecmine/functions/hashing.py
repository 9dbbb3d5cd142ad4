"""Draws that depend only on (id, seed), never on partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
SCALE = float(2 ** (4 * HEX_DIGITS))


def hash_uniform(id_col: Column, seed) -> Column:
    """Uniform value in [0, 1): leading hex digits of md5(id|seed)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(id_col.cast("string"), F.lit("|"), seed.cast("string"))
    head = F.substring(F.md5(text), 1, HEX_DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(SCALE)


def hash_uniform_of(key, seed) -> float:
    """The same draw for one key on the driver."""
    return int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest()[:HEX_DIGITS], 16) / SCALE


def row_key(*cols: Column) -> Column:
    """60-bit integer key from several columns (for tables without a usable key)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")
