"""Deterministic pseudo-random numbers from built-in hash expressions.

Every random choice in this library (sampling, diffusion coins, thresholds,
surrogate keys) is a pure function of the row's key and a seed, so a lost task
recomputes exactly the same values and any SQL engine with ``md5`` can
reproduce them.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TWO_POW_32 = 4294967296.0
MIX_MODULUS = 2147483647          # 2^31 - 1
MIX_MULT_1 = 1103515245
MIX_ADD_1 = 12345
MIX_SHIFT = 13
MIX_MULT_2 = 69621
MIX_ADD_2 = 1
# ---------------------------------------------------------------------------


def _key(*parts) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def md5_u32(*parts, offset: int = 0) -> Column:
    """Unsigned 32-bit integer from 8 hex digits of md5('p1|p2|...') starting at ``offset``."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1 + offset, 8), 16, 10).cast("bigint")


def md5_unit(*parts, offset: int = 0) -> Column:
    """Uniform number in [0, 1) keyed by the parts."""
    return md5_u32(*parts, offset=offset) / F.lit(TWO_POW_32)


def mix_unit(salt_a: Column, salt_b: Column) -> Column:
    """Cheap integer mixer of two md5 salts -> [0, 1).

    Used for per-(article, edge) coins so the hot loop evaluates integer
    arithmetic instead of one md5 per candidate row.  All intermediate values
    stay below 2^62, so no overflow under ANSI mode.
    """
    x = F.pmod(salt_a.bitwiseXOR(salt_b), F.lit(MIX_MODULUS))
    x = F.pmod(x * F.lit(MIX_MULT_1) + F.lit(MIX_ADD_1), F.lit(MIX_MODULUS))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, MIX_SHIFT)) * F.lit(MIX_MULT_2) + F.lit(MIX_ADD_2),
               F.lit(MIX_MODULUS))
    return x / F.lit(float(MIX_MODULUS))


def mix_unit_array(salt_a, salt_b):
    """:func:`mix_unit` of two numpy arrays of salts (int64)."""
    x = (salt_a ^ salt_b) % MIX_MODULUS
    x = (x * MIX_MULT_1 + MIX_ADD_1) % MIX_MODULUS
    x = ((x ^ (x >> MIX_SHIFT)) * MIX_MULT_2 + MIX_ADD_2) % MIX_MODULUS
    return x / float(MIX_MODULUS)


def coins_below(salt_a, salt_b, p: float):
    """Where :func:`mix_unit` of two numpy arrays of salts (uint32) is below ``p``.

    2^31 - 1 is a Mersenne number: what stands above 31 bits is added to what stands below.
    """
    bits, modulus, one = np.uint64(31), np.uint64(MIX_MODULUS), np.uint64(1)
    x = (salt_a ^ salt_b).astype(np.uint64)
    t = x >> bits

    def fold():
        np.right_shift(x, bits, out=t)
        np.bitwise_and(x, modulus, out=x)
        np.add(x, t, out=x)

    def least():
        np.add(x, one, out=t)
        np.right_shift(t, bits, out=t)
        np.add(x, t, out=x)
        np.bitwise_and(x, modulus, out=x)
    fold()
    np.multiply(x, np.uint64(MIX_MULT_1), out=x)
    np.add(x, np.uint64(MIX_ADD_1), out=x)
    fold()
    fold()
    least()
    np.right_shift(x, np.uint64(MIX_SHIFT), out=t)
    np.bitwise_xor(x, t, out=x)
    np.multiply(x, np.uint64(MIX_MULT_2), out=x)
    np.add(x, np.uint64(MIX_ADD_2), out=x)
    fold()
    least()
    # the first number whose share of the modulus is not below p
    first = min(max(int(p * MIX_MODULUS) - 2, 0), MIX_MODULUS)
    while first < MIX_MODULUS and first / float(MIX_MODULUS) < p:
        first += 1
    return x < np.uint64(first)


def sql_md5_u32(expr_sql: str, offset: int = 0) -> str:
    """DuckDB twin of :func:`md5_u32` for an already-built key string expression."""
    return f"CAST(('0x' || substr(md5({expr_sql}), {1 + offset}, 8)) AS UBIGINT)::BIGINT"


def sql_key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_mix_unit(a: str, b: str) -> str:
    m = f"CAST({MIX_MODULUS} AS BIGINT)"
    x1 = f"(xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) % {m})"
    x2 = f"(({x1} * CAST({MIX_MULT_1} AS BIGINT) + {MIX_ADD_1}) % {m})"
    x3 = f"((xor({x2}, ({x2} >> {MIX_SHIFT})) * CAST({MIX_MULT_2} AS BIGINT) + {MIX_ADD_2}) % {m})"
    return f"({x3} / {float(MIX_MODULUS)})"
