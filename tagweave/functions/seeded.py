"""Deterministic pseudo-random numbers from column values, in plain integer
arithmetic so that any SQL engine evaluates them identically (the oracle
SQL uses ``seeded_int_sql``).  Stable under repartitioning: a value depends
only on the row's own columns and the seed.

Per input value c (taken mod P first): h = ((h + c) * A) mod P; then one
non-linear round h = (h * h + 1) mod P breaks the lattice a purely linear
map leaves between neighbouring inputs, and a final multiply spreads it.
Every intermediate stays below 2^62, so 64-bit arithmetic never overflows
(safe in ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Park-Miller "minimal standard" generator constants.
MODULUS = 2147483647  # 2^31 - 1, prime
MULTIPLIER = 48271


def seeded_int(*cols: Column, seed: int = 0) -> Column:
    """Integer in [0, MODULUS) from the given integer columns and the seed."""
    p, a = F.lit(MODULUS).cast("bigint"), F.lit(MULTIPLIER).cast("bigint")
    h = F.lit(seed % MODULUS).cast("bigint")
    for c in cols:
        h = F.pmod((h + F.pmod(c.cast("bigint"), p)) * a, p)
    return F.pmod(F.pmod(h * h + 1, p) * a, p)


def seeded_unit(*cols: Column, seed: int = 0) -> Column:
    """Double in [0, 1)."""
    return seeded_int(*cols, seed=seed).cast("double") / float(MODULUS)


def seeded_int_sql(cols: list[str], seed: int = 0) -> str:
    """The same function as SQL text (non-negative modulo written out)."""
    p, a = MODULUS, MULTIPLIER
    h = str(seed % p)
    for c in cols:
        h = f"((({h} + ((CAST({c} AS BIGINT) % {p}) + {p}) % {p}) * {a}) % {p})"
    return f"(((({h} * {h} + 1) % {p}) * {a}) % {p})"


def seeded_unit_sql(cols: list[str], seed: int = 0) -> str:
    return f"(CAST({seeded_int_sql(cols, seed)} AS DOUBLE) / {MODULUS})"
