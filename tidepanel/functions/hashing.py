"""Hash expressions whose value is the same in any engine that has md5."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, functions as F

#: A 32-bit draw, as hex text, below entry k is at most k under a Poisson law of mean 1; larger values than 12 have no such draw.
POISSON_BOUNDS = [f"{int(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))):08x}" for k in range(12)]


def md5_int(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the '|'-joined parts, as a non-negative BIGINT."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_sum(h: Column) -> Column:
    """Order-insensitive sum of hashes, exact for any number of rows."""
    return F.sum(h.cast("decimal(38,0)"))


def draw_index(n: Column, *parts: Column | str) -> Column:
    """Reproducible draw from 0..n-1, a function of the parts only (never of task or partition)."""
    return F.pmod(md5_int(*parts), n)


def key_text(*cols: str) -> Column:
    """Keys as one string, dates in ISO form, NULL marked."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])


def poisson_draw(*parts: Column | str) -> Column:
    """The hash, as hex text, that a Poisson weight follows from."""
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def weight_of(h: Column) -> Column:
    """Poisson weight of mean 1 of a draw; hex digits compare as the number does."""
    weight = F.when(h < POISSON_BOUNDS[0], 0.0)
    for k, bound in enumerate(POISSON_BOUNDS[1:], 1):
        weight = weight.when(h < bound, float(k))
    return weight.otherwise(float(len(POISSON_BOUNDS)))


def poisson_weight(*parts: Column | str) -> Column:
    """Reproducible Poisson weight of mean 1, a function of the parts only."""
    return weight_of(poisson_draw(*parts))
