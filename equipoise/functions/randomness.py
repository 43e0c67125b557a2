"""Reproducible randomness as Column expressions.

Every draw is a function of (tag, seed, row key), so a result does not depend on
partitioning, task retries or lost executors, and any engine with md5 can
reproduce it.  ``tag`` separates independent streams drawn for the same row.

A plain ``int`` seed hashes with md5; a :class:`FastSeed` hashes with Spark's
compiled xxhash64, several times cheaper per row but known to Spark only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 12  # 12 hex digits = 48 bits, exactly representable in a double
_SPAN = float(1 << 48)
_HALF = float(1 << 32)
_WRITTEN_OUT = 64
_WIDE_POISSON = 10_000.0


class FastSeed(int):
    """A seed whose draws use xxhash64 instead of md5."""


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _hash64(keys: Sequence[str | Column], seed: int, tag: str) -> Column:
    return F.xxhash64(F.lit(f"{tag}|{int(seed)}"), *_columns(keys))


def _texts(keys: Sequence[str | Column]) -> list[Column]:
    """Key parts as text; a null is a text of its own, so that (1, null, 2) and (1, 2, null) draw apart."""
    return [F.coalesce(c.cast("string"), F.lit("\x00")) for c in _columns(keys)]


def _digest(keys: Sequence[str | Column], seed: int, tag: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{tag}|{seed}"), *_texts(keys)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, even where ``use`` loops over an array."""
    return F.transform(F.array(value), use)[0]


def _unit(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / F.lit(_SPAN)


def uniform(keys: Sequence[str | Column], seed: int, tag: str) -> Column:
    """U[0, 1) with 48 random bits."""
    if isinstance(seed, FastSeed):
        return F.shiftrightunsigned(_hash64(keys, seed, tag), 16).cast("double") / F.lit(_SPAN)
    return _unit(_digest(keys, seed, tag))


def _halves(h: Column) -> tuple[Column, Column]:
    """Two 32-bit uniforms of a 64-bit hash."""
    high = F.shiftrightunsigned(h, 32).cast("double") / F.lit(_HALF)
    return high, h.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") / F.lit(_HALF)


def _normal_pair(u: Column, v: Column) -> Column:
    """Two N(0, 1) draws from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u))
    polar = F.struct(radius.alias("r"), (F.lit(2.0 * math.pi) * v).alias("a"))
    return bind(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"])))


def _part(digest: Column, start: int) -> Column:
    """A 32-bit uniform of eight hex digits."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(_HALF)


def normal_sources(keys: Sequence[str | Column], seed: int, tag: str, count: int) -> list[Column]:
    """The hashes behind ``count`` draws of :func:`gaussians`; add them as columns for :func:`normals_from`."""
    if isinstance(seed, FastSeed):
        return [_hash64([*keys, F.lit(b)], seed, tag) for b in range((count + 1) // 2)]
    return [_digest([*keys, F.lit(b)], seed, tag) for b in range((count + 3) // 4)]


def normals_from(sources: Sequence[Column], seed: int, count: int) -> list[Column]:
    """The draws of :func:`gaussians` as separate expressions, which stay inside generated code."""
    out = []
    for j in range(count):
        if isinstance(seed, FastSeed):
            u, v = _halves(sources[j // 2])
        else:
            start = 1 + 16 * (j % 4 // 2)
            u, v = _part(sources[j // 4], start), _part(sources[j // 4], start + 8)
        angle = F.lit(2.0 * math.pi) * v
        out.append(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * (F.sin(angle) if j % 2 else F.cos(angle)))
    return out


def gaussians(keys: Sequence[str | Column], seed: int, tag: str, count: int) -> Column:
    """``count`` independent N(0, 1) draws as an array, from 32-bit uniforms.

    A 64-bit hash gives two draws, a digest four.
    """
    if isinstance(seed, FastSeed):

        def two(block: Column) -> Column:
            return bind(_hash64([*keys, block], seed, tag), lambda h: _normal_pair(*_halves(h)))

        blocks = F.sequence(F.lit(0), F.lit((count - 1) // 2))
        return F.slice(F.flatten(F.transform(blocks, two)), 1, count)

    stem = F.concat_ws("|", F.lit(f"{tag}|{seed}"), *_texts(keys))
    blocks = F.sequence(F.lit(0), F.lit((count - 1) // 4))

    def four(stem: Column, block: Column) -> Column:
        digest = F.md5(F.concat_ws("|", stem, block.cast("string")))
        return bind(
            digest, lambda d: F.concat(_normal_pair(_part(d, 1), _part(d, 9)), _normal_pair(_part(d, 17), _part(d, 25)))
        )

    drawn = bind(stem, lambda s: F.flatten(F.transform(blocks, lambda b: four(s, b))))
    return F.slice(drawn, 1, count)


def poisson_cdf(rate: float) -> tuple[int, list[float]]:
    """(first value, cumulative probabilities from it) up to a tail below 1e-12."""
    spread = 8.5 * math.sqrt(rate) + 20.0
    low = max(0, math.floor(rate - spread))
    log_rate = math.log(rate)
    total, cdf = 0.0, []
    for n in range(low, math.ceil(rate + spread) + 1):
        total += math.exp(n * log_rate - rate - math.lgamma(n + 1.0))
        cdf.append(total)
        if n > rate and 1.0 - total < 1e-14:
            break
    return low, cdf


def poisson(u: Column, rate: float) -> Column:
    """Poisson(rate) count for the uniform ``u`` by inversion (int Column).

    Give ``u`` as a column of the table rather than an expression: short tables of
    cumulative probabilities are written out as one comparison each, which compiles
    to straight code but mentions ``u`` once per step.

    A rate above 10,000 is cut into equal parts below it: the sum of independent Poisson counts, each
    with a uniform that follows from ``u``, has the same law, and the table stays short.
    """
    if rate < 0:
        raise ValueError("a Poisson rate cannot be negative")
    if rate == 0:
        return F.lit(0)
    if rate > _WIDE_POISSON:
        parts = math.ceil(rate / _WIDE_POISSON)
        drawn = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: poisson(uniform([u, i], 0, "poisson-part"), rate / parts))
        return F.aggregate(drawn, F.lit(0), lambda a, n: a + n)
    low, cdf = poisson_cdf(rate)
    if len(cdf) <= _WRITTEN_OUT:
        return reduce(add, [(u > c).cast("int") for c in cdf], F.lit(low))
    steps = F.lit(cdf)
    return F.lit(low) + bind(u, lambda v: F.size(F.filter(steps, lambda c: c < v)))


def driver_uniform(seed: int, *parts: object) -> float:
    """The same U[0, 1) on the driver, for one-off draws such as a class size."""
    text = "|".join(str(p) for p in (parts[0], seed, *parts[1:]))
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16) / _SPAN


def derive_seed(seed: int, *parts: object) -> int:
    """An independent 31-bit seed for a member, round or fold, of the same kind."""
    text = "|".join(str(p) for p in ("seed", seed, *parts))
    return type(seed)(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) & 0x7FFFFFFF)
