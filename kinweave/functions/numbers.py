"""Integer functions of the dataflow operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The first twelve primes. As Miller-Rabin bases they decide every 64-bit integer;
# the first four already decide every integer below 3 215 031 751.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
_FOUR_WITNESS_LIMIT = 3_215_031_751
_LONG_MAX = 2**63 - 1
_LONG_SQUARE_LIMIT = 3_037_000_499  # largest n with (n-1)^2 inside a 64-bit integer


def _probable_prime(n: Column, base: Column, wide: bool) -> Column:
    """One Miller-Rabin round for odd n > base; exact products (decimal when wide)."""
    kind = "decimal(38,0)" if wide else "bigint"

    def times_mod(a: Column, b: Column) -> Column:
        if wide:
            return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)") % n.cast("decimal(19,0)")).cast(kind)
        return a * b % n

    bits = F.reverse(F.split(F.bin(n - 1), ""))  # least significant first; all are '0' or '1'
    twos = F.array_position(bits, "1") - 1  # n-1 = odd * 2^twos
    odd_bits = F.reverse(F.slice(bits, (twos + 1).cast("int"), F.size(bits)))
    start = F.aggregate(
        odd_bits,
        F.lit(1).cast(kind),
        lambda acc, bit: F.when(
            bit == "1", times_mod(times_mod(acc, acc), base.cast(kind))
        ).otherwise(times_mod(acc, acc)),
    )
    squares = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), twos.cast("bigint")),
        F.struct(start.alias("x"), F.lit(False).alias("hit")),
        lambda acc, _: F.struct(
            times_mod(acc["x"], acc["x"]).alias("x"),
            (acc["hit"] | (acc["x"] == (n - 1).cast(kind))).alias("hit"),
        ),
    )
    return (start == 1) | squares["hit"]


def is_prime(n: Column) -> Column:
    """Exact primality of any 64-bit integer inside the JVM, without a table of primes."""
    n = n.cast("bigint")
    small = F.lit(False)
    divisible = F.lit(False)
    for p in WITNESSES:
        small = small | (n == p)
        divisible = divisible | (n % p == 0)
    def passes(bases: tuple[int, ...], wide: bool) -> Column:
        return F.forall(F.array(*[F.lit(p) for p in bases]), lambda base: _probable_prime(n, base, wide))

    limit = min(_FOUR_WITNESS_LIMIT, _LONG_SQUARE_LIMIT)
    return (
        F.when(n <= 1, False)
        .when(small, True)
        .when(divisible, False)
        .when(n < 37 * 37, True)
        .when(n < limit, passes(WITNESSES[:4], False))
        .otherwise(passes(WITNESSES, True))
    )


def is_twin_prime(n: Column) -> Column:
    """n and n + 2 are both prime; the cheap residue test comes first. False where n + 2 is no 64-bit integer."""
    n = n.cast("bigint")
    other = F.when(n <= _LONG_MAX - 2, n + 2)
    return ((n == 3) | (n % 6 == 5)) & is_prime(n) & F.coalesce(is_prime(other), F.lit(False))
