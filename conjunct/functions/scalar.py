"""Column expressions of the study: safe logarithms, norms, bounds, token classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(x: Column, lam: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - lam, F.lit(0.0))


def safe_log(x: Column, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def roundoff_pad(x: Column) -> Column:
    return 1e-12 * F.greatest(F.lit(1.0), F.abs(x))


def centered_norm(s: Column, n: int) -> Column:
    """Norm of a centred 0/1 column of support s among n rows."""
    return F.sqrt(F.greatest(s - s * s / n, F.lit(0.0)))


def subtree_norm(s: Column, n: int) -> Column:
    """The largest centred norm of any subset of s rows."""
    return centered_norm(F.least(s, F.lit(n / 2)), n)


def projected_norm(s: Column, q: Column, d2: float, n: int) -> Column:
    """Norm that is left of a centred column after projecting out d; q is the column's product with d, d2 = |d|**2."""
    return F.sqrt(F.greatest(s - s * s / n - q * q / d2, F.lit(0.0)))


def ball_bound(total: Column, s: Column, radius: float, n: int) -> Column:
    """The largest |z'a| of any a in a ball around the reference."""
    return F.abs(total) + radius * centered_norm(s, n)


def mass_bound(positive: Column, negative: Column, s: Column, radius: float, n: int) -> Column:
    """The same for every set that contains this one."""
    return F.greatest(positive, negative) + radius * subtree_norm(s, n)


def two_ball_bound(a1: Column, a2: Column, s: Column, r1: float, r2: float, distance2: float, n: int, pad: bool = True) -> Column:
    """The largest |z'a| of any a in both of two balls, with the round-off pad (pad=False: without).

    a1 and a2 are z's products with the centres, which are sqrt(distance2) apart. Geometry: where the best point of one
    ball alone lies in the other ball, it is the answer; else the answer lies on the circle where the spheres meet, whose
    centre divides the way from the first to the second centre at `cut` and whose radius is `rim`. Balls that don't meet,
    or that have one centre, are bounded by the better of the two alone, which is never too small.
    """
    norm, apart = centered_norm(s, n), distance2**0.5
    alone = F.least(F.abs(a1) + r1 * norm, F.abs(a2) + r2 * norm)
    if apart and apart <= r1 + r2:
        cut = 0.5 + (r1 * r1 - r2 * r2) / (2 * distance2)
        rim = max(0.0, r1 * r1 - (cut * apart) ** 2) ** 0.5
        along = (a2 - a1) / apart  # z's part in the direction of the second centre
        across = F.sqrt(F.greatest(norm * norm - along * along, F.lit(0.0)))

        def towards(sign: int) -> Column:
            """The most of sign * z'a."""
            lean = F.try_divide(sign * along, norm)
            first_in_second = r1 * r1 - 2 * r1 * apart * lean + distance2 <= r2 * r2
            second_in_first = r2 * r2 + 2 * r2 * apart * lean + distance2 <= r1 * r1
            on_rim = sign * (a1 + cut * (a2 - a1)) + rim * across
            return F.when(~first_in_second & ~second_in_first, on_rim).when(second_in_first & ~first_in_second, sign * a2 + r2 * norm).otherwise(sign * a1 + r1 * norm)

        met = F.greatest(towards(1), towards(-1), F.lit(0.0))
        alone = F.when(norm > 0, met).otherwise(F.greatest(F.abs(a1), F.abs(a2)))
    return alone + roundoff_pad(alone) if pad else alone


def present(token: Column) -> Column:
    """Whether a residue token is a mutation: anything but '', '-' and '.'."""
    return ~F.trim(token).isin("", "-", ".")


def token_issue(token: Column) -> Column:
    """Class of a raw residue token."""
    t = F.trim(token)
    return (
        F.when(t.isNull() | (t == ""), "missing")
        .when(t.isin("-", "."), "reference")
        .when(t.rlike("[#~]"), "indel")
        .when(t.contains("*"), "stop")
        .when(t.rlike("^[A-Z]$"), "single")
        .when(t.rlike("^[A-Z]{2,}$"), "mixture")
        .otherwise("other")
    )


def expand_ranges(text: Column) -> Column:
    """'16-18,40' as an array of numbers, as written."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, "-"))
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.get(p, F.lit(0)).cast("int"), F.element_at(p, -1).cast("int"))))


def logsumexp(x: str) -> Column:
    """Aggregate: log of the sum of exponentials. The peak is an aggregate of its own, so x may be a window's frame."""
    return F.max(x) + F.ln(F.sum(F.exp(F.col(x))) / F.exp(F.max(x)))
