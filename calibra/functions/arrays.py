"""Column functions on logit and probability arrays; all stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(z: Column) -> Column:
    """z less its largest element."""
    return let(z, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: x - m)))


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return scaled_to_one(F.transform(centred(z), lambda x: F.exp(x / t)))


def scaled_to_one(e: Column) -> Column:
    return let(e, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def logsumexp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - m)))))


def nll_at(c: Column, y: Column, t: Column | float) -> Column:
    """Negative log likelihood of level y at temperature t, from centred logits c."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.log(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x / t))) - F.get(c, y) / t


def argmax(p: Column) -> Column:
    """The first index of the largest element, from 0."""
    return let(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def top(p: Column) -> Column:
    return F.array_max(p)


def entropy_confidence(p: Column) -> Column:
    """1 - H / ln K, within [0, 1]; 0 for a single option, where it is not defined."""

    def of(v: Column) -> Column:
        h = -F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))
        return F.when(F.size(v) < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log(F.size(v).cast("double")))))

    return let(p, of)


def margin(p: Column) -> Column:
    return let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def yes_confidence(p: Column) -> Column:
    return 2 * F.abs(p - 0.5)


def statement_logit(yes: Column, no: Column) -> Column:
    return logsumexp(yes) - logsumexp(no)


def off_mass(yes: Column, no: Column, norm: Column) -> Column:
    """Probability outside the yes and no tokens, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(logsumexp(yes) - norm) - F.exp(logsumexp(no) - norm)))


def rotations(n: Column, wanted: int) -> Column:
    """Evenly spread cyclic shifts of n options, at most `wanted`."""
    r = F.least(F.lit(wanted), n)
    return F.transform(F.sequence(F.lit(0), r - 1), lambda i: F.pmod(F.bround(i * n / r).cast("int"), n))


def unrotate(z: Column, shift: Column) -> Column:
    """Logits in option order from logits of options shifted left by shift."""
    return let(z, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, F.pmod(i - shift + F.size(v), F.size(v)))))


def mean_of(members: Column) -> Column:
    """Elementwise mean of an array of equally long arrays."""

    def of(ms: Column) -> Column:
        sums = F.aggregate(ms, F.transform(F.get(ms, F.lit(0)), lambda x: F.lit(0.0)), lambda acc, m: F.zip_with(acc, m, lambda a, b: a + b))
        return let(F.size(ms), lambda n: F.transform(sums, lambda x: x / n))

    return let(members, of)


def matrix_apply(x: Column, w: Column, b: Column, mean: Column, std: Column) -> Column:
    """softmax(W ((x - mean) / (std + 1e-6)) + b)."""
    scaled = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), std, lambda a, d: a / (d + 1e-6))
    return softmax(let(scaled, lambda s: F.zip_with(F.transform(w, lambda row: dot(row, s)), b, lambda a, c: a + c)))


def cumulative_to_levels(z: Column) -> Column:
    """A distribution over K levels from K - 1 'at least k' logits: running minimum, differences, clipping, scaling."""
    first = F.array(F.lit(1.0))
    falling = F.aggregate(z, first, lambda acc, x: F.array_append(acc, F.least(sigmoid(x), F.element_at(acc, -1))))
    ends = F.array_append(falling, F.lit(0.0))
    steps = let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.greatest(F.get(e, i) - F.get(e, i + 1), F.lit(1e-9))))
    return scaled_to_one(steps)


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear interpolation with clipped ends; xs rises."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    inside = y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k == n, F.get(ys, n - 1)).otherwise(inside)


def nll(p: Column, y: Column) -> Column:
    return -F.log(F.greatest(F.get(p, y), F.lit(TINY)))


def brier(p: Column, y: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == y, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2.0))))
