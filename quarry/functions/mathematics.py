"""Mathematics and bits."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_null(xs: Sequence[Column]) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def greatest(*xs: str | Column) -> Column:
    """The greatest value; null if any is null."""
    cs = [_c(x) for x in xs]
    return F.when(~_any_null(cs), F.greatest(*cs))


def least(*xs: str | Column) -> Column:
    """The least value; null if any is null."""
    cs = [_c(x) for x in xs]
    return F.when(~_any_null(cs), F.least(*cs))


def ceiling(x: str | Column) -> Column:
    """Keeps a double a double."""
    return F.ceil(_c(x)).cast("double")


def floor(x: str | Column) -> Column:
    return F.floor(_c(x)).cast("double")


def sign(x: str | Column, kind: str) -> Column:
    """-1, 0 or 1 in the argument's own type."""
    return F.signum(_c(x)).cast(kind)


def rounded(x: str | Column, digits: int = 0) -> Column:
    """A double rounded half away from zero; zero keeps the sign (-0.0) of what is rounded to it.

    As in the dialect a half is what the product with the power of ten makes one, whatever the digits of the double say.
    """
    c, scale = _c(x), 10.0 ** abs(digits)
    r = F.round(F.abs(c * scale if digits >= 0 else c / scale)) * F.signum(c)
    # of what is no number, infinite, or too large for the product nothing is rounded
    return F.when(F.abs(c) < sys.float_info.max / 10.0 ** max(digits, 0), r / scale if digits >= 0 else r * scale).otherwise(c)


def truncate(x: str | Column, digits: int = 0) -> Column:
    """Towards zero, at ``digits`` after the point (negative: before it)."""
    c = _c(x)
    scale = F.lit(10.0**digits)
    t = F.when(c < 0, F.ceil(c * scale)).otherwise(F.floor(c * scale)).cast("double")
    return t / scale


def ln(x: str | Column) -> Column:
    """ln(0) is minus infinity, and of a negative number NaN."""
    c = _c(x).cast("double")
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c.isNotNull(), F.lit(float("nan")))


def clamp(x: str | Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(_c(x), low), high)


def width_bucket(x: str | Column, bins: Column) -> Column:
    """How many of the ascending ``bins`` are at most x."""
    v = _c(x)
    return F.size(F.filter(bins, lambda b: b <= v))


def from_base(text: str | Column, radix: int) -> Column:
    return F.conv(_c(text), radix, 10).cast("bigint")


def to_base(x: str | Column, radix: int) -> Column:
    """Lower-case digits, a minus sign before those of a negative number."""
    c = _c(x)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lower(F.conv(F.abs(c).cast("string"), 10, radix)))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    """Of two arrays of numbers of one length."""
    x, y = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = [F.sqrt(F.aggregate(F.transform(v, lambda p: p.cast("double") * p.cast("double")), F.lit(0.0), lambda s, w: s + w)) for v in (x, y)]
    return dot / (norm[0] * norm[1])


def map_cosine_similarity(a: str | Column, b: str | Column) -> Column:
    """Of two sparse vectors as maps: keys that only one has count as zero in the other."""
    x, y = _c(a), _c(b)
    common = F.map_zip_with(x, y, lambda k, p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0)))
    dot = F.aggregate(F.map_values(common), F.lit(0.0), lambda s, v: s + v)
    norm = [F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v)) for m in (x, y)]
    return dot / (norm[0] * norm[1])


def log(base: Column, x: str | Column) -> Column:
    return ln(x) / ln(base)


def random_below(n: int, seed: int | None = None) -> Column:
    """A random whole number from 0 to n - 1."""
    return F.floor(F.rand(seed) * n).cast("bigint")


def shift_right_arithmetic(x: str | Column, n: int) -> Column:
    """The sign comes in from the left."""
    return F.shiftright(_c(x).cast("bigint"), n)


def bit_count(x: str | Column, bits: int) -> Column:
    """Ones in the two's complement of ``bits`` bits."""
    c = _c(x).cast("bigint")
    return F.bit_count(c if bits >= 64 else c.bitwiseAND(F.lit((1 << bits) - 1))).cast("bigint")


def shift_left(x: str | Column, n: int, bits: int = 64) -> Column:
    c = F.shiftleft(_c(x).cast("bigint"), n)
    return c if bits >= 64 else c.bitwiseAND(F.lit((1 << bits) - 1))


def shift_right(x: str | Column, n: int, bits: int = 64) -> Column:
    """Zeros come in from the left."""
    c = _c(x).cast("bigint")
    return F.shiftrightunsigned(c if bits >= 64 else c.bitwiseAND(F.lit((1 << bits) - 1)), n)


# Distribution functions that have a closed form.


def cauchy_cdf(median: Column, scale: Column, x: str | Column) -> Column:
    return F.lit(0.5) + F.atan((_c(x) - median) / scale) / F.pi()


def laplace_cdf(mean: Column, scale: Column, x: str | Column) -> Column:
    d = (_c(x) - mean) / scale
    return F.when(d < 0, F.exp(d) / 2).otherwise(F.lit(1.0) - F.exp(-d) / 2)


def weibull_cdf(shape: Column, scale: Column, x: str | Column) -> Column:
    return F.when(_c(x) <= 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(-F.pow(_c(x) / scale, shape)))


def _wilson(successes: Column, trials: Column, z: Column, way: int) -> Column:
    n, k = trials.cast("double"), successes.cast("double")
    p = k / n
    return (p + z * z / (2 * n) + way * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def wilson_interval_lower(successes: Column, trials: Column, z: Column) -> Column:
    return _wilson(successes, trials, z, -1)


def wilson_interval_upper(successes: Column, trials: Column, z: Column) -> Column:
    return _wilson(successes, trials, z, 1)


#: Coefficients of the rational approximation of erfc used for normal_cdf, error below 1.2e-7 (fixed values).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(mean: Column, sd: Column, x: str | Column) -> Column:
    """Within 1e-7."""
    z = -(_c(x) - mean) / (sd * F.sqrt(F.lit(2.0)))
    t = 1.0 / (1.0 + 0.5 * F.abs(z))
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(z >= 0, tail).otherwise(2.0 - tail) / 2


def poisson_cdf(mean: Column, k: Column) -> Column:
    """The probability of at most ``k``: the gamma distribution's upper tail."""
    return F.when(k < 0, F.lit(0.0)).otherwise(1 - gamma_cdf(k.cast("double") + 1, F.lit(1.0), mean))


def binomial_cdf(n: Column | int, p: Column, k: Column) -> Column:
    """The probability of at most ``k`` of ``n``: the beta distribution's upper tail."""
    size = (F.lit(n) if isinstance(n, int) else n).cast("double")
    return F.when(k < 0, F.lit(0.0)).when(k >= size, F.lit(1.0)).otherwise(1 - beta_cdf(k.cast("double") + 1, F.greatest(size - k, F.lit(1.0)), p))


#: Coefficients of the Lanczos approximation of the gamma function for g = 7 (fixed values).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Coefficients of the rational approximation of the normal quantile, relative error below 1.2e-9 (fixed values).
_QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: Terms of a series or fraction: so many, and so many times the root of the greatest parameter. Near the mean they
#: shrink as exp(-k * k / 2a), so 12 roots reach below 1e-30.
_TERMS, _ROOTS = 200, 12


def log_gamma(x: str | Column) -> Column:
    """For positive numbers."""
    z = _c(x).cast("double") - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _terms(*parameters: Column) -> Column:
    return (F.lit(_TERMS) + F.ceil(_ROOTS * F.sqrt(F.greatest(*parameters, F.lit(0.0))))).cast("int")


def _backwards(n: Column, first: Column, step) -> Column:
    """A continued fraction evaluated from its far end: ``step(t, k)`` for k = n - 1 down to 0."""
    return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), first, step)


def gamma_cdf(shape: Column, scale: Column, x: str | Column) -> Column:
    """By its series below ``shape`` + 1 and its continued fraction above, with as many terms as the shape asks for."""
    a, v = shape.cast("double"), _c(x).cast("double") / scale
    n = _terms(a)
    front = F.exp(-v + a * F.ln(v) - log_gamma(a))
    series = F.aggregate(F.sequence(F.lit(1), n), F.struct((F.lit(1.0) / a).alias("t"), (F.lit(1.0) / a).alias("s")), lambda r, k: F.struct((r["t"] * v / (a + k)).alias("t"), (r["s"] + r["t"] * v / (a + k)).alias("s")))["s"]
    far = _backwards(n, v + 2 * n + 1 - a, lambda t, k: v + 2 * k + 1 - a - (k + 1) * (k + 1 - a) / t)
    return F.when(v <= 0, F.lit(0.0)).when(v < a + 1, front * series).otherwise(1 - front / far)


def chi_squared_cdf(df: Column, x: str | Column) -> Column:
    return gamma_cdf(df.cast("double") / 2, F.lit(2.0), x)


def beta_cdf(alpha: Column, beta: Column, x: str | Column) -> Column:
    """By its continued fraction, on the side where that converges fast."""
    v = _c(x).cast("double")

    def side(a: Column, b: Column, u: Column) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(u) + b * F.ln(1 - u)) / a

        def step(t: Column, k: Column) -> Column:
            # k counts the fraction's terms from 0: odd terms (k even) and even ones have their own coefficients
            m = F.floor((k + 1) / 2).cast("double")
            odd = -(a + m) * (a + b + m) * u / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * u / ((a + 2 * m - 1) * (a + 2 * m))
            return 1 + F.when(k % 2 == 0, odd).otherwise(even) / t

        return front / _backwards(_terms(a, b), F.lit(1.0), step)

    a, b = alpha.cast("double"), beta.cast("double")
    return F.when(v <= 0, F.lit(0.0)).when(v >= 1, F.lit(1.0)).when(v < (a + 1) / (a + b + 2), side(a, b, v)).otherwise(1 - side(b, a, 1 - v))


def f_cdf(df1: Column, df2: Column, x: str | Column) -> Column:
    v, a, b = _c(x).cast("double"), df1.cast("double"), df2.cast("double")
    return F.when(v <= 0, F.lit(0.0)).otherwise(beta_cdf(a / 2, b / 2, a * v / (a * v + b)))


def inverse_normal_cdf(mean: Column, sd: Column, p: str | Column) -> Column:
    """For 0 < p < 1."""
    q = _c(p).cast("double")

    def ratio(top: tuple[float, ...], below: tuple[float, ...], r: Column, factor: Column) -> Column:
        n, d = F.lit(top[0]), F.lit(below[0])
        for c in top[1:]:
            n = n * r + c
        for c in (*below[1:], 1.0):
            d = d * r + c
        return n * factor / d

    tail = lambda u: ratio(_QUANTILE_C, _QUANTILE_D, F.sqrt(-2 * F.ln(u)), F.lit(1.0))
    r = q - 0.5
    z = F.when(q < 0.02425, tail(q)).when(q > 1 - 0.02425, -tail(1 - q)).otherwise(ratio(_QUANTILE_A, _QUANTILE_B, r * r, r))
    return mean + sd * z
