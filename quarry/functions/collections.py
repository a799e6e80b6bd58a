"""Arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(a: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` and its lambdas name it."""
    return F.element_at(F.transform(F.array(a), f), 1)


def _count(a: Column, v: Column) -> Column:
    return F.size(F.filter(a, lambda y: y.eqNullSafe(v)))


def element_at(a: str | Column, i: Column | int) -> Column:
    """Null out of range; negative places count from the end."""
    return F.try_element_at(_c(a), F.lit(i) if isinstance(i, int) else i)


def subscript(a: str | Column, i: Column | int) -> Column:
    """An error out of range."""
    return F.element_at(_c(a), i)


def map_subscript(m: str | Column, k: Column) -> Column:
    """An error for a missing key."""
    return F.when(F.map_contains_key(_c(m), k), F.element_at(_c(m), k)).otherwise(F.raise_error(F.lit("key not present in map")))


def array_duplicates(a: str | Column) -> Column:
    return _once(_c(a), lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: _count(c, x) > 1))))


def array_has_duplicates(a: str | Column) -> Column:
    return F.size(_c(a)) != F.size(F.array_distinct(_c(a)))


def array_frequency(a: str | Column) -> Column:
    return _once(_c(a), lambda c: F.map_from_entries(F.transform(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), lambda x: F.struct(x, _count(c, x)))))


def array_max(a: str | Column) -> Column:
    """Null if any element is null."""
    return F.when(~F.exists(_c(a), lambda x: x.isNull()), F.array_max(_c(a)))


def array_min(a: str | Column) -> Column:
    return F.when(~F.exists(_c(a), lambda x: x.isNull()), F.array_min(_c(a)))


def array_sum(a: str | Column, zero: Column) -> Column:
    """Nulls count as zero; ``zero`` sets the type."""
    return F.aggregate(_c(a), zero, lambda s, x: s + F.coalesce(x, zero))


def array_average(a: str | Column) -> Column:
    kept = F.filter(_c(a), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(kept))


def array_normalize(a: str | Column, p: float = 2.0) -> Column:
    """Divided by the p-norm; NaN for an array of zeros."""
    c = F.transform(_c(a), lambda x: x.cast("double"))
    power = (lambda x: x * x) if p == 2 else (lambda x: F.pow(F.abs(x), F.lit(p)))
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + power(x))
    norm = F.sqrt(total) if p == 2 else F.pow(total, F.lit(1 / p))
    return _once(norm, lambda n: F.transform(c, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / n)))


def array_sort_desc(a: str | Column) -> Column:
    """Descending, nulls last."""
    return F.sort_array(_c(a), asc=False)


#: The dialect's limits of combinations: elements chosen, and choices.
CHOSEN, CHOICES = 5, 100_000


def combinations(a: str | Column, n: int) -> Column:
    """All choices of ``n`` elements, those without the last elements first; an error for more than ``CHOICES``."""
    if not 0 < n <= CHOSEN:
        raise ValueError(f"combinations of {n} elements are not supported")

    def below(k: int, end: Column) -> Column:
        """Choices of k of the places 1 to end, which are k at least."""
        if k == 0:
            return F.array(F.array().cast("array<int>"))
        return F.flatten(F.transform(F.sequence(F.lit(k), end), lambda j: F.transform(below(k - 1, j - 1), lambda p: F.concat(p, F.array(j)))))

    def chosen(c: Column) -> Column:
        size, count = F.size(c), F.lit(1).cast("double")
        for k in range(n):
            count = count * (size - k) / (k + 1)
        picks = F.transform(below(n, size), lambda p: F.transform(p, lambda i: F.element_at(c, i)))
        none = F.filter(F.array(c), lambda x: F.lit(False))
        return F.when(size < n, none).when(count <= CHOICES, picks).when(c.isNotNull(), F.raise_error(F.lit("combinations exceed max size")))

    return _once(_c(a), chosen)


def try_subscript(a: str | Column, i: Column) -> Column:
    """TRY over a subscript: null out of range, and for 0 and below, which are errors too."""
    return F.when(i > 0, F.try_element_at(_c(a), i))


def ngrams(a: str | Column, n: int) -> Column:
    """Runs of ``n`` elements; the whole array if it is shorter."""
    c = _c(a)
    return F.when(F.size(c) <= n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.slice(c, i, n)))


def trim_array(a: str | Column, n: int) -> Column:
    """Without the last ``n`` elements."""
    return F.slice(_c(a), 1, F.size(_c(a)) - n)


def find_first(a: str | Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(_c(a), test), F.lit(1))


def none_match(a: str | Column, test: Callable[[Column], Column]) -> Column:
    return ~F.exists(_c(a), test)


def map_concat(a: str | Column, b: str | Column) -> Column:
    """Of a key in both, the value of the second."""
    x, y = _c(a), _c(b)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def map_subset(m: str | Column, keys: Column) -> Column:
    return F.map_filter(_c(m), lambda k, _: F.array_contains(keys, k))


def map_top_n(m: str | Column, n: int) -> Column:
    """The ``n`` entries of the greatest values (of equal values, the greatest keys)."""
    entries = F.transform(F.map_entries(_c(m)), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    return F.map_from_entries(F.transform(F.slice(F.sort_array(entries, False), 1, n), lambda e: F.struct(e["key"], e["value"])))


def map_normalize(m: str | Column) -> Column:
    total = F.aggregate(F.map_values(_c(m)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform_values(_c(m), lambda _, v: v.cast("double") / total)


def all_keys_match(m: str | Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(F.map_keys(_c(m)), test)


def any_keys_match(m: str | Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(F.map_keys(_c(m)), test)


def no_keys_match(m: str | Column, test: Callable[[Column], Column]) -> Column:
    return ~F.exists(F.map_keys(_c(m)), test)


def any_values_match(m: str | Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(F.map_values(_c(m)), test)


def map_top_n_keys(m: str | Column, n: int) -> Column:
    """The ``n`` greatest keys, descending."""
    return F.slice(F.sort_array(F.map_keys(_c(m)), False), 1, n)


def multimap_from_entries(entries: str | Column) -> Column:
    """Keys to the arrays of their values, from an array of structs (key, value)."""
    c = _c(entries)
    keys = F.array_distinct(F.transform(c, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(c, lambda e: e["key"] == k), lambda e: e["value"])))
