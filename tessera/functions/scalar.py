"""Scalar functions over strings, numbers, arrays and histogram arrays: pure Column expressions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_non_null(*cols: Column | str) -> Column:
    """Whether any column is not null."""
    return reduce(lambda a, b: a | b, (_col(c).isNotNull() for c in cols))


def str_cat(*cols: Column | str, sep: str = "") -> Column:
    """Concatenation with null as an empty string; null only if all are null. Blanks still get their separator."""
    texts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.when(has_non_null(*cols), F.concat_ws(sep, *texts))


def hash_key(*cols: Column | str, prefix: str = "") -> Column:
    """``prefix`` and the md5 of the concatenation; the prefix alone if all are null."""
    return F.concat(F.lit(prefix), F.coalesce(F.md5(str_cat(*cols).cast("binary")), F.lit("")))


def bools_to_bitmap(*cols: Column | str) -> Column:
    """A string of 1 and 0; null is 0."""
    return F.concat(*(F.when(F.coalesce(_col(c), F.lit(False)), "1").otherwise("0") for c in cols))


def lookup(column: Column | str, mapping: dict[Any, Any], default: Any = None) -> Column:
    """The mapped value; ``default`` for a miss and for null. The map is part of the plan: join large ones instead."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(m, _col(column)), F.lit(default))


def column_name_text(column: Column | str) -> Column:
    """A value as part of a column name: other characters than letters and digits become one ``_``, without one at either end; null is ``null``."""
    text = F.regexp_replace(_col(column).cast("string"), "[^a-zA-Z0-9]+", "_")
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, "^_", ""), "_$", ""), F.lit("null"))


def any_in(column: Column | str, *values: Any) -> Column:
    """Whether any element is one of ``values``; a null element is not, and an empty array has none."""
    return F.exists(_col(column), lambda x: F.coalesce(x.isin(*values), F.lit(False)))


def all_in(column: Column | str, *values: Any) -> Column:
    """Whether all elements are among ``values``; false for an empty array."""
    c = _col(column)
    return (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(x.isin(*values), F.lit(False)))


def contains_all(column: Column | str, *values: Any) -> Column:
    """Whether the array has each of ``values``, of which there must be one at least."""
    if not values:
        raise ValueError("at least one value is needed")
    return F.size(F.array_except(F.array(*map(F.lit, values)), _col(column))) == 0


def flatten_arrays(column: Column | str) -> Column:
    """One level less; inner nulls are dropped, a null outer array stays null."""
    return F.flatten(F.filter(_col(column), lambda x: x.isNotNull()))


def array_cat(sep: str, column: Column | str) -> Column:
    """Elements joined, null as an empty string; null array gives null."""
    return F.array_join(_col(column), sep, "")


def safe_div(numerator: Column | str, denominator: Column | str, default: float | Column) -> Column:
    """Null if either is null; 0 for a zero numerator, whatever divides it; else ``default`` for a zero denominator."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(n == 0, 0.0).when(d == 0, default if isinstance(default, Column) else F.lit(float(default))).otherwise(n / d)


def _down(v: Column, width: float) -> Column:
    return F.floor(v / width) * width


def money_bin(column: Column | str) -> Column:
    """Lower bound of a money amount's bin; bins widen with the amount."""
    v = _col(column).cast("double")
    return (
        F.when(v < 0, _down(v, 1000.0)).when(v == 0, 0.0).when(v < 10, 0.01).when(v < 200, _down(v, 10.0)).when(v < 1000, _down(v, 50.0))
        .when(v < 10_000, _down(v, 500.0)).when(v < 1_000_000, _down(v, 5000.0)).otherwise(_down(v, 1_000_000.0))
    )


def numeric_bin(column: Column | str, low: float, high: float, bins: int) -> Column:
    """Lower bound of one of ``bins`` equal bins; ``high`` itself belongs to the last."""
    v, width = _col(column).cast("double"), (high - low) / bins
    return F.when(v == high, low + width * (bins - 1)).otherwise(low + F.floor((v - low) / width) * width)


def coarse_grain(column: Column | str, width: float) -> Column:
    """The next multiple of ``width`` below, as double."""
    return (F.floor(_col(column).cast("double") / width) * width).cast("double")


def _middle(bin_: Column) -> Column:
    return (bin_["low"] + bin_["high"]) / 2


def bin_percentile(column: Column | str, percentile: float) -> Column:
    """Middle of the first bin at which the running count reaches the percentile of all; the last for 100 or more. Bins: low, high, n."""
    c = _col(column)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    wanted = total.cast("double") if percentile >= 100 else total * (percentile / 100.0)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda acc, x: F.struct((acc["sum"] + x["n"]).alias("sum"), F.when(acc["at"].isNull() & (acc["sum"] + x["n"] >= wanted), _middle(x)).otherwise(acc["at"]).alias("at"))
    return F.when(F.size(c) > 0, F.aggregate(c, start, step)["at"])


def bin_mode(column: Column | str) -> Column:
    """Middle of the most frequent bin, the lowest of several."""
    c = _col(column)
    by = lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).otherwise(F.when(a["low"] < b["low"], -1).when(a["low"] > b["low"], 1).otherwise(0))
    return F.when(F.size(c) > 0, _middle(F.element_at(F.array_sort(c, by), 1)))
