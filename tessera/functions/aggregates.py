"""Aggregate expressions, and the histogram aggregates that need two grouping stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import str_cat


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_value(c: Column | str, non_null: bool = False) -> Column:
    return F.first(_col(c), ignorenulls=non_null)


def count_true(c: Column | str) -> Column:
    return F.count_if(_col(c))


def count_false(c: Column | str) -> Column:
    return F.count_if(~_col(c))


def count_null(c: Column | str) -> Column:
    return F.count_if(_col(c).isNull())


def count_distinct_with_null(*cols: Column | str) -> Column:
    """Distinct values of the concatenation, null as an empty string; rows that are null throughout don't count."""
    return F.count_distinct(str_cat(*cols))


def collect_values(c: Column | str, kind: T.DataType) -> Column:
    """The set of non-null values of a string, integer, boolean or double column."""
    if not isinstance(kind, (T.StringType, T.IntegerType, T.BooleanType, T.DoubleType)):
        raise TypeError(f"unsupported type {kind}")
    return F.collect_set(_col(c).cast(kind))


def stddev0(c: Column | str) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(_col(c)), F.lit(0.0))


def sum0(c: Column | str) -> Column:
    """Sum; 0 if all are null."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def any_true(c: Column | str) -> Column:
    return F.coalesce(F.bool_or(_col(c)), F.lit(False))


MAX_KEYS = 1000


def histogram(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """One row per group: an array of (value, n) in order of value, null first. More than ``MAX_KEYS`` values raise an error.

    Counts are partial before the shuffle; only distinct values travel."""
    n = df.groupBy(*keys, column).count()
    out = n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("value"), F.col("count").alias("n"))), _nulls_first).alias("__h"))
    checked = F.when(F.size("__h") <= MAX_KEYS, F.col("__h")).otherwise(F.raise_error(F.lit(f"more than {MAX_KEYS} values")).cast(out.schema["__h"].dataType))
    return out.select(*keys, checked.alias(name or f"{column}_hist"))


def _nulls_first(a: Column, b: Column) -> Column:
    return F.when(a["value"].isNull(), -1).when(b["value"].isNull(), 1).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0)


def most_frequent(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """One row per group: all most frequent non-null values as an array of (value, n)."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    from tessera.operators.keyed import null_safe_join

    best = null_safe_join(n, n.groupBy(*keys).agg(F.max("count").alias("__m")), keys).where(F.col("count") == F.col("__m"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("value"), F.col("count").alias("n")))).alias(name or f"{column}_mfv"))


def bin_histogram(df: DataFrame, keys: Sequence[str], columns: dict[str, int] | Sequence[str], postfix: str = "_bin", default_bins: int = 1000) -> DataFrame:
    """Per group and column an array of (low, high, n) over equal bins between the group's least and largest value; empty bins are left out, nulls
    skipped. Null keys are a group like any other.

    All columns at once: one aggregation for the bounds, one for the bins, both partial before their shuffle; no group is gathered in one task."""
    from tessera.operators.keyed import null_safe_join

    columns = columns if isinstance(columns, dict) else {c: default_bins for c in columns}
    if not columns:
        return df
    names, sizes = list(columns), list(columns.values())
    own = df.select(*keys, *(F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(names)))
    bounds = own.groupBy(*keys).agg(*(f(f"__v{i}").alias(f"__{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max))))

    def place(i: int) -> Column:
        v, lo, width = F.col(f"__v{i}"), F.col(f"__lo{i}"), (F.col(f"__hi{i}") - F.col(f"__lo{i}")) / sizes[i]
        return F.when(v.isNotNull(), F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(sizes[i] - 1))).otherwise(0).cast("int"))

    near = null_safe_join(own, bounds, keys)
    if len(names) == 1:
        cells = near.select(*keys, F.lit(0).alias("__i"), place(0).alias("__b"))
    else:
        cells = near.select(*keys, F.posexplode(F.array(*map(place, range(len(names))))).alias("__i", "__b"))
    n = null_safe_join(cells.where("__b IS NOT NULL").groupBy(*keys, "__i", "__b").count(), bounds, keys)
    of = lambda c: F.element_at(F.array(*(F.col(f"__{c}{i}") for i in range(len(names)))), F.col("__i") + 1)
    width = (of("hi") - of("lo")) / F.element_at(F.array(*map(F.lit, sizes)), F.col("__i") + 1)
    low = of("lo") + F.col("__b") * width
    bins = F.struct(low.alias("low"), (low + width).alias("high"), F.col("count").alias("n"))
    arrays = [F.array_sort(F.collect_list(F.when(F.col("__i") == i, bins))) for i in range(len(names))]
    return n.groupBy(*keys).agg(*(F.when(F.size(a) > 0, a).alias(c + postfix) for a, c in zip(arrays, names, strict=True)))
