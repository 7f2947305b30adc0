"""Operators within groups of equal keys. Null keys are groups like any other, in all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.aggregates import bin_histogram
from tessera.functions.scalar import column_name_text
from tessera.operators.columns import unique_name, value_to_column_name
from tessera.operators.panels import Panel, Period

TIME = "period"
MAX_PIVOT = 10_000


def keyed(df: DataFrame, *keys: str) -> Keyed:
    return Keyed(df, keys)


def top_n(df: DataFrame, n: int, *orders: Column) -> DataFrame:
    """The first n rows of the whole frame: each partition keeps n, no full sort."""
    return df.orderBy(*orders).limit(n)


def dedup_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """One whole row for each key, any."""
    return df.dropDuplicates(list(keys))


def dedup_by_key_with_order(df: DataFrame, keys: Sequence[str], *orders: Column) -> DataFrame:
    return Keyed(df, tuple(keys)).top_n(1, *orders)


def row_index(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """A gapless number in the order of partitions and of rows within them: counts by partition are offsets for numbers within it."""
    numbered = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["__p"]: r["count"] for r in numbered.groupBy("__p").count().collect()}  # one row for each partition
    offsets, total = [], start
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    at = F.element_at(F.array(*map(F.lit, offsets)), F.col("__p") + 1) if offsets else F.lit(start)
    return numbered.withColumn(name, (at + F.col("__i")).cast("long")).drop("__p", "__i")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left``'s columns and ``right``'s others, where the keys are equal, null and null too. Without keys ``right`` is one row. Joins split skewed keys by themselves."""
    more = [c for c in right.columns if c not in keys]
    if not keys:
        return left.join(F.broadcast(right), how="cross")  # an aggregate without keys has one row
    # names, not references, tell the sides apart: both may come from one frame
    names = {c: unique_name([*left.columns, *right.columns], f"__right_{i}") for i, c in enumerate([*keys, *more])}
    named = lambda c: F.col(f"`{c}`")
    on = [named(k).eqNullSafe(named(names[k])) for k in keys]
    return left.join(right.select(*(named(c).alias(n) for c, n in names.items())), on, how).select(*map(named, left.columns), *(named(names[c]).alias(c) for c in more))


_RUNNING = ("avg", "sum", "count", "min", "max", "first", "last")


@dataclass(frozen=True)
class Keyed:
    df: DataFrame
    keys: tuple[str, ...]

    def _by(self, *orders: Column) -> Window:
        w = Window.partitionBy(*(self.keys or [F.lit(1)]))
        return w.orderBy(*orders) if orders else w

    def agg(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*aggs)

    def top_n(self, n: int, *orders: Column) -> DataFrame:
        name = unique_name(self.df.columns, "rank_in_group")
        return self.df.withColumn(name, F.row_number().over(self._by(*orders))).where(F.col(name) <= n).drop(name)

    def repartition(self, n: int) -> DataFrame:
        return self.df.repartition(n, *self.keys)

    def run_agg(self, orders: Sequence[Column], kind: str, column: str, name: str) -> Column:
        if kind not in _RUNNING:
            raise ValueError(f"{kind} can't run; {', '.join(_RUNNING)} can")
        return getattr(F, kind)(column).over(self._by(*orders).rowsBetween(Window.unboundedPreceding, 0)).alias(name)

    def running(self, orders: Sequence[Column], aggs: Sequence[tuple[str, str, str]], plus: bool = False) -> DataFrame:
        """Aggregates (kind, column, name) over the rows so far; with the input's columns if ``plus``, else the keys."""
        return self.df.select(*(["*"] if plus else self.keys), *(self.run_agg(orders, *a) for a in aggs))

    def fill_forward(self, orders: Sequence[Column], columns: Sequence[str]) -> DataFrame:
        """Nulls take the last value before them; leading nulls stay."""
        w = self._by(*orders).rowsBetween(Window.unboundedPreceding, 0)
        return self.df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})

    def percent_rank(self, columns: Sequence[str], ignore_null: bool = True) -> DataFrame:
        """``<c>_pctrnk``; nulls are ranked first, or have none and the rest is scaled to 0..1."""
        out = self.df
        for c in columns:
            name = f"{c}_pctrnk"
            out = out.withColumn(name, F.percent_rank().over(self._by(F.asc(c))))
            if ignore_null:
                out = out.withColumn(name, F.when(F.col(c).isNotNull(), F.col(name)))
                least = F.min(name).over(self._by())
                # one distinct rank beside nulls leaves nothing to scale: null
                out = out.withColumn(name, F.try_divide(F.col(name) - least, 1 - least))
        return out

    def quantile(self, columns: Sequence[str], bins: int, ignore_null: bool = True) -> DataFrame:
        """``<c>_quantile`` from 1 to ``bins`` by percent rank."""
        if bins < 2:
            raise ValueError("at least two bins are needed")
        names = {c: unique_name(self.df.columns, f"{c}_pctrnk") for c in columns}
        out = self.percent_rank(columns, ignore_null)
        return out.withColumns({f"{c}_quantile": F.least(F.floor(F.col(f"{c}_pctrnk") * bins + 1), F.lit(bins)).cast("int") for c in columns}).drop(*names.values())

    def decile(self, columns: Sequence[str], ignore_null: bool = True) -> DataFrame:
        return self.quantile(columns, 10, ignore_null)

    def scale(self, ranges: dict[str, tuple[float, float]], zero_pivot: bool = False, drop_range: bool = True) -> DataFrame:
        """``<c>_scaled`` between the bounds, from the group's least and largest value, or from plus and minus its largest absolute value; the middle where
        all are equal."""
        bounds: list[Column] = []
        for c in ranges:
            low, high = F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))
            if zero_pivot:
                high = F.greatest(F.abs(low), F.abs(high))
                low = -high
            bounds += [low.alias(f"{c}_min"), high.alias(f"{c}_max")]
        # partial minima before the shuffle, then a join: no group is gathered in one task
        out = null_safe_join(self.df, self.df.groupBy(*self.keys).agg(*bounds), self.keys, "left")
        for c, (lo, hi) in ranges.items():
            v, a, b = F.col(c).cast("double"), F.col(f"{c}_min"), F.col(f"{c}_max")
            out = out.withColumn(f"{c}_scaled", F.when(v.isNotNull(), F.when(a == b, (lo + hi) / 2).otherwise(F.try_divide(v - a, b - a) * (hi - lo) + lo)))
            out = out.drop(f"{c}_min", f"{c}_max") if drop_range else out
        return out

    def pivot(self, sets: Sequence[Sequence[str]], values: Sequence[str], base: Sequence[str] | None = None) -> DataFrame:
        """A row for each row: keys and ``<value>_<base>``, null unless the row's pivot key, its columns' values as names joined by ``_``, is that base. Without
        ``base`` the distinct keys are collected (one column each); more than ``MAX_PIVOT`` are an error."""
        found = [F.concat_ws("_", *(column_name_text(c) for c in s)) for s in sets]
        if base is None:
            base = sorted({r[0] for f in found for r in self.df.select(f).distinct().limit(MAX_PIVOT + 1).collect()})
            if len(base) > MAX_PIVOT:
                raise ValueError(f"more than {MAX_PIVOT} output columns: name those that are wanted")
        if not base:
            raise ValueError("the output columns must be known")
        hit = lambda b: F.array_contains(F.array(*found), F.lit(b))
        return self.df.select(*self.keys, *(F.when(hit(b), F.col(v)).alias(f"{v}_{b}") for v in values for b in base))

    def pivot_sum(self, sets: Sequence[Sequence[str]], values: Sequence[str], base: Sequence[str] | None = None) -> DataFrame:
        """Sums of the pivoted values, 0 where there are none: whole numbers as long, others as double. One pass, no job for the columns."""
        p = self.pivot(sets, values, base)
        whole = {v: isinstance(self.df.schema[v].dataType, T.IntegralType) for v in values}
        kind = {f"{v}_": "long" if w else "double" for v, w in whole.items()}
        cols = [c for c in p.columns if c not in self.keys]
        of = {c: next(k for p_, k in sorted(kind.items(), key=lambda x: -len(x[0])) if c.startswith(p_)) for c in cols}
        return p.groupBy(*self.keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(of[c]).alias(c) for c in cols))

    def pivot_coalesce(self, sets: Sequence[Sequence[str]], values: Sequence[str], base: Sequence[str] | None = None) -> DataFrame:
        """The first non-null value of each cell. Without pivot columns the rank in the group, from 0, by the values, takes their place."""
        df = self.df
        if not sets:
            rank = unique_name(df.columns, "rank")
            df, sets = df.withColumn(rank, F.row_number().over(self._by(*(F.asc(v) for v in values))) - 1), [[rank]]
        p = Keyed(df, self.keys).pivot(sets, values, base)
        return p.groupBy(*self.keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in p.columns if c not in self.keys))

    def cube(self, columns: Sequence[str], *aggs: Column) -> DataFrame:
        return self._sets("CUBE", columns, aggs)

    def rollup(self, columns: Sequence[str], *aggs: Column) -> DataFrame:
        return self._sets("ROLLUP", columns, aggs)

    def _sets(self, kind: str, columns: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
        """One scan and one Expand. ``*`` stands for all values; a value ``*`` of the data stays a row of its own."""
        n = len(columns)
        masks = range(1 << n) if kind == "CUBE" else [(1 << k) - 1 for k in range(n + 1)]  # bit set: column (from the right) is all
        sets = [[*self.keys, *(c for i, c in enumerate(columns) if not m >> (n - 1 - i) & 1)] for m in masks]
        grouped = self.df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in [*self.keys, *columns]))
        out = grouped.agg(*aggs, *(F.grouping(c).alias(f"__g_{c}") for c in columns))
        own = [c for c in out.columns if c not in self.keys and c not in columns and not c.startswith("__g_")]
        return out.select(*self.keys, *(F.when(F.col(f"__g_{c}") == 1, "*").otherwise(F.col(c).cast("string")).alias(c) for c in columns), *own)

    def bin_histogram(self, columns: dict[str, int] | Sequence[str], postfix: str = "_bin") -> DataFrame:
        return bin_histogram(self.df, self.keys, columns, postfix)

    def _expected(self, column: str, expected: Sequence[str]) -> DataFrame:
        rows = self.df.select(*self.keys).distinct().withColumn(column, F.explode(F.array(*map(F.lit, expected))))
        return rows

    def _with_nulls(self, rows: DataFrame) -> DataFrame:
        return rows.select(*((c if c in rows.columns else F.lit(None).cast(self.df.schema[c].dataType).alias(c)) for c in self.df.columns))

    def fill_expected(self, column: str, expected: Sequence[str], only_expected: bool = False) -> DataFrame:
        """A row with nulls for each expected value of a string column that a group lacks."""
        have = self.df.groupBy(*self.keys).agg(F.collect_set(column).alias("__have"))
        lack = have.withColumn(column, F.explode(F.array_except(F.array(*map(F.lit, expected)), "__have"))).drop("__have")
        out = self._with_nulls(lack).unionByName(self.df)
        return out.where(F.col(column).isin(list(expected))) if only_expected else out

    def add_expected(self, column: str, expected: Sequence[str], only_expected: bool = False) -> DataFrame:
        """A row with nulls for every expected value in every group, also for present ones."""
        own = self.df.where(F.col(column).isin(list(expected))) if only_expected else self.df
        return own.unionByName(Keyed(own, self.keys)._with_nulls(Keyed(own, self.keys)._expected(column, expected)))

    def with_time_panel(self, column: str, start: Period, end: Period, add_missing: bool = True) -> DataFrame:
        """The code of each row's period as ``TIME``; with ``add_missing`` just the panel's rows, and one row of nulls for each group and period of it."""
        own = self.df.withColumn(TIME, start.code_of(column))
        return Keyed(own, self.keys).add_expected(TIME, Panel(start, end).codes(), only_expected=True) if add_missing else own

    def time_panel_agg(self, column: str, start: Period, end: Period, *aggs: Column, add_missing: bool = True) -> DataFrame:
        """Aggregates by keys and period. With ``add_missing`` they should be of columns, not of literals."""
        return self.with_time_panel(column, start, end, add_missing).groupBy(*self.keys, TIME).agg(*aggs)


def pivot(df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str], base: Sequence[str]) -> DataFrame:
    """All columns of each row, and its pivoted values."""
    p = Keyed(df, tuple(df.columns)).pivot(sets, values, [value_to_column_name(b) for b in base])
    return p
