"""Data profiles: one aggregation for all statistics, one grouping for all histograms.

A profile is a long table (key columns, column, kind, task, about, value) whose values are JSON texts, the same rows for any column type.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.aggregates import stddev0
from tessera.functions.scalar import coarse_grain, money_bin

ABOUT = {
    "avg": "Average", "std": "Standard Deviation", "cnt": "Non-Null Count", "nct": "Null Count", "nul": "Null Rate", "min": "Min", "max": "Max",
    "mil": "Min Length", "mal": "Max Length", "tmi": "Time Start", "tma": "Time Edd", "dct": "Distinct Count", "yea": "Year", "mon": "Month", "dow": "Day of Week",
    "hou": "Hour", "boo": "Boolean", "key": "String sort by Key", "frq": "String sort by Frequency", "nkh": "Numeric sort by Key", "nfh": "Numeric sort by Frequency",
    "amt": "Amount Histogram", "bnh": "Numeric Histogram",
}


@dataclass(frozen=True)
class Hist:
    """A histogram of a column, of bins of ``bin_size`` if that isn't 0."""

    column: str
    bin_size: float = 0.0
    by_freq: bool = False


@dataclass(frozen=True)
class AmountHist:
    column: str


def _stats(df: DataFrame, c: str) -> list[tuple[str, Column]]:
    kind, v = df.schema[c].dataType, F.col(c)
    base = [("cnt", F.count(v)), ("nct", F.count(F.lit(1)) - F.count(v))]
    if isinstance(kind, T.NumericType):
        return [*base, ("avg", F.avg(v)), ("std", stddev0(v)), ("min", F.min(v).cast("double")), ("max", F.max(v).cast("double"))]
    if isinstance(kind, T.StringType):
        return [*base, ("mil", F.min(F.length(v)).cast("long")), ("mal", F.max(F.length(v)).cast("long")), ("dct", F.approx_count_distinct(v, 0.01))]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [("tmi", F.min(v).cast("string")), ("tma", F.max(v).cast("string"))]
    return []


def _hists(df: DataFrame, c: str) -> list[tuple[str, Column]]:
    kind, v = df.schema[c].dataType, F.col(c)
    if isinstance(kind, T.BooleanType):
        return [("boo", v.cast("string"))]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = [("yea", F.format_string("%04d", F.year(v))), ("mon", F.format_string("%02d", F.month(v))), ("dow", F.format_string("%1d", F.dayofweek(v)))]
        return out if isinstance(kind, T.DateType) else [*out, ("hou", F.format_string("%02d", F.hour(v)))]
    return []


def _value(c: Column, text: bool) -> Column:
    """A statistic as JSON: numbers as they are, texts (times, which need no escape) in quotes."""
    said = F.concat(F.lit('"'), c, F.lit('"')) if text else F.when(F.isnan(c.cast("double")), '"NaN"').otherwise(c.cast("string"))
    return F.coalesce(said, F.lit("null"))


def _stat_rows(df: DataFrame, keys: Sequence[str], tasks: list[tuple[str, str, Column]]) -> DataFrame | None:
    if not tasks:
        return None
    wide = df.groupBy(*keys).agg(*(e.alias(f"__{i}") for i, (_, _, e) in enumerate(tasks)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit("stat").alias("kind"), F.lit(t).alias("task"), F.lit(ABOUT[t]).alias("about"), _value(F.col(f"__{i}"), t in ("tmi", "tma")).alias("value")) for i, (c, t, _) in enumerate(tasks)))
    return wide.select(*keys, F.inline(rows))


def _hist_rows(df: DataFrame, keys: Sequence[str], tasks: list[tuple[str, str, Column, bool]]) -> DataFrame | None:
    if not tasks:
        return None
    cells = F.array(*(F.struct(F.lit(i).alias("i"), e.cast("string").alias("v")) for i, (_, _, e, _) in enumerate(tasks)))
    n = df.select(*keys, F.inline(cells)).groupBy(*keys, "i", "v").count()
    h = n.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("v", "count"))).alias("h"))
    numeric = [i for i, (_, t, _, _) in enumerate(tasks) if t in ("nkh", "nfh", "amt", "bnh", "boo")]
    # a bar's name is itself JSON text: strings are quoted within the quotes
    json_text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    key = lambda x: F.coalesce(F.when(F.col("i").isin(numeric), x["v"]).otherwise(json_text(x["v"])), F.lit("null"))
    pairs = F.array_join(F.transform("h", lambda x: F.concat(json_text(key(x)), F.lit(":"), x["count"].cast("string"))), ",")
    of = lambda at, f: F.element_at(F.array(*(F.lit(f(t)) for t in tasks)), at + 1)
    i = F.col("i")
    freq = of(i, lambda t: "true" if t[3] else "false")
    return h.select(*keys, of(i, lambda t: t[0]).alias("column"), F.lit("hist").alias("kind"), of(i, lambda t: t[1]).alias("task"), of(i, lambda t: ABOUT[t[1]]).alias("about"), F.concat(F.lit('{"histSortByFreq":'), freq, F.lit(',"hist":{'), pairs, F.lit("}}")).alias("value"))


def _union(parts: list[DataFrame | None], df: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = [p for p in parts if p is not None]
    if not own:
        raise ValueError("no column can be profiled")
    out = own[0]
    for p in own[1:]:
        out = out.unionByName(p)
    return out


def summary(df: DataFrame, *columns: str, keys: Sequence[str] = ()) -> DataFrame:
    """The profile of the columns (all if none are named). Arrays, maps and structs have none."""
    cols = [c for c in (columns or df.columns) if c not in keys]
    stats = [(c, t, e) for c in cols for t, e in _stats(df, c)]
    hists = [(c, t, e, False) for c in cols for t, e in _hists(df, c)]
    return _union([_stat_rows(df, keys, stats), _hist_rows(df, keys, hists)], df, keys)


def histograms(df: DataFrame, *hists: str | Hist | AmountHist, keys: Sequence[str] = ()) -> DataFrame:
    tasks = []
    for h in hists:
        h = Hist(h) if isinstance(h, str) else h
        kind = df.schema[h.column].dataType
        if isinstance(h, AmountHist):
            tasks.append((h.column, "amt", money_bin(h.column), False))
        elif isinstance(kind, T.NumericType):
            tasks.append((h.column, "bnh", coarse_grain(h.column, h.bin_size), False) if h.bin_size else (h.column, "nfh" if h.by_freq else "nkh", F.col(h.column).cast("double"), h.by_freq))
        elif isinstance(kind, T.BooleanType):
            tasks.append((h.column, "boo", F.col(h.column), False))
        else:
            tasks.append((h.column, "frq" if h.by_freq else "key", F.coalesce(F.col(h.column).cast("string"), F.lit("null")), h.by_freq))
    return _union([_hist_rows(df, keys, tasks)], df, keys)


def concat_hist(df: DataFrame, *sets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Histograms of joint values, joined by ``_``."""
    names = {"_".join(s): F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in s)) for s in sets}
    return histograms(df.select(*keys, *(e.alias(n) for n, e in names.items())), *names, keys=keys)


def freq_hist(df: DataFrame, *columns: str, keys: Sequence[str] = ()) -> DataFrame:
    return histograms(df, *(Hist(c, by_freq=True) for c in columns), keys=keys)


def bin_hist(df: DataFrame, sizes: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    return histograms(df, *(Hist(c, b) for c, b in sizes.items()), keys=keys)


def count_hist(df: DataFrame, keys: Sequence[str], bin_size: float = 1) -> DataFrame:
    """Histogram of the sizes of groups of equal keys."""
    name = "N_" + "_".join(keys)
    return histograms(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), Hist(name, bin_size))


def null_rate(df: DataFrame, *columns: str, keys: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in (columns or df.columns) if c not in keys]
    return _stat_rows(df, keys, [(c, "nul", F.try_divide(F.count(F.lit(1)) - F.count(c), F.count(F.lit(1)))) for c in cols])


def histogram_rows(df: DataFrame, column: Column | str, *keys: str) -> DataFrame:
    """A histogram as rows (keys, value, n) rather than JSON."""
    c = F.col(column) if isinstance(column, str) else column
    return df.select(*keys, c.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def _near(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != 0 and abs(a - b) < abs(a) * 10 ** -(5 - 1) / 2) or f"{a:.5g}" == f"{b:.5g}"
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_near(a[k], b[k]) for k in a)
    return a == b


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), ignore_column: bool = False) -> tuple[bool, list[str]]:
    """Whether two profiles agree, doubles to five digits, and where they don't. Profiles are small: a row for each column and task."""
    by = [*keys, *([] if ignore_column else ["column"]), "task"]
    a, b = ({tuple(r[k] for k in by): json.loads(r["value"]) for r in d.collect()} for d in (left, right))
    said = [f"only in {'the first' if k in a else 'the second'}: {k}" for k in sorted(a.keys() ^ b.keys(), key=str)]
    said += [f"{k}: {a[k]} and {b[k]}" for k in sorted(a.keys() & b.keys(), key=str) if not _near(a[k], b[k])]
    return not said, said


def report(profile: DataFrame, keys: Sequence[str] = ()) -> str:
    """The profile as text."""
    lines = []
    for r in profile.collect():
        value, head = json.loads(r["value"]), "".join(f"{r[k]} " for k in keys)
        if r["kind"] == "stat":
            lines.append(f"{head}{r['column']:<20} {r['about']:<22} {value}")
            continue
        lines.append(f"{head}Histogram of {r['column']}: {r['about']}")
        hist = sorted(value["hist"].items(), key=lambda kv: (-kv[1], kv[0]) if value["histSortByFreq"] else (kv[0] != "null", kv[0]))
        total, run = sum(value["hist"].values()), 0
        for k, n in hist:
            run += n
            lines.append(f"{k.strip(chr(34)):<20} {n:>10} {n / total:>8.2%} {run:>10} {run / total:>8.2%}")
    return "\n".join(lines)


def save_report(profile: DataFrame, path: str) -> None:
    profile.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
