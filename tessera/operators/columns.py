"""Projections, renames, column metadata and unions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESC, LABEL = "description", "labels"


def _need(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")


def column_name(df: DataFrame, column: Column) -> str:
    """The alias, or the expression's own name."""
    return df.select(column).columns[0]


def select_with_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """Same-named columns are replaced in place, others appended; all see the original values."""
    return df.withColumns(columns)


def select_plus(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("*", *columns)


def prepend(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns, "*")


def select_minus(df: DataFrame, *names: str | Column) -> DataFrame:
    """Without these columns; an unknown one is an error."""
    own = [n if isinstance(n, str) else column_name(df, n) for n in names]
    _need(df, own)
    return df.drop(*own)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old to new names; unknown old names are ignored, a new name that exists is an error; metadata stays."""
    if taken := [n for n in names.values() if n in df.columns]:
        raise ValueError(f"columns exist already: {', '.join(taken)}")
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def prefix_names(df: DataFrame, prefix: str) -> DataFrame:
    return rename(df, {c: prefix + c for c in df.columns})


def postfix_names(df: DataFrame, postfix: str) -> DataFrame:
    return df.toDF(*(c + postfix for c in df.columns))


def unique_name(names: Sequence[str], candidate: str, ignore_case: bool = False, postfix: str | None = None) -> str:
    """``candidate``, or with ``_`` before it or ``postfix`` after it until it is free. From the second collision on the defaults hold."""
    used = {n.lower() for n in names} if ignore_case else set(names)
    if (candidate.lower() if ignore_case else candidate) not in used:
        return candidate
    return unique_name(names, candidate + postfix if postfix else "_" + candidate)


def expand_structs(df: DataFrame, *names: str) -> DataFrame:
    """Fields of structs as columns at the end, in place of the structs."""
    _need(df, names)
    return df.select("*", *(f"{n}.*" for n in names)).drop(*names)


def describe_columns(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    if not descriptions:
        raise ValueError("at least one description is needed")
    _need(df, list(descriptions))
    for name, text in descriptions.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, DESC: text})
    return df


def describe_from(df: DataFrame, table: DataFrame) -> DataFrame:
    """Descriptions from a small table of (column name, description)."""
    return describe_columns(df, {r[0]: r[1] for r in table.collect() if r[0] in df.columns})


def description(df: DataFrame, name: str) -> str:
    return df.schema[name].metadata.get(DESC, "")


def descriptions(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, description(df, c)) for c in df.columns]


def remove_descriptions(df: DataFrame, *names: str) -> DataFrame:
    """Of all columns if none are named."""
    _need(df, names)
    for name in names or df.columns:
        df = df.withMetadata(name, {k: v for k, v in df.schema[name].metadata.items() if k != DESC})
    return df


def labels(df: DataFrame, name: str) -> list[str]:
    return list(df.schema[name].metadata.get(LABEL, []))


def add_labels(df: DataFrame, names: Sequence[str], new: Sequence[str]) -> DataFrame:
    """To all columns if none are named."""
    if not new:
        raise ValueError("at least one label is needed")
    _need(df, names)
    for name in names or df.columns:
        df = df.withMetadata(name, {**df.schema[name].metadata, LABEL: sorted({*labels(df, name), *new})})
    return df


def remove_labels(df: DataFrame, names: Sequence[str] = (), old: Sequence[str] = ()) -> DataFrame:
    """All labels if none are given; of all columns if none are named."""
    _need(df, names)
    for name in names or df.columns:
        left = sorted({*labels(df, name)} - {*old}) if old else []
        df = df.withMetadata(name, {**df.schema[name].metadata, LABEL: left})
    return df


def with_labels(df: DataFrame, *wanted: str) -> list[str]:
    """Columns that have all labels; those without any if none are given; none found is an error."""
    found = [c for c in df.columns if (set(wanted) <= {*labels(df, c)} if wanted else not labels(df, c))]
    if not found:
        raise ValueError(f"no column has the labels {wanted}")
    return found


def select_by_label(df: DataFrame, *wanted: str) -> DataFrame:
    return df.select(*with_labels(df, *wanted))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows; columns in the first frame's order, then new ones; absent ones are null. One name with two types is an error."""
    for other in others:
        for f in other.schema:
            if f.name in first.columns and first.schema[f.name].dataType != f.dataType:
                raise TypeError(f"{f.name} is {first.schema[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def value_to_column_name(value: object) -> str:
    text = "null" if value is None else str(value)
    return re.sub("_$", "", re.sub("^_", "", re.sub("[^a-zA-Z0-9]+", "_", text)))


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Rows of (name, value) for each column, nulls kept."""
    _need(df, columns)
    return df.unpivot([c for c in df.columns if c not in columns], list(columns), name, value)


def unpivot_by(df: DataFrame, columns: Sequence[str], name_of: Callable[[str], tuple[str, str]], index: str | None = "Index") -> DataFrame:
    """``name_of`` gives a column's new name and its row's index: all of one index make one row, by length and then by text of the index; absent ones are null.
    A new column keeps the type of those that make it, and is text where these differ. ``index``: the index's column, or None for none."""
    _need(df, columns)
    parts = {name_of(c): c for c in columns}
    names = list(dict.fromkeys(n for n, _ in parts))
    order = sorted({i for _, i in parts}, key=lambda i: (len(i), i))
    keep = [c for c in df.columns if c not in columns]
    kinds = {n: {df.schema[c].dataType.json(): df.schema[c].dataType for (m, _), c in parts.items() if m == n} for n in names}
    kind = {n: next(iter(k.values())) if len(k) == 1 else T.StringType() for n, k in kinds.items()}
    rows = [F.struct(F.lit(i).alias("__i"), *((F.col(parts[n, i]) if (n, i) in parts else F.lit(None)).cast(kind[n]).alias(n) for n in names)) for i in order]
    at = unique_name([*df.columns, *names], "__u")
    out = df.select(*keep, F.explode(F.array(*rows)).alias(at))
    return out.select(*keep, *([F.col(f"{at}.__i").alias(index)] if index else []), *(F.col(f"{at}.{n}").alias(n) for n in names))


def unpivot_regex(df: DataFrame, columns: Sequence[str], pattern: str, index: str | None = "Index") -> DataFrame:
    """``unpivot_by`` with a pattern whose two groups are the new name and the index; a column that doesn't match throughout is an error."""

    def name_of(c: str) -> tuple[str, str]:
        if not (m := re.fullmatch(pattern, c)) or len(m.groups()) != 2:
            raise ValueError(f"{c} doesn't match {pattern} with two groups")
        return m[1], m[2]

    return unpivot_by(df, columns, name_of, index)
