"""Data quality: rules drop rows, fixes change values, policies judge the counts. Counts are exact and come with the query's own action (``observe``)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    records: int = 0
    rejects: int = 0
    rules: dict[str, int] = field(default_factory=dict)
    fixes: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    """Passes if ``passes(state)``."""

    name: str
    passes: Callable[[State], bool]


def fail_none() -> Callable[[int, int], bool]:
    return lambda n, records: True


def fail_count(limit: int) -> Callable[[int, int], bool]:
    return lambda n, records: n < limit


def fail_any() -> Callable[[int, int], bool]:
    return fail_count(1)


def fail_percent(rate: float) -> Callable[[int, int], bool]:
    return lambda n, records: n < rate * records or (n == 0 and records == 0)


def parser_count(limit: int) -> Policy:
    return Policy(f"FailParserCountPolicy({limit})", lambda s: s.rejects < limit)


def total_rule_count(limit: int) -> Policy:
    return Policy(f"FailTotalRuleCountPolicy({limit})", lambda s: sum(s.rules.values()) < limit)


def total_fix_count(limit: int) -> Policy:
    return Policy(f"FailTotalFixCountPolicy({limit})", lambda s: sum(s.fixes.values()) < limit)


def total_rule_percent(rate: float) -> Policy:
    return Policy(f"FailTotalRulePercentPolicy({rate})", lambda s: sum(s.rules.values()) < rate * s.records)


def total_fix_percent(rate: float) -> Policy:
    return Policy(f"FailTotalFixPercentPolicy({rate})", lambda s: sum(s.fixes.values()) < rate * s.records)


@dataclass(frozen=True)
class Rule:
    """Rows for which ``condition`` isn't true are dropped; those for which it is false are counted. ``logged``: columns that the log shows."""

    condition: Column
    name: str
    policy: Callable[[int, int], bool] = fail_none()
    logged: Sequence[str] = ()


@dataclass(frozen=True)
class Fix:
    """``column`` becomes ``value`` where ``condition`` holds."""

    condition: Column
    column: str
    value: Column
    name: str
    policy: Callable[[int, int], bool] = fail_none()


def bound_rule(column: str, low, high, **kw) -> Rule:
    return Rule((F.col(column) >= low) & (F.col(column) < high), f"BoundRule({column})", logged=[column], **kw)


def set_rule(column: str, values: Sequence, **kw) -> Rule:
    return Rule(F.col(column).isin(list(values)), f"SetRule({column})", logged=[column], **kw)


def set_fix(column: str, values: Sequence, default, **kw) -> Fix:
    return Fix(~F.col(column).isin(list(values)), column, F.lit(default), f"SetFix({column})", **kw)


def format_rule(column: str, pattern: str, **kw) -> Rule:
    return Rule(F.col(column).rlike(f"^(?:{pattern})$"), f"FormatRule({column})", logged=[column], **kw)


def format_fix(column: str, pattern: str, default, **kw) -> Fix:
    return Fix(~F.col(column).rlike(f"^(?:{pattern})$"), column, F.lit(default), f"FormatFix({column})", **kw)


class QualityError(Exception):
    def __init__(self, result: dict):
        super().__init__(json.dumps(result))
        self.result = result


@dataclass
class Quality:
    rules: Sequence[Rule] = ()
    fixes: Sequence[Fix] = ()
    policies: Sequence[Policy] = ()

    def __post_init__(self) -> None:
        names = [t.name for t in [*self.rules, *self.fixes]]
        if len(set(names)) < len(names):
            raise ValueError("tasks need different names")

    def attach(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """The checked rows: rules first, then fixes, each on the row's original values; and the counts, once an action has run."""
        seen = Observation()
        failed = lambda r: F.coalesce(~r.condition, F.lit(False))
        kept = F.lit(True)
        for r in self.rules:
            kept = kept & F.coalesce(r.condition, F.lit(False))
        counts = [F.count(F.lit(1)).alias("records")]
        counts += [F.count_if(failed(r)).alias(f"rule {r.name}") for r in self.rules]
        counts += [F.count_if(kept & F.coalesce(f.condition, F.lit(False))).alias(f"fix {f.name}") for f in self.fixes]
        out = df.observe(seen, *counts).where(kept)
        changes: dict[str, Column] = {}
        for f in self.fixes:
            changes[f.column] = F.when(f.condition, f.value).otherwise(changes.get(f.column, F.col(f.column)))
        return out.withColumns(changes) if changes else out, seen

    def rejected(self, df: DataFrame, n: int = 10) -> dict[str, list[str]]:
        """For each rule the first rows that fail it, as ``column=value`` of its logged columns: a second, limited query."""
        return {r.name: [",".join(f"{c}={row[c]}" for c in r.logged) for row in df.where(~r.condition).select(*(r.logged or df.columns[:1])).limit(n).collect()] for r in self.rules}

    def validate(self, seen: Observation | dict, rejects: int = 0, log: dict[str, list[str]] | None = None, fail: bool = True) -> dict:
        """The result as a dictionary; an error if it didn't pass, unless ``fail`` is False."""
        c = seen if isinstance(seen, dict) else seen.get
        state = State(c["records"], rejects, {r.name: c[f"rule {r.name}"] for r in self.rules}, {f.name: c[f"fix {f.name}"] for f in self.fixes})
        results = {r.name: r.policy(state.rules[r.name], state.records) for r in self.rules} | {f.name: f.policy(state.fixes[f.name], state.records) for f in self.fixes}
        results |= {p.name: p.passes(state) for p in self.policies}
        out = {
            "passed": all(results.values()),
            "dqmStateSnapshot": {"totalRecords": state.records, "parseError": {"total": rejects}, "fixCounts": state.fixes, "ruleErrors": {k: {"total": n, "firstN": (log or {}).get(k, [])} for k, n in state.rules.items()}},
            "errorMessages": [{k: str(v).lower()} for k, v in results.items()], "checkLog": [x for v in (log or {}).values() for x in v],
        }
        if fail and not out["passed"]:
            raise QualityError(out)
        return out


def historical(*validators: Callable[[dict, list[dict]], str | None]):
    """Class decorator: each validator sees the metadata and its history, newest first; their messages join by ``;``."""

    def add(cls: type) -> type:
        cls.validators = [*getattr(cls, "validators", []), *validators]
        cls.validate_metadata = lambda self, now, history: ";".join(m for v in self.validators if (m := v(now, history))) or None
        return cls

    return add
