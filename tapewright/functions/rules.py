"""Declarative event rules compiled to boolean columns.

A rule is a named list of conditions; every condition is one comparison of a factor column with
constants, and a null factor never satisfies it. Rules become columns, so any number of them is
evaluated in one pass over the factor table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Two names of the same factor are in use among rule authors.
ALIASES = {"rel_vol_20": "relative_volume", "gap_pct": "gap_percent"}


@dataclass(frozen=True)
class Condition:
    factor: str
    op: str
    value: object

    def column(self, columns: Sequence[str] | None = None) -> Column:
        name = self.factor
        if columns is not None and name not in columns:
            name = ALIASES.get(name, name)
            if name not in columns:
                raise KeyError(f"unknown factor {self.factor!r}")
        c = F.col(name)
        if self.op == "between":
            low, high = self.value
            pred = (c >= low) & (c <= high)
        else:
            try:
                pred = {
                    "eq": lambda: c == self.value,
                    "ne": lambda: c != self.value,
                    "gt": lambda: c > self.value,
                    "lt": lambda: c < self.value,
                    "gte": lambda: c >= self.value,
                    "lte": lambda: c <= self.value,
                }[self.op]()
            except KeyError:
                raise ValueError(f"unknown op {self.op!r}") from None
        return F.coalesce(pred, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    stage: str = "entry"
    trigger: str = "continuous"
    avoid: bool = False
    pre_condition: str | None = None
    hard_constraints: tuple[Condition, ...] = field(default=())
    min_expected_return: float | None = None
    min_confidence: float = 0.0

    def matches(self, columns: Sequence[str] | None = None) -> Column:
        return all_of(self.conditions, columns)

    def hard_ok(self, columns: Sequence[str] | None = None) -> Column:
        return all_of(self.hard_constraints, columns)


def all_of(conditions: Sequence[Condition], columns: Sequence[str] | None = None) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(columns)
    return out


def any_of(rules: Sequence[Rule], columns: Sequence[str] | None = None) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.matches(columns)
    return out


def rule(name: str, *conditions: tuple, **options) -> Rule:
    return Rule(name, tuple(Condition(*c) for c in conditions), **options)


_MID = ("session_phase", "eq", "mid")

# The published rule set, thresholds per second and in percent.
WATCH_RULES = (
    rule("gap_up_watch", ("entry_gap_pct", "gt", 0.0), stage="watch", trigger="first_entry"),
    rule("gap_up_watch_strong", ("entry_gap_pct", "gt", 4.0), stage="watch", trigger="first_entry"),
)
ENTRY_RULES = (
    rule("momentum_entry", _MID, ("trade_rate", "gt", 10), ("relative_volume", "gt", 2.0), pre_condition="gap_up_watch"),
    rule("activity_entry", _MID, ("trade_rate", "gt", 20), ("relative_volume", "gt", 1.5), pre_condition="gap_up_watch"),
    rule("high_conviction_entry", _MID, ("trade_rate", "gt", 50), ("relative_volume", "gt", 3.0), pre_condition="gap_up_watch_strong"),
    rule("volume_entry", _MID, ("relative_volume", "gt", 3.0), ("trade_rate", "gt", 5), pre_condition="gap_up_watch"),
    rule("volume_strong", _MID, ("relative_volume", "gt", 5.0), ("trade_rate", "gt", 5), pre_condition="gap_up_watch"),
    rule("volume_strong_10", _MID, ("relative_volume", "gt", 5.0), ("trade_rate", "gt", 10), pre_condition="gap_up_watch"),
    rule("volume_quote_strong", _MID, ("relative_volume", "gt", 5.0), ("trade_rate", "gt", 5), ("quote_rate", "gt", 5), pre_condition="gap_up_watch"),
)
ANTI_PATTERNS = (
    rule("reversal_gap_down", ("price_direction", "between", (0.3, 0.5)), ("gap_percent", "lt", -0.5), avoid=True),
    rule("false_breakout", ("price_direction", "between", (0.5, 0.7)), avoid=True),
    rule("non_mid_phase", ("session_phase", "ne", "mid"), avoid=True),
    rule("avoid_dead_ticker", _MID, ("trade_rate", "lt", 2), avoid=True),
    rule("avoid_low_rel_vol", _MID, ("relative_volume", "lt", 1.5), avoid=True),
    rule("avoid_high_bid_ask", _MID, ("bid_ask_spread", "gt", 70), avoid=True),
)
MODEL_RULE = Rule(
    "ml_momentum_entry",
    (),
    hard_constraints=(Condition(*_MID), Condition("trade_rate", "lt", 100), Condition("relative_volume", "between", (1.5, 10.0))),
    pre_condition="gap_up_watch",
    min_expected_return=0.02,
)
WATCH_TIMEOUT_MS = 30 * 60 * 1000

_SUFFIXES = ("gte", "lte", "gt", "lt", "ne", "eq", "between")


def keyword_conditions(**conditions) -> tuple[Condition, ...]:
    """factor__gt=1.0 style keywords; a bare keyword means equality."""
    out = []
    for key, value in conditions.items():
        name, sep, op = key.rpartition("__")
        out.append(Condition(name, op, value) if sep and op in _SUFFIXES else Condition(key, "eq", value))
    return tuple(out)
