"""Configured factor sets: named bar factors with checked parameters and timeframes, compiled to columns."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tapewright.operators import bar_factors as B

_MAKERS: dict[str, Callable[..., Column]] = {}


def bar_factor(name: str) -> Callable:
    """Register `fn(window, **params) -> Column` as a bar factor."""

    def wrap(fn: Callable[..., Column]) -> Callable[..., Column]:
        if name in _MAKERS:
            raise ValueError(f"factor {name!r} exists")
        _MAKERS[name] = fn
        return fn

    return wrap


for _name, _fn in {
    "relative_volume": B.relative_volume,
    "gap_percent": B.gap_percent,
    "volume_acceleration": B.volume_acceleration,
    "vwap_deviation": B.vwap_deviation,
    "momentum": B.momentum,
    "volume_ratio": B.volume_ratio,
}.items():
    bar_factor(_name)(_fn)
bar_factor("price_direction")(lambda w: B.price_direction())


@dataclass(frozen=True)
class FactorSpec:
    """One configured factor: output id, factor name, numeric parameters, timeframes it applies to."""

    id: str
    factor: str
    params: Mapping[str, float] = field(default_factory=dict)
    timeframes: Sequence[str] = ()

    def column(self, window) -> Column:
        return _MAKERS[self.factor](window, **self.params).alias(self.id)


def check_params(config: Mapping[str, Mapping], makers: Mapping[str, Callable], skip: int) -> list[tuple[str, str, dict]]:
    """(output id, factor name, parameters) of a checked configuration; `skip` leading arguments of a maker are no parameters."""
    out = []
    for fid, c in config.items():
        name = c.get("factor", fid)
        if name not in makers:
            raise ValueError(f"{fid}: unknown factor {name!r}")
        params = dict(c.get("params", {}))
        known = list(inspect.signature(makers[name]).parameters)[skip:]
        for k, v in params.items():
            if k not in known:
                raise ValueError(f"{fid}: unknown parameter {k!r}, known: {known}")
            if isinstance(v, str) or not isinstance(v, (int, float)):
                raise ValueError(f"{fid}: parameter {k!r} is not a number: {v!r}")
        out.append((fid, name, params))
    return out


def parse_specs(config: Mapping[str, Mapping]) -> list[FactorSpec]:
    """Check a configuration: known factor, known parameter names, numeric values (a number in quotes is an error)."""
    return [FactorSpec(fid, name, params, tuple(config[fid].get("timeframes", ()))) for fid, name, params in check_params(config, _MAKERS, 1)]


def add_factors(bars: DataFrame, specs: Sequence[FactorSpec], timeframe: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """All factors of a timeframe over one sort; a spec without timeframes applies to every one."""
    w = B.bar_window(keys)
    return bars.select("*", *[s.column(w) for s in specs if not s.timeframes or timeframe in s.timeframes])
