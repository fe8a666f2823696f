"""Typed errors. All derive from GapwiseError."""

from __future__ import annotations

from collections.abc import Iterable


class GapwiseError(Exception):
    """Base class."""


class ImputationError(GapwiseError):
    """A model could not be fitted or applied for a column in strict mode."""

    def __init__(self, column: str, strategy: str, original: BaseException | None = None):
        self.column, self.strategy, self.original = column, strategy, original
        super().__init__(f"{strategy} failed on column {column!r}: {original}")


class InsufficientDataError(GapwiseError):
    """A column has fewer observed values than an operator needs."""

    def __init__(self, column: str, n_observed: int, n_required: int = 1):
        self.column, self.n_observed, self.n_required = column, n_observed, n_required
        super().__init__(f"column {column!r} has {n_observed} observed values; {n_required} needed")


class InvalidStrategyError(GapwiseError, ValueError):
    """An option outside its allowed values."""

    def __init__(self, param: str, got: object, allowed: Iterable[object], example: str | None = None):
        self.param, self.got, self.allowed, self.example = param, got, sorted(map(str, allowed)), example
        super().__init__(f"{param}={got!r}; allowed: {', '.join(self.allowed)}" + (f"; for example {example}" if example else ""))


class MissingColumnError(GapwiseError, KeyError):
    """Columns that the frame doesn't have."""

    def __init__(self, columns: Iterable[str], available: Iterable[str]):
        self.columns, self.available = list(columns), list(available)
        super().__init__(f"no column {', '.join(map(repr, self.columns))}; available: {', '.join(self.available)}")

    def __str__(self) -> str:
        return self.args[0]


class ConfigurationError(GapwiseError, ValueError):
    """A parameter of the wrong kind."""

    def __init__(self, param: str, got: object, reason: str):
        self.param, self.got, self.reason = param, got, reason
        super().__init__(f"{param}={got!r}: {reason}")
