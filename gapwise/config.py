"""Settings that operators consult, and the decorator for deprecated names."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from gapwise.errors import ConfigurationError


@dataclass
class GapwiseConfig:
    """``large_df_threshold`` bounds the pairs of the pairwise operators before they warn."""

    large_df_threshold: int = 50_000
    knn_cat_neighbors_threshold: int = 5
    strict_mode: bool = False


config = GapwiseConfig()


def resolve_strict_mode(strict_mode: bool | None) -> bool:
    """The override, or else the setting; anything but True, False and None is an error before any job runs."""
    value = config.strict_mode if strict_mode is None else strict_mode
    if value is not True and value is not False:
        raise ConfigurationError("strict_mode", value, "must be True or False")
    return value


def deprecated_api(message: str | None = None, *, since: str | None = None, stacklevel: int = 2) -> Callable:
    """Warn with FutureWarning on each call."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args, **kwargs):
            text = message or f"{function.__name__} is deprecated"
            warnings.warn(text + (f" since {since}" if since else ""), FutureWarning, stacklevel=stacklevel)
            return function(*args, **kwargs)

        return call

    return wrap
