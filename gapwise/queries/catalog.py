"""All queries of the library's own operators."""

from gapwise.queries import basic, series, statistics  # noqa: F401
from gapwise.queries.registry import ORACLES, QUERIES  # noqa: F401
