"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gapwise.sources.tables import VIEWS, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLUMNS = {
    "events_m": ["event_id", "ts", "user_id", "event_type", "value"],
    "events_s": ["event_id", "ts", "user_id", "event_type", "value"],
    "orders_m": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "customer_m": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem_m": ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"],
    "part_m": ["p_partkey", "p_size", "p_retailprice", "p_brand"],
    "labelled_m": ["doc_id", "lang", "source", "quality", "toxic"],
}


def query(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register ``build`` over a view; in ``sql`` the view can be read by its name."""
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir, source))
    if sql is not None:
        head = f"WITH {source} AS ({VIEWS[source]})"
        ORACLES[name] = head + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else " " + sql.strip())


def per_column(source: str, template: str, columns: list[str] | None = None) -> str:
    """UNION ALL of a SELECT per column; {c} is its name."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns or COLUMNS[source])
