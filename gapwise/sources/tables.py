"""Readers and writers, and the incomplete views that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str = "parquet", *, schema: str | None = None, null_value: str | None = None, **options: object) -> DataFrame:
    """parquet, orc, csv or json; ``null_value`` is a text that stands for missing in csv."""
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True))
        if null_value is not None:
            reader = reader.option("nullValue", null_value)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", *, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: object) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables are complete, so each query reads one through a rule for what is missing. The text is SQL in both engines.
VIEWS = {
    "events_m": """SELECT event_id, ts, user_id,
        CASE WHEN user_id % 7 = 0 AND event_id % 3 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN event_id % 10 IN (3, 4, 5) OR value > 140 THEN NULL ELSE value END AS value FROM events""",
    "events_s": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 10 IN (3, 4, 5) THEN CAST(-99.0 AS DOUBLE) ELSE value END AS value FROM events""",
    "orders_m": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderkey % 13 = 0 AND o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""",
    "customer_m": """SELECT c_custkey, c_nationkey,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
        CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "lineitem_m": """SELECT l_orderkey, l_partkey, l_quantity, l_discount,
        CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem""",
    "part_m": """SELECT p_partkey,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice,
        CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part""",
    "labelled_m": """SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
BASES = {"events_m": ("events",), "events_s": ("events",), "orders_m": ("orders",), "customer_m": ("customer",), "lineitem_m": ("lineitem",), "part_m": ("part",), "labelled_m": ("documents", "labels")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``, without registering any name."""
    return spark.sql(VIEWS[name].replace("FROM documents d LEFT JOIN labels l", "FROM {documents} d LEFT JOIN {labels} l") if name == "labelled_m" else VIEWS[name].replace(f"FROM {BASES[name][0]}", f"FROM {{{BASES[name][0]}}}"), **{t: table(spark, sf_dir, t) for t in BASES[name]})
