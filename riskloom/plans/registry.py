"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name; ``sql`` is its twin, if SQL can say it."""

    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _load() -> dict[str, tuple[Query, str | None]]:
    from riskloom.plans import catalog_cleaning, catalog_graph, catalog_learning, catalog_sequences, catalog_sources, catalog_users  # noqa: F401

    return _FOUND


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}


# ------------------------------------------------- comparable results
def finish(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Keys and texts as they are, numbers as doubles with the precision of a
    float and so many digits, so that the order of a sum does not show."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in keys}
    return df.select(*(F.round(F.col(c).cast("float").cast("double"), digits).alias(c) if c in numeric else F.col(c) for c in df.columns))


def finished(sql: str, *keys: str, digits: int = 6) -> str:
    """``finish`` in SQL; all columns but the keys must be numbers."""
    listed = ", ".join(keys)
    return f"SELECT {listed}, round(CAST(CAST(COLUMNS(* EXCLUDE ({listed})) AS FLOAT) AS DOUBLE), {digits}) FROM ({sql})"


def finished_all(sql: str, digits: int = 6) -> str:
    return f"SELECT round(CAST(CAST(COLUMNS(*) AS FLOAT) AS DOUBLE), {digits}) FROM ({sql})"


#: The statistics of riskloom.functions.aggregates in SQL.
STATS_SQL = {
    "count": "count({0})",
    "nunique": "count(DISTINCT {0})",
    "sum": "coalesce(sum({0}), 0)",
    "mean": "avg({0})",
    "min": "min({0})",
    "max": "max({0})",
    "var": "var_samp({0})",
    "std": "stddev_samp({0})",
    "skew": "CASE WHEN count({0}) >= 3 THEN CASE WHEN max({0}) = min({0}) THEN 0.0 ELSE skewness({0}) END END",
}


def stats_sql(value: str, names, prefix: str | None = None) -> str:
    return ", ".join(f"{STATS_SQL[n].format(value)} AS {prefix or value}_{n}" for n in names)


#: riskloom.sources.tables.actions and payments in SQL.
ACTIONS = """a AS (SELECT event_id, user_id AS uid, ts, epoch_us(ts) AS us, value, event_type AS mode, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour,
 CAST(json_extract(props, '$.k') AS INT) AS k, nullif(CAST(json_extract(props, '$.k') AS INT), 0) AS ip, nullif(CAST(json_extract(props, '$.k') AS INT) % 7, 0) AS dev,
 CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS action_type, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN -1 ELSE 1 END AS success FROM events)"""
PAYMENTS = """p AS (SELECT o_custkey AS uid, l_suppkey AS merchant, l_partkey AS account, o_orderkey AS orderkey, l_linenumber AS line, o_orderpriority AS channel,
 nullif(l_returnflag, 'N') AS market, l_extendedprice AS amount, l_quantity AS quantity, CAST(day(l_shipdate) AS INT) AS day, l_shipdate AS shipped, o_orderdate AS ordered
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
