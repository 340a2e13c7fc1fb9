"""Registry of named queries, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions that the SQL of several queries starts from: the market views of sources.tables.
VIEWS = {
    "competitors": "competitors AS (SELECT s_suppkey AS competitor_id, s_name AS name, n_name AS nation, r_name AS region, s_acctbal >= 0 AS enabled, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "pricing": "pricing AS (SELECT l_suppkey AS competitor_id, l_partkey AS service_id, p_name AS service_name, p_type AS category, p_brand AS brand, l_extendedprice / l_quantity AS price, l_discount AS discount, CAST(l_shipdate AS DATE) AS day, l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "services": "services AS (SELECT l_suppkey AS competitor_id, l_partkey AS service_id, p_name AS service_name, p_type AS category, p_brand AS brand, p_retailprice AS price FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)",
    "logs": "logs AS (SELECT o_orderkey AS log_id, o_custkey AS competitor_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS success, o_totalprice AS records FROM orders)",
    "changes": "changes AS (SELECT event_id, user_id AS competitor_id, event_type AS kind, ts, CAST(ts AS DATE) AS day, value, props FROM events)",
}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers the decorated (spark, sf_dir) -> DataFrame. sql may use the named VIEWS; a leading WITH RECURSIVE stays."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            text, word = sql.strip(), "WITH "
            if text.upper().startswith("WITH RECURSIVE "):
                word, text = "WITH RECURSIVE ", text[15:]
            elif text.upper().startswith("WITH "):
                text = text[5:]
            else:
                word = "WITH " if views else ""
                ORACLE_SQL[name] = f"{word}{', '.join(VIEWS[v] for v in views)} {text}".strip()
                return f
            ORACLE_SQL[name] = f"{word}{''.join(VIEWS[v] + ', ' for v in views)}{text}"
        return f

    return put
