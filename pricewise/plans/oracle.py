"""SQL twins of the registered queries, for DuckDB over the driver's tables.

Each twin is written independently of the Spark code from the operator's
definition; the correctness gate runs both at sf0.01 and compares row counts,
column names and values. The fixture views are the definitions in FIXTURES.md.
"""

from __future__ import annotations

LISTING = """listing AS (
  SELECT o_orderkey AS listing_id, CAST(o_orderdate AS DATE) AS listing_dt, 'buy' AS listing_type,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'flat' ELSE 'house' END AS property_type,
    CASE o_orderstatus WHEN 'F' THEN 'freehold' WHEN 'O' THEN 'leasehold' ELSE 'unknown' END AS tenure,
    CASE WHEN n_name = 'NATION_0' THEN 'Newcastle Upon Tyne'
         WHEN n_name = 'NATION_1' AND o_orderkey % 100 = 0 THEN 'Newcastle upon Tyne'
         WHEN o_orderkey % 211 = 0 THEN NULL
         ELSE n_name END AS location,
    CAST(o_orderkey % 13 AS INT) AS bedroom_count,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 23 END AS DOUBLE) AS bathroom_count,
    o_totalprice * 2 AS asking_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

REVISION = """revision AS (
  SELECT l_orderkey AS listing_id, CAST(l_shipdate AS DATE) AS price_revision_dt,
    CASE WHEN l_linenumber = 7 THEN NULL
         ELSE o_totalprice * 2 * (0.95e0 + l_discount) END AS revised_purchase_price,
    l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CLEANED = """cleaned AS (
  SELECT listing_id, listing_dt, property_type, tenure,
    CASE WHEN location = 'Newcastle upon Tyne' THEN 'Newcastle Upon Tyne' ELSE location END AS location,
    bedroom_count, bathroom_count, asking_price
  FROM listing
  WHERE (bedroom_count IS NULL OR bedroom_count < 10 OR property_type IS NULL OR property_type <> 'flat')
    AND (bedroom_count IS NULL OR bedroom_count < 10 OR asking_price IS NULL OR asking_price > 500000)
    AND (bedroom_count IS NULL OR bedroom_count <> 0 OR asking_price IS NULL OR asking_price < 300000)
    AND (bathroom_count IS NULL OR bathroom_count < 15 OR bedroom_count IS NULL OR bedroom_count > 5))"""

DAILY = """daily AS (
  SELECT location, property_type, listing_dt, quantile_cont(asking_price, 0.5) AS asking_price
  FROM cleaned WHERE location IS NOT NULL GROUP BY location, property_type, listing_dt)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql.strip()
