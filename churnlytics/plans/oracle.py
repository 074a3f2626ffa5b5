"""DuckDB oracle SQL for the registered queries.

Every statement starts from the same ``contracts`` view (FIXTURES §2) written
in plain SQL over the pre-registered test tables.
"""

from __future__ import annotations

from churnlytics.sources.testdata import TEST_CAMPAIGNS

CONTRACTS_SQL = """
SELECT
  o.o_orderkey AS id,
  o.o_custkey AS customer_id,
  (CAMPAIGN_LIST)[(o.o_custkey % 8)::INTEGER + 1] AS campaign,
  split_part((CAMPAIGN_LIST)[(o.o_custkey % 8)::INTEGER + 1], '-', 1) AS call_center,
  split_part((CAMPAIGN_LIST)[(o.o_custkey % 8)::INTEGER + 1], '-', 2) AS channel,
  ([9.9, 14.9, 19.9, 24.9, 29.9]::DOUBLE[])[(o.o_orderkey % 5)::INTEGER + 1] AS amount,
  (CASE WHEN o.o_orderstatus = 'O' THEN 0 ELSE 1 + o.o_orderkey % 7 END)::INTEGER AS deletion_type,
  (CASE WHEN o.o_custkey % 3 = 0 THEN 3783 ELSE 3402 END)::INTEGER AS product_code,
  n.n_name AS region_code,
  o.o_orderdate::DATE AS start_insurance,
  (o.o_orderdate::DATE + (365 * (1 + o.o_orderkey % 3))::INTEGER) AS end_insurance,
  li.first_due_date,
  li.last_due_date,
  CASE WHEN o.o_orderstatus <> 'O' THEN li.last_due_date END AS deletion_allowed_at,
  (o.o_orderdate::DATE - 1) AS report_date,
  (year(o.o_orderdate::DATE - 1) * 100 + month(o.o_orderdate::DATE - 1))::INTEGER AS acq_month,
  CASE WHEN o.o_orderstatus <> 'O' THEN
    (year(li.last_due_date + INTERVAL 1 MONTH) * 100 + month(li.last_due_date + INTERVAL 1 MONTH))::INTEGER
  END AS del_month
FROM orders o
LEFT JOIN (SELECT l_orderkey, min(l_shipdate::DATE) AS first_due_date, max(l_shipdate::DATE) AS last_due_date
           FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""".replace("CAMPAIGN_LIST", str(list(TEST_CAMPAIGNS)))

SPLIT_KEY_SQL = ("CASE WHEN campaign = 'FO-SCL' THEN campaign || '_' || replace(amount::VARCHAR, '.', '_') "
                 "ELSE campaign END")

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, extra_ctes: str = "") -> None:
    """Register ``body`` (a SELECT over ``contracts`` and optional CTEs)."""
    ctes = f"contracts AS ({CONTRACTS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    ORACLE[name] = f"WITH {ctes}\n{body}"


def all_oracles() -> dict[str, str]:
    from churnlytics.plans.catalog import all_queries
    all_queries()
    return dict(ORACLE)


def pivot_cols(keys, expr_for_key) -> str:
    """``expr AS "key"`` for each pivot key."""
    return ",\n  ".join(f'{expr_for_key(k)} AS "{k}"' for k in keys)
