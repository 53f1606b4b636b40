"""DuckDB text of the panel bindings, shared by every oracle query.

Written independently of the Spark code from the fixture rules in
FIXTURES.md; float literals are cast to DOUBLE because DuckDB reads
``0.03`` as a DECIMAL.
"""

from __future__ import annotations


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


# Property rows: raw sheet (28 columns) over lineitem x part x supplier x nation.
RAW_PROPERTY_ROWS = f"""
prop_base AS (
  SELECT l.*, p.p_type, p.p_retailprice, p.p_size, s.s_nationkey, n.n_name
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
raw_props AS (
  SELECT
    CAST(l_suppkey AS VARCHAR) AS asset_number,
    CASE WHEN l_suppkey % 5 = 0
         THEN strftime(DATE '1899-12-30' + CAST(34335 + l_suppkey % 365 AS INTEGER), '%Y-%m-%d')
         ELSE CAST(34335 + l_suppkey % 365 AS VARCHAR) END AS origination_date,
    {D(250500)} + (l_suppkey % 50) * {D(12500)} AS original_balance,
    CAST(36 + (l_suppkey % 8) * 12 AS DOUBLE) AS original_term,
    CASE WHEN l_suppkey % 5 = 0
         THEN strftime(DATE '1899-12-30' + CAST(34335 + l_suppkey % 365 + (3 + l_suppkey % 8) * 365 AS INTEGER), '%Y-%m-%d')
         ELSE CAST(34335 + l_suppkey % 365 + (3 + l_suppkey % 8) * 365 AS VARCHAR) END AS maturity_date,
    {D(0.03)} + (l_suppkey % 5) * {D(0.005)} AS interest_rate_orig,
    CAST((l_suppkey % 4) * 12 AS DOUBLE) AS io_term_months,
    'PT' || CAST(l_suppkey % 3 AS VARCHAR) AS payment_type_code,
    CASE WHEN l_suppkey % 3 = 0 THEN 'True' ELSE 'False' END AS is_io,
    l_extendedprice AS balance_begin,
    {D(0.03)} + (l_suppkey % 5) * {D(0.005)} + l_tax / 10 AS interest_rate_curr,
    l_extendedprice * (1 - l_discount) AS balance_end,
    l_linestatus AS payment_status,
    n_name AS state,
    CASE l_partkey % 6
      WHEN 0 THEN CAST(l_partkey AS VARCHAR)
      WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0')
      WHEN 2 THEN CAST(l_partkey AS VARCHAR) || '.0'
      WHEN 3 THEN ' ' || CAST(l_partkey AS VARCHAR) || ' '
      WHEN 4 THEN ''
      ELSE CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'n/a' END END AS zip_code,
    p_type AS property_type,
    p_retailprice * 100 AS appraisal_orig,
    CASE WHEN l_tax > 0 THEN l_quantity * p_retailprice END AS appraisal_current,
    {D(0.85)} + (l_suppkey % 10) / {D(100)} AS occupancy_orig,
    p_retailprice * 8 AS noi_orig,
    {D(1.0)} + p_size / {D(100)} AS dscr_orig,
    CASE WHEN l_quantity > 2 THEN l_quantity / 50 END AS occupancy_current,
    CASE WHEN l_tax > 0 THEN l_extendedprice * (1 - l_discount) * {D(0.1)} END AS noi_current,
    CASE WHEN l_tax <> 0 THEN {D(0.4)} + 15 * l_tax END AS dscr_current,
    CAST(l_suppkey AS VARCHAR) AS asset_left,
    CAST(1000000 + s_nationkey AS VARCHAR) AS cik,
    strftime(l_shipdate, '%Y-%m') AS report_period,
    CAST(l_returnflag = 'R' AND l_discount >= {D(0.095)} AND l_quantity >= 48 AS INTEGER) AS default_flag,
    {{'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'd': l_shipdate}} AS row_order
  FROM prop_base
)"""

# Cleaning (P2/P3/P4/P6/P8/P10/P11/P13/P15) in SQL.
_SERIAL_TEXT = ("COALESCE(CASE WHEN TRY_CAST({c} AS DOUBLE) BETWEEN -693593 AND 2958465 "
                "THEN strftime(DATE '1899-12-30' + CAST(floor(TRY_CAST({c} AS DOUBLE)) AS INTEGER), '%Y-%m-%d') END, {c})")
ZIP_SQL = ("COALESCE(CASE WHEN length(CAST(CAST(trunc(TRY_CAST(split_part(trim({c}), '-', 1) AS DOUBLE)) AS BIGINT) AS VARCHAR)) >= 5 "
           "THEN CAST(CAST(trunc(TRY_CAST(split_part(trim({c}), '-', 1) AS DOUBLE)) AS BIGINT) AS VARCHAR) "
           "ELSE lpad(CAST(CAST(trunc(TRY_CAST(split_part(trim({c}), '-', 1) AS DOUBLE)) AS BIGINT) AS VARCHAR), 5, '0') END, '00000')")


def serial_text_sql(c: str) -> str:
    return _SERIAL_TEXT.format(c=c)


def zip_sql(c: str) -> str:
    return ZIP_SQL.format(c=c)


CLEAN_PROPERTY_ROWS = RAW_PROPERTY_ROWS + f""",
clean1 AS (
  SELECT * REPLACE (
    {serial_text_sql('origination_date')} AS origination_date,
    {serial_text_sql('maturity_date')} AS maturity_date,
    COALESCE(CAST(TRY_CAST(CAST(default_flag AS VARCHAR) AS DOUBLE) AS INTEGER), 0) AS default_flag,
    COALESCE(lower(CAST(is_io AS VARCHAR)) = 'true', false) AS is_io,
    {zip_sql('zip_code')} AS zip_code),
    TRY_CAST(substr(report_period, 1, 4) AS INTEGER) AS year,
    TRY_CAST(substr(report_period, 6, 2) AS INTEGER) AS month
  FROM raw_props
),
props AS (
  SELECT *,
    CASE WHEN appraisal_orig > 0 THEN original_balance / appraisal_orig END AS ltv_orig,
    CASE WHEN appraisal_current > 0 THEN balance_end / appraisal_current END AS ltv_current,
    concat_ws('_', COALESCE(origination_date, 'NA'), COALESCE(maturity_date, 'NA'),
              COALESCE(zip_code, '00000'), COALESCE(property_type, 'NA'),
              CAST(CAST(round_even(COALESCE(original_balance, 0), -3) AS BIGINT) AS VARCHAR)) AS loan_uid,
    CASE WHEN COALESCE(is_io, false)
              OR (COALESCE(io_term_months, 0) > 0 AND COALESCE(original_term, 0) > 0
                  AND COALESCE(io_term_months, 0) >= COALESCE(original_term, 0) * {D(0.9)})
         THEN 'Interest-Only'
         WHEN COALESCE(io_term_months, 0) > 0 THEN 'Partial IO'
         ELSE 'Amortizing' END AS payment_type
  FROM clean1
)"""


# Wide loan-month panel (FIXTURES B1 rules).
LOAN_MONTH_PANEL = f"""
lm_base AS (
  SELECT l.*, p.p_type, p.p_retailprice, n.n_name,
         strftime(l.l_shipdate, '%Y-%m') AS period,
         l.l_extendedprice * (1 - l.l_discount) AS net,
         CAST(l.l_returnflag = 'R' AND l.l_discount >= {D(0.095)} AND l.l_quantity >= 48 AS INTEGER) AS flag
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
lm_ptype AS (
  SELECT l_suppkey, period, p_type FROM (
    SELECT l_suppkey, period, p_type,
           row_number() OVER (PARTITION BY l_suppkey, period ORDER BY count(*) DESC, p_type) AS rk
    FROM lm_base GROUP BY l_suppkey, period, p_type) WHERE rk = 1
),
lm_agg AS (
  SELECT l_suppkey AS asset_number, period,
         max(flag) AS default_flag,
         min(tax_pp) AS min_tax, CAST(sum(tax_pp) AS DOUBLE) / count(*) AS avg_tax, max(disc_pp) AS max_disc,
         sum(cents * (100 - disc_pp)) AS sum_net, min(qty) AS min_qty, CAST(sum(qty) AS DOUBLE) / count(*) AS avg_qty,
         sum(cents) AS sum_cents,
         sum(CASE WHEN tax_pp > 0 THEN qty * retail_c END) AS appr_c,
         any_value(n_name) AS state, count(*) AS n_properties
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_discount * 100) AS BIGINT) AS disc_pp, CAST(round(l_tax * 100) AS BIGINT) AS tax_pp,
               CAST(l_quantity AS BIGINT) AS qty, CAST(round(p_retailprice * 100) AS BIGINT) AS retail_c
        FROM lm_base) GROUP BY l_suppkey, period
),
panel AS (
  SELECT a.asset_number, a.period,
    CAST(a.period || '-01' AS DATE) AS period_dt,
    a.default_flag,
    {D(1000000)} + (a.asset_number % 100) * {D(25000)} AS orig_amount,
    CAST(36 + (a.asset_number % 8) * 12 AS DOUBLE) AS orig_term,
    {D(360)} AS orig_amort_term,
    {D(0.03)} + (a.asset_number % 5) * {D(0.005)} AS orig_rate,
    CAST(1 + a.asset_number % 2 AS DOUBLE) AS rate_type_code,
    CAST((a.asset_number % 4) * 12 AS DOUBLE) AS io_term,
    CAST(a.asset_number % 3 = 0 AS DOUBLE) AS io_flag,
    CAST(a.asset_number % 2 = 0 AS DOUBLE) AS balloon_flag,
    CAST(5 + a.asset_number % 11 AS DOUBLE) AS grace_days,
    'L' || CAST(1 + a.asset_number % 2 AS VARCHAR) AS lien_code,
    'PT' || CAST(a.asset_number % 3 AS VARCHAR) AS payment_type_code,
    CAST(a.sum_net AS DOUBLE) / {D(10000)} AS sched_balance,
    date_diff('day', DATE '1899-12-30', min(CAST(a.period || '-01' AS DATE)) OVER (PARTITION BY a.asset_number)) AS first_due_serial,
    date_diff('day', DATE '1899-12-30',
              CAST(min(CAST(a.period || '-01' AS DATE)) OVER (PARTITION BY a.asset_number)
                   + to_months(CAST(36 + (a.asset_number % 8) * 12 AS INTEGER)) AS DATE)) AS maturity_serial,
    CASE t.p_type WHEN 'ECONOMY' THEN 'RT' WHEN 'LARGE' THEN 'OF' WHEN 'MEDIUM' THEN 'LO'
                  WHEN 'PROMO' THEN 'MF' WHEN 'SMALL' THEN 'SS' WHEN 'STANDARD' THEN 'MU' END AS property_type,
    a.state,
    CAST(1950 + a.asset_number % 60 AS DOUBLE) AS year_built,
    ({D(1000000)} + (a.asset_number % 100) * {D(25000)}) * {D(1.25)} AS valuation,
    CAST(20000 + (a.asset_number % 40) * 2500 AS DOUBLE) AS sq_feet,
    CASE WHEN a.asset_number % 13 <> 0 THEN (55 + a.asset_number % 40) / {D(100)} END AS ltv_orig,
    (80 + a.asset_number % 20) / {D(100)} AS occ_orig,
    ({D(1000000)} + (a.asset_number % 100) * {D(25000)}) * {D(0.09)} AS noi_orig,
    CASE WHEN a.asset_number % 17 <> 0 THEN (85 + (a.asset_number % 16) * 5) / {D(100)} END AS dscr_orig,
    CASE WHEN a.max_disc < 10 THEN CAST(a.sum_net AS DOUBLE) / a.n_properties / {D(10000)} / {D(60000)} END AS ltv_curr,
    CASE WHEN a.min_tax <> 0 THEN {D(0.4)} + {D(15)} * a.avg_tax / {D(100)} END AS dscr_curr,
    CASE WHEN a.min_qty > 2 THEN a.avg_qty / {D(50)} END AS occ_curr,
    CAST(a.sum_cents AS DOUBLE) / {D(100)} AS gross_balance, CAST(a.appr_c AS DOUBLE) / {D(100)} AS appraisal_curr,
    t.p_type AS property_type_raw, a.n_properties
  FROM lm_agg a JOIN lm_ptype t ON a.asset_number = t.l_suppkey AND a.period = t.period
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def rounded(sql: str, cols: dict[str, int]) -> str:
    """Wrap ``sql`` so the named double columns are rounded as ``fixed_round`` does."""
    if not cols:
        return sql
    rep = ", ".join(f"floor({c} * CAST({10 ** n} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10 ** n} AS DOUBLE) AS {c}"
                    for c, n in cols.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"
