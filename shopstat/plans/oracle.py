"""Independent SQL (DuckDB dialect) for each catalogue query.

Written directly against the raw tables, not generated from the Spark
plans.  Double outputs are rounded half to even to 6 decimals and dates are
ISO text, as the catalogue presents them; integer columns that can hold
nulls are returned as DOUBLE, the form they take in a pandas frame.
p-values: Student's t by Simpson integration of the density (2,000
intervals), chi-square by the closed form for even degrees of freedom.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the package shows.
AGE_BANDS = [(14, "1: less than 14"), (18, "2: 14 – 17"), (24, "3: 18 – 23"), (28, "4: 24 – 27"), (35, "5: 28 – 34"),
             (50, "6: 35 – 49"), (66, "7: 50 – 65"), (99, "8: more than 65")]
AGE_NOT_SET = "9: Not set"
AMOUNT_BANDS = [(0, "0: Not set"), (200000, "1: less than 200,000"), (300000, "2: 200,000 - 300,000"),
                (500000, "3: 300,000 - 500,000"), (2000000, "4: 500,000 - 2,000,000"), (100000000, "5: more than 2,000,000")]
AMOUNT_TOP = "6: more than 100,000,000"
AGE_AS_OF = "1999-06-30"
METRIC_KEYS = {1: "order_value", 2: "items", 3: "clicks", 4: "delivery_cost", 5: "unique_products"}
METRIC_LABELS = {1: "Average order value", 2: "Number of items per order", 3: "Number of clicks before booking",
                 4: "Average delivery cost", 5: "Number of unique products"}
QUANTILES = [0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.97, 0.99, 0.995, 0.997, 0.999, 1]
SEGMENT_GROUPS = ("BUILDING", "MACHINERY")
SOURCE_GROUPS = ("WEB", "MOBILE")
COUNTED_EVENTS, MARKER_EVENTS = ["click", "view", "error"], ["signup", "purchase"]
STEP2_EVENTS, STEP3_EVENTS = ["click", "view"], ["signup"]
BOOKING_EVENT, CART_EVENT, MENS_PRODUCT_TYPE = "purchase", "signup", "ECONOMY"


def _case(expr: str, bands, otherwise: str) -> str:
    whens = " ".join(f"WHEN {expr} < {b} THEN '{label}'" for b, label in bands)
    return f"CASE {whens} ELSE '{otherwise}' END"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,9)) AS DECIMAL(18,2))"


def _cap(expr: str) -> str:
    return f"(upper(({expr})[1]) || lower(({expr})[2:]))"


def _session_cols() -> str:
    cols = []
    for e in sorted(set(COUNTED_EVENTS) | set(MARKER_EVENTS)):
        t = f"CASE WHEN event_name = '{e}' THEN event_time END"
        if e in COUNTED_EVENTS:
            cols += [f"CAST(count({t}) AS INTEGER) AS {e}_cnt", f"min({t}) AS {e}_first_time",
                     f"max({t}) AS {e}_last_time"]
        else:
            cols.append(f"min({t}) AS {e}_time")
    return ",\n    ".join(cols)


ROLE_CTES = f"""
tx_raw AS (
  SELECT o_orderkey AS booking_id, o_custkey AS session_id, o_custkey AS customer_id,
    o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS created_at,
    o_orderdate + to_hours(CAST((o_orderkey % 10) * 24 + o_orderkey % 24 AS BIGINT)) AS shipment_date_limit,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice * 0.01 END AS shipment_fee,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.05 ELSE CAST(0 AS DOUBLE) END AS promo_amount,
    CASE WHEN o_orderkey % 3 = 0 THEN 'PROMO' || CAST(o_orderkey % 4 AS VARCHAR) END AS promo_code,
    o_orderpriority AS payment_method, o_orderstatus AS payment_status, o_totalprice AS total_amount
  FROM orders),
tx AS (
  SELECT booking_id, session_id, customer_id,
    date_trunc('second', created_at) AS created_at,
    date_trunc('second', shipment_date_limit) AS shipment_date_limit,
    CAST(floor((epoch(date_trunc('second', shipment_date_limit)) - epoch(date_trunc('second', created_at))) / 86400)
         AS INTEGER) AS days_to_shipment,
    CASE WHEN promo_amount > 0 THEN 1 ELSE 0 END AS promo_flag,
    {_money('promo_amount')} AS promo_amount,
    promo_code, payment_method, payment_status,
    {_money('shipment_fee')} AS shipment_fee,
    {_money('total_amount')} AS total_amount,
    CASE WHEN shipment_fee = 0 THEN 1 ELSE 0 END AS has_free_shipping,
    CASE WHEN promo_amount > 0 THEN 1 ELSE 0 END AS has_promo
  FROM tx_raw),
lines AS (
  SELECT l_orderkey AS booking_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
    l_extendedprice AS item_price, CAST(l_quantity AS BIGINT) * l_extendedprice AS product_amount
  FROM lineitem),
cust AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS segment,
    CASE WHEN c_custkey % 50 = 0 THEN NULL
         ELSE CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS TIMESTAMP) END AS birthdate,
    CAST(c_nationkey AS VARCHAR) AS home_location,
    CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS device_version
  FROM customer),
prods AS (
  SELECT p_partkey AS prod_id, p_name AS prod_name,
    {_cap('p_type')} AS category_level_1,
    replace(p_brand, '#', ' ') AS category_level_2,
    {_cap("split_part(p_name, ' ', 2)")} AS category_level_3,
    CASE WHEN p_type = '{MENS_PRODUCT_TYPE}' THEN 'Men' ELSE 'Women' END AS gender,
    split_part(p_name, ' ', 1) AS baseColour,
    CAST(NULL AS VARCHAR) AS season,
    CAST(2010 + p_size % 10 AS BIGINT) AS year,
    CAST(NULL AS VARCHAR) AS usage
  FROM part),
ev AS (
  SELECT event_id, user_id AS session_id, event_type AS event_name,
    date_trunc('second', ts) AS event_time,
    CASE WHEN user_id % 2 = 0 THEN 'WEB' ELSE 'MOBILE' END AS traffic_source,
    props AS event_metadata, value
  FROM events),
sess_src AS (
  SELECT session_id, traffic_source,
    {_session_cols()}
  FROM ev WHERE session_id IS NOT NULL
  GROUP BY session_id, traffic_source),
sess_tot AS (
  SELECT session_id,
    CAST(count(event_id) AS INTEGER) AS session_events_cnt,
    min(event_time) AS session_start_time,
    max(event_time) AS session_end_time,
    min(CASE WHEN event_name IN ({_list(STEP2_EVENTS)}) THEN event_time END) AS step2_time,
    min(CASE WHEN event_name IN ({_list(STEP3_EVENTS)}) THEN event_time END) AS step3_time
  FROM ev WHERE session_id IS NOT NULL
  GROUP BY session_id),
sess AS (
  SELECT s.*, t.session_events_cnt, t.session_start_time, t.session_end_time, t.step2_time, t.step3_time
  FROM sess_src s JOIN sess_tot t ON s.session_id = t.session_id
  WHERE s.traffic_source IS NOT NULL),
summ AS (
  SELECT l.booking_id, count(DISTINCT l.product_id) AS dist_prod_id, CAST(sum(l.quantity) AS BIGINT) AS prods_cnt,
    max(CASE WHEN p.gender = 'Men' THEN 1 ELSE 0 END) AS has_mens_prods
  FROM lines l JOIN prods p ON l.product_id = p.prod_id
  GROUP BY l.booking_id),
mart AS (
  SELECT t.created_at AS created_dt, t.booking_id, t.customer_id, t.session_id, t.payment_method,
    t.payment_status, t.promo_code, t.promo_amount, t.shipment_fee, t.shipment_date_limit, t.total_amount,
    {_case('t.total_amount', AMOUNT_BANDS, AMOUNT_TOP)} AS total_amount_category,
    CASE WHEN t.promo_amount > 0 THEN 1 ELSE 0 END AS has_promo,
    CAST(date_diff('day', CAST(t.created_at AS DATE), CAST(t.shipment_date_limit AS DATE)) AS INTEGER)
      AS days_to_delivery,
    {_case('(year(t.created_at) - year(c.birthdate))', AGE_BANDS, AGE_NOT_SET)} AS customer_age_category,
    s.dist_prod_id, s.prods_cnt, s.has_mens_prods,
    row_number() OVER (PARTITION BY t.customer_id ORDER BY t.created_at, t.booking_id) AS booking_number
  FROM tx t JOIN cust c ON t.customer_id = c.customer_id JOIN summ s ON s.booking_id = t.booking_id),
cart AS (
  SELECT event_id, session_id, event_time, traffic_source, value,
    CAST(json_extract_string(event_metadata, '$.k') AS BIGINT) AS k
  FROM ev WHERE event_name = '{CART_EVENT}')
"""


def _with(body: str, extra: str = "") -> str:
    ctes = ROLE_CTES.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"


# ---------------------------------------------------------------- t-tests

def _units(metric_id: int, grouping: str) -> str:
    dim = ("JOIN cust c ON u.customer_id = c.customer_id", "c.segment") if grouping == "segment" \
        else ("JOIN sess s ON u.session_id = s.session_id", "s.traffic_source")
    if metric_id in (1, 4):
        col = "total_amount" if metric_id == 1 else "shipment_fee"
        return (f"SELECT {dim[1]} AS grp, CAST(u.{col} AS DOUBLE) AS value FROM tx u {dim[0]}")
    if metric_id in (2, 5):
        agg = "sum(l.quantity)" if metric_id == 2 else "count(DISTINCT l.product_id)"
        return (f"SELECT {dim[1]} AS grp, CAST(u.v AS DOUBLE) AS value FROM ("
                f"SELECT t.booking_id, t.customer_id, t.session_id, {agg} AS v "
                f"FROM tx t JOIN lines l ON t.booking_id = l.booking_id "
                f"GROUP BY t.booking_id, t.customer_id, t.session_id) u {dim[0]}")
    if grouping == "source":
        return "SELECT traffic_source AS grp, CAST(click_cnt AS DOUBLE) AS value FROM sess"
    return ("SELECT c.segment AS grp, CAST(s.click_cnt AS DOUBLE) AS value FROM sess s "
            "JOIN tx t ON s.session_id = t.session_id JOIN cust c ON t.customer_id = c.customer_id")


def ttest_sql(metric_id: int, grouping: str) -> str:
    g1, g2 = (SEGMENT_GROUPS if grouping == "segment" else SOURCE_GROUPS)
    label = METRIC_LABELS[metric_id]
    nl = "' || chr(10) || '"
    extra = f"""
units AS ({_units(metric_id, grouping)}),
m AS (
  SELECT count(CASE WHEN upper(trim(grp)) = '{g1}' THEN 1 END) AS n_1,
    avg(CASE WHEN upper(trim(grp)) = '{g1}' THEN value END) AS mean_1,
    stddev_samp(CASE WHEN upper(trim(grp)) = '{g1}' THEN value END) AS std_1,
    count(CASE WHEN upper(trim(grp)) = '{g2}' THEN 1 END) AS n_2,
    avg(CASE WHEN upper(trim(grp)) = '{g2}' THEN value END) AS mean_2,
    stddev_samp(CASE WHEN upper(trim(grp)) = '{g2}' THEN value END) AS std_2
  FROM units WHERE upper(trim(grp)) IN ('{g1}', '{g2}')),
ab AS (SELECT *, std_1 * std_1 / n_1 AS a, std_2 * std_2 / n_2 AS b FROM m WHERE n_1 > 0 AND n_2 > 0),
tt AS (SELECT *, (mean_1 - mean_2) / sqrt(a + b) AS t_statistic,
         (a + b) * (a + b) / (a * a / (n_1 - 1) + b * b / (n_2 - 1)) AS df FROM ab),
area AS (
  SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi())
                   - (df + 1) / 2 * ln(1 + power(i * abs(t_statistic) / 2000, 2) / df)))
         * max(abs(t_statistic)) / 2000 / 3 AS s
  FROM tt, range(0, 2001) g(i)),
res AS (SELECT tt.*, greatest(1 - 2 * area.s, 0.0) AS p_value FROM tt, area),
dec AS (SELECT *, CASE WHEN p_value < 0.05 THEN 'Significant difference'
                       ELSE 'No statistically significant difference' END AS decision FROM res)
"""
    body = f"""
SELECT '{label}' AS metric, '{g1}' AS group_1, '{g2}' AS group_2,
  n_1, round_even(mean_1, 6) AS mean_1, round_even(std_1, 6) AS std_1,
  n_2, round_even(mean_2, 6) AS mean_2, round_even(std_2, 6) AS std_2,
  round_even(t_statistic, 6) AS t_statistic, round_even(df, 6) AS df, round_even(p_value, 6) AS p_value,
  decision,
  printf('t-test — %s{nl}Groups: %s vs %s{nl}t-statistic: %.4f{nl}p-value: %.4f{nl}Conclusion: %s (alpha=0.05)',
         '{label}', '{g1}', '{g2}', t_statistic, p_value, decision) AS report
FROM dec
"""
    return _with(body, extra)


# ---------------------------------------------------------------- chi-square

def _payment_customers(grouping: str) -> str:
    if grouping == "segment":
        return (f"SELECT t.payment_method, c.segment AS grp, c.customer_id, count(*) AS transactions_cnt "
                f"FROM mart t JOIN cust c ON t.customer_id = c.customer_id "
                f"WHERE c.segment IN ({_list(SEGMENT_GROUPS)}) "
                f"GROUP BY t.payment_method, c.segment, c.customer_id")
    return (f"SELECT t.payment_method, s.traffic_source AS grp, c.customer_id, count(*) AS transactions_cnt "
            f"FROM tx t JOIN sess s ON t.session_id = s.session_id JOIN cust c ON t.customer_id = c.customer_id "
            f"WHERE s.traffic_source IN ({_list(SOURCE_GROUPS)}) "
            f"GROUP BY t.payment_method, s.traffic_source, c.customer_id")


def _crosstab_cte(grouping: str) -> str:
    g1, g2 = SEGMENT_GROUPS if grouping == "segment" else SOURCE_GROUPS
    return f"""
pc AS ({_payment_customers(grouping)}),
ct AS (
  SELECT payment_method,
    count(CASE WHEN grp = '{g1}' THEN 1 END) AS c1,
    count(CASE WHEN grp = '{g2}' THEN 1 END) AS c2
  FROM pc WHERE payment_method IS NOT NULL AND grp IN ('{g1}', '{g2}')
  GROUP BY payment_method)
"""


_CONTINGENCY = """
cell AS (
  SELECT payment_method, upper(trim(c.segment)) AS segment, count(DISTINCT t.customer_id) AS n
  FROM tx t JOIN cust c ON t.customer_id = c.customer_id
  WHERE payment_method IS NOT NULL AND c.segment IS NOT NULL GROUP BY ALL),
cells AS (
  SELECT payment_method, segment, n, CAST(sum(n) OVER (PARTITION BY payment_method) AS BIGINT) AS row_n,
    CAST(sum(n) OVER (PARTITION BY segment) AS BIGINT) AS col_n, CAST(sum(n) OVER () AS BIGINT) AS total FROM cell)
"""
# every cell of the grid, also those without customers
_CHI2_ALL = """
grid AS (
  SELECT coalesce(n, 0) AS n, CAST(row_n AS DOUBLE) * col_n / total AS e, total
  FROM (SELECT DISTINCT payment_method, row_n, total FROM cells) CROSS JOIN (SELECT DISTINCT segment, col_n FROM cells)
  LEFT JOIN cell USING (payment_method, segment)),
whole AS (
  SELECT max(total) AS n, sum(power(n - e, 2) / e) AS statistic,
    (SELECT (count(DISTINCT payment_method) - 1) * (count(DISTINCT segment) - 1) FROM cells) AS dof FROM grid),
tail AS (
  SELECT *, exp(-statistic / 2) * list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)),
                lambda j: exp(j * ln(statistic / 2) - lgamma(j + 1)))) AS p FROM whole)
"""


def chi2_sql(grouping: str) -> str:
    title = "Segment" if grouping == "segment" else "Traffic source"
    question = f"Does the share of payment methods differ across {title}?"
    hdr = " / ".join(SEGMENT_GROUPS if grouping == "segment" else SOURCE_GROUPS)
    nl = "' || chr(10) || '"
    extra = _crosstab_cte(grouping) + """,
tot AS (SELECT CAST(sum(c1) AS DOUBLE) AS s1, CAST(sum(c2) AS DOUBLE) AS s2,
          CAST(sum(c1 + c2) AS DOUBLE) AS n, count(*) AS r FROM ct),
dofs AS (SELECT (r - 1) * ((CASE WHEN s1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN s2 > 0 THEN 1 ELSE 0 END) - 1)
           AS dof FROM tot),
terms AS (
  SELECT CAST(ct.c1 + ct.c2 AS DOUBLE) * tot.s1 / tot.n AS e1, CAST(ct.c1 + ct.c2 AS DOUBLE) * tot.s2 / tot.n AS e2,
    ct.c1, ct.c2, dofs.dof, tot.n, tot.s1, tot.s2, coalesce(ct.payment_method, 'null') AS m_label
  FROM ct, tot, dofs),
x AS (
  SELECT sum(power(CASE WHEN dof = 1 THEN greatest(abs(c1 - e1) - 0.5, 0) ELSE abs(c1 - e1) END, 2) / e1
           + power(CASE WHEN dof = 1 THEN greatest(abs(c2 - e2) - 0.5, 0) ELSE abs(c2 - e2) END, 2) / e2)
           AS statistic,
    max(dof) AS dof, max(n) AS n,
    string_agg(m_label || ': ' || CAST(c1 AS VARCHAR) || ' / ' || CAST(c2 AS VARCHAR), chr(10)
               ORDER BY m_label || ': ' || CAST(c1 AS VARCHAR) || ' / ' || CAST(c2 AS VARCHAR)) AS counts,
    string_agg(m_label || ': ' || printf('%.0f%%', round_even(c1 * 100.0 / s1, 0)) || ' / '
                 || printf('%.0f%%', round_even(c2 * 100.0 / s2, 0)), chr(10)
               ORDER BY m_label || ': ' || printf('%.0f%%', round_even(c1 * 100.0 / s1, 0)) || ' / '
                 || printf('%.0f%%', round_even(c2 * 100.0 / s2, 0))) AS pcts
  FROM terms),
px AS (
  SELECT *, exp(-statistic / 2) * list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)),
                lambda j: exp(j * ln(statistic / 2) - lgamma(j + 1)))) AS p
  FROM x WHERE dof > 0)
"""
    body = f"""
SELECT CAST(n AS BIGINT) AS n, round_even(statistic, 6) AS statistic, CAST(dof AS BIGINT) AS dof,
  round_even(p, 6) AS p_value,
  CASE WHEN p < 0.05 THEN 'Reject independence' ELSE 'No evidence against independence' END AS decision,
  printf('%s{nl}Number of customers ({hdr}):{nl}%s{nl}Share of customers within each column ({hdr}):{nl}%s{nl}'
         'Null hypothesis: the distributions are independent.{nl}P-value of Chi-square test = %.3f{nl}%s',
         '{question}', counts, pcts, p,
         CASE WHEN p < 0.05 THEN 'We reject the null hypothesis.'
              ELSE 'We fail to reject the null hypothesis.' END) AS report
FROM px
"""
    return _with(body, extra)


# ---------------------------------------------------------------- the rest

def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _key_quality() -> str:
    parts = []
    for name, rel, key in (("transactions", "tx", "booking_id"), ("customers", "cust", "customer_id"),
                           ("products", "prods", "prod_id"), ("sessions", "sess", "session_id"),
                           ("events_add_to_cart", "cart", "event_id")):
        parts.append(
            f"SELECT '{name}' AS table_name, '{key}' AS key_column, count(*) AS rows, "
            f"count(*) FILTER (WHERE {key} IS NULL) AS null_keys, "
            f"count(*) - count(DISTINCT {key}) AS duplicate_keys, "
            f"CAST(max(length(rtrim(CAST({key} AS VARCHAR)))) AS BIGINT) AS max_key_len FROM {rel}")
    return _with(_union(parts))


TX_TYPES = [
    ("booking_id", "bigint"), ("session_id", "bigint"), ("customer_id", "bigint"),
    ("created_at", "timestamp_ntz"), ("shipment_date_limit", "timestamp_ntz"), ("days_to_shipment", "int"),
    ("promo_flag", "int"), ("promo_amount", "decimal(18,2)"), ("promo_code", "string"),
    ("payment_method", "string"), ("payment_status", "string"), ("shipment_fee", "decimal(18,2)"),
    ("total_amount", "decimal(18,2)"), ("has_free_shipping", "int"), ("has_promo", "int"),
]


def _column_profile() -> str:
    parts = [f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, "
             f"count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values FROM tx"
             for c, t in TX_TYPES]
    return _with(_union(parts))


def _describe() -> str:
    parts = []
    for c in ("total_amount", "shipment_fee", "promo_amount"):
        parts.append(
            f"SELECT '{c}' AS column_name, count(v) AS count, round_even(avg(v), 6) AS mean, "
            f"round_even(stddev_samp(v), 6) AS std, round_even(min(v), 6) AS min, "
            f"round_even(quantile_cont(v, 0.25), 6) AS p25, round_even(quantile_cont(v, 0.5), 6) AS p50, "
            f"round_even(quantile_cont(v, 0.75), 6) AS p75, round_even(max(v), 6) AS max "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS v FROM tx)")
    return _with(_union(parts))


def _quantiles() -> str:
    qs = ", ".join(f"CAST({q} AS DOUBLE)" for q in QUANTILES)
    return _with(f"""
SELECT q, round_even(value, 6) AS value FROM (
  SELECT unnest([{qs}]) AS q,
         unnest(quantile_cont(CAST(total_amount AS DOUBLE), [{qs}])) AS value
  FROM tx WHERE total_amount IS NOT NULL)
""")


FENCES = """
fv AS (SELECT product_amount AS v FROM lines WHERE product_amount IS NOT NULL),
fq AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM fv),
fences AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM fq)
"""


def _box() -> str:
    return _with("""
SELECT round_even(q1, 6) AS q1, round_even(median, 6) AS median, round_even(q3, 6) AS q3,
  round_even(iqr, 6) AS iqr, round_even(lower_fence, 6) AS lower_fence, round_even(upper_fence, 6) AS upper_fence,
  round_even((SELECT min(v) FROM fv, fences f WHERE v >= f.lower_fence AND v <= f.upper_fence), 6) AS whisker_low,
  round_even((SELECT max(v) FROM fv, fences f WHERE v >= f.lower_fence AND v <= f.upper_fence), 6) AS whisker_high,
  (SELECT count(*) FROM fv, fences f WHERE NOT (v >= f.lower_fence AND v <= f.upper_fence)) AS fliers
FROM fences
""", FENCES)


DAILY = """
methods AS (SELECT DISTINCT payment_method FROM tx WHERE payment_method IS NOT NULL),
days AS (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM tx WHERE payment_method IS NOT NULL),
daily AS (SELECT d.day, m.payment_method, count(t.booking_id) AS cnt FROM days d CROSS JOIN methods m
  LEFT JOIN tx t ON CAST(t.created_at AS DATE) = d.day AND t.payment_method = m.payment_method GROUP BY ALL)"""


def _rolling() -> str:
    return _with("""
SELECT strftime(day, '%Y-%m-%d') AS day, payment_method, cnt,
  round_even(CASE WHEN count(*) OVER w = 7 THEN avg(cnt) OVER w END, 6) AS rolling_7
FROM daily
WINDOW w AS (PARTITION BY payment_method ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""", DAILY)


def build_oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    for mid, name in METRIC_KEYS.items():
        for grouping in ("segment", "source"):
            sql[f"ttest_{name}_by_{grouping}"] = ttest_sql(mid, grouping)
    g1, g2 = SEGMENT_GROUPS
    counted = sorted(COUNTED_EVENTS)
    markers = sorted(set(MARKER_EVENTS) - set(COUNTED_EVENTS))
    flags = ", ".join([f"CASE WHEN {e}_cnt > 0 THEN 1 ELSE 0 END AS has_{e}" for e in counted]
                      + [f"CASE WHEN {e}_time IS NOT NULL THEN 1 ELSE 0 END AS has_{e}" for e in markers])
    age = f"(year(DATE '{AGE_AS_OF}') - year(birthdate))"
    sql.update({
        "chi2_by_segment": chi2_sql("segment"),
        "chi2_by_source": chi2_sql("source"),
        "contingency_cells": _with("SELECT *, round_even(CAST(row_n AS DOUBLE) * col_n / total, 6) AS expected FROM cells",
                                   _CONTINGENCY),
        "chi2_all_segments": _with("""
SELECT n, round_even(statistic, 6) AS statistic, CAST(dof AS BIGINT) AS dof, round_even(p, 6) AS p_value,
  CASE WHEN p < 0.05 THEN 'Reject independence' ELSE 'No evidence against independence' END AS decision
FROM tail""", _CONTINGENCY + "," + _CHI2_ALL),
        "moments_order_value": _with(f"""
SELECT upper(trim(c.segment)) AS group_name, round_even(avg(CAST(t.total_amount AS DOUBLE)), 6) AS mean,
  round_even(stddev_samp(CAST(t.total_amount AS DOUBLE)), 6) AS stddev, count(*) AS count
FROM tx t JOIN cust c ON t.customer_id = c.customer_id
WHERE upper(trim(c.segment)) IN ('{g1}', '{g2}')
GROUP BY upper(trim(c.segment))"""),
        "order_quantity": _with(
            "SELECT booking_id, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM lines GROUP BY booking_id"),
        "order_unique_products": _with(
            "SELECT booking_id, count(DISTINCT product_id) AS unique_prods FROM lines GROUP BY booking_id"),
        "payment_customer_counts": _with(_payment_customers("segment")),
        "crosstab_counts": _with(f'SELECT payment_method, c1 AS "{g1}", c2 AS "{g2}" FROM ct',
                                 _crosstab_cte("segment")),
        "crosstab_percent": _with(
            f'SELECT payment_method, round_even(CAST(c1 AS DOUBLE) * 100.0 / sum(c1) OVER (), 0) AS "{g1}", '
            f'round_even(CAST(c2 AS DOUBLE) * 100.0 / sum(c2) OVER (), 0) AS "{g2}" FROM ct',
            _crosstab_cte("segment")),
        "age_category": _with(f"""
SELECT customer_id, birthdate, CAST({age} AS DOUBLE) AS age_years,
  {_case(age, AGE_BANDS, AGE_NOT_SET)} AS age_category
FROM cust"""),
        "amount_category": _with(
            f"SELECT booking_id, CAST(total_amount AS DOUBLE) AS total_amount, "
            f"{_case('total_amount', AMOUNT_BANDS, AMOUNT_TOP)} "
            f"AS total_amount_category FROM tx"),
        "dm_transactions": _with("SELECT * REPLACE (CAST(promo_amount AS DOUBLE) AS promo_amount, CAST(shipment_fee AS DOUBLE) AS shipment_fee, CAST(total_amount AS DOUBLE) AS total_amount) FROM mart"),
        "dm_sessions": _with(f"""
SELECT session_id, traffic_source, {flags}, session_events_cnt, session_start_time, session_end_time
FROM sess"""),
        "session_rollup": _with("SELECT * FROM sess"),
        "funnel": _with(f"""
SELECT traffic_source, count(*) AS sessions, count(session_start_time) AS started,
  count(step2_time) AS step2_sessions, count(step3_time) AS step3_sessions,
  count({BOOKING_EVENT}_time) AS booking_sessions
FROM sess GROUP BY traffic_source"""),
        "booking_number": _with("""
SELECT booking_id, customer_id, created_at,
  row_number() OVER (PARTITION BY customer_id ORDER BY created_at, booking_id) AS booking_number
FROM tx"""),
        "days_elapsed": _with("""
SELECT days_to_shipment, count(booking_id) AS cnt FROM tx
WHERE days_to_shipment IS NOT NULL GROUP BY days_to_shipment"""),
        "transactions_clean": _with("SELECT * REPLACE (CAST(promo_amount AS DOUBLE) AS promo_amount, CAST(shipment_fee AS DOUBLE) AS shipment_fee, CAST(total_amount AS DOUBLE) AS total_amount) FROM tx"),
        "customers_clean": _with("SELECT * FROM cust"),
        "products_clean": _with("SELECT * FROM prods"),
        "transaction_lines": _with("""
SELECT t.booking_id, CAST(l.product_id AS DOUBLE) AS product_id, CAST(l.quantity AS DOUBLE) AS quantity,
  round_even(l.item_price, 6) AS item_price,
  round_even(l.quantity * l.item_price, 6) AS product_amount
FROM tx_raw t LEFT JOIN lines l ON t.booking_id = l.booking_id"""),
        "transaction_lines_strict": _with("""
SELECT t.booking_id, l.product_id, l.quantity, round_even(l.item_price, 6) AS item_price,
  round_even(l.quantity * l.item_price, 6) AS product_amount
FROM tx_raw t JOIN lines l ON t.booking_id = l.booking_id"""),
        "transaction_lines_literals": _with("""
SELECT t.booking_id, l.product_id, l.quantity, round_even(l.item_price, 6) AS item_price,
  round_even(l.quantity * l.item_price, 6) AS product_amount
FROM tx_raw t JOIN lines l ON t.booking_id = l.booking_id"""),
        "events_open_attributes": _with("""
SELECT event_id, session_id, event_time, traffic_source, round_even(value, 6) AS value,
  CASE WHEN event_id % 13 <> 0 AND event_id % 4 <> 0 THEN k END AS k,
  CASE WHEN event_id % 13 <> 0 AND event_id % 3 = 0 THEN 'None or L' || (event_id % 7) END AS label,
  CASE WHEN event_id % 13 <> 0 AND event_id % 5 = 0 THEN CAST(event_id % 100 AS DOUBLE) + 0.5 END AS half,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'many' WHEN event_id % 11 = 1 THEN '12' END AS mixed,
  CASE WHEN event_id % 13 <> 0 AND event_id % 2 = 0 THEN 1 END AS seen
FROM cart"""),
        "events_add_to_cart": _with(
            "SELECT event_id, session_id, event_time, traffic_source, round_even(value, 6) AS value, k FROM cart"),
        "line_ids": _with("""
SELECT booking_id, product_id, quantity, round_even(item_price, 6) AS item_price,
  round_even(product_amount, 6) AS product_amount,
  row_number() OVER (ORDER BY booking_id, product_id, quantity, item_price) AS id
FROM lines"""),
        "key_quality": _key_quality(),
        "value_quality": _with("""
SELECT count(*) AS lines, count(*) FILTER (WHERE quantity < 0) AS negative_quantity,
  count(*) FILTER (WHERE item_price < 0) AS negative_price,
  count(*) FILTER (WHERE coalesce(product_amount <> quantity * item_price, true)) AS wrong_amount
FROM lines"""),
        "placeholder_values": _with(_union([
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_cnt, "
            f"count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) IN ('', 'None', '0', '?')) AS placeholder_cnt "
            f"FROM tx" for c in ("payment_method", "payment_status", "promo_code")])),
        "orphan_lines": _with("""
SELECT booking_id, product_id, quantity, round_even(item_price, 6) AS item_price,
  round_even(product_amount, 6) AS product_amount
FROM (SELECT * REPLACE (CASE WHEN booking_id % 97 = 0 THEN product_id + 10000000 ELSE product_id END AS product_id) FROM lines) l
WHERE NOT EXISTS (SELECT 1 FROM prods p WHERE p.prod_id IS NOT DISTINCT FROM l.product_id)"""),
        "duplicate_lines": _with("""
SELECT l.booking_id, l.product_id, l.quantity, round_even(l.item_price, 6) AS item_price,
  round_even(l.product_amount, 6) AS product_amount, d.dup_count
FROM lines l JOIN (SELECT booking_id, product_id, count(*) AS dup_count FROM lines
                   GROUP BY booking_id, product_id HAVING count(*) > 1) d
  ON l.booking_id IS NOT DISTINCT FROM d.booking_id AND l.product_id IS NOT DISTINCT FROM d.product_id"""),
        "reconcile_totals": _with(f"""
SELECT CAST(difference AS DOUBLE) AS difference, count(*) AS bookings FROM (
  SELECT CAST(t.total_amount - t.shipment_fee + t.promo_amount - s.products_total AS DECIMAL(18,2)) AS difference
  FROM tx t LEFT JOIN (SELECT booking_id, CAST(sum({_money('product_amount')}) AS DECIMAL(18,2)) AS products_total
                       FROM lines GROUP BY booking_id) s ON t.booking_id = s.booking_id)
WHERE difference IS NOT NULL GROUP BY difference"""),
        "once_per_session": _with(f"""
SELECT '{BOOKING_EVENT}' AS event_name, count(*) AS total, count(DISTINCT session_id) AS unique_sessions,
  count(*) FILTER (WHERE session_id IS NULL) AS missing_sessions
FROM ev WHERE event_name = '{BOOKING_EVENT}'"""),
        "column_profile": _column_profile(),
        "describe_orders": _describe(),
        "quantiles_order_value": _quantiles(),
        "box_stats": _box(),
        "outliers_iqr": _with("""
SELECT l.booking_id, l.product_id, l.quantity, round_even(l.item_price, 6) AS item_price,
  round_even(l.product_amount, 6) AS product_amount
FROM lines l, fences f WHERE l.product_amount < f.lower_fence OR l.product_amount > f.upper_fence""", FENCES),
        "ship_histogram": _with("""
SELECT CAST(g.i AS INTEGER) AS bin, round_even(b.lo + (b.hi - b.lo) * (g.i - 1) / 50, 6) AS bin_start,
  round_even(b.lo + (b.hi - b.lo) * g.i / 50, 6) AS bin_end, count(v.x) AS cnt
FROM range(1, 51) g(i)
CROSS JOIN (SELECT min(epoch(shipment_date_limit)) AS lo, max(epoch(shipment_date_limit)) AS hi FROM tx) b
LEFT JOIN (SELECT epoch(shipment_date_limit) AS x FROM tx WHERE shipment_date_limit IS NOT NULL) v
  ON g.i = least(floor((v.x - b.lo) * 50 / (b.hi - b.lo)) + 1, 50)
GROUP BY ALL"""),
        "sample_events": _with("""
SELECT event_id, session_id, event_name, event_time, traffic_source, event_metadata, round_even(value, 6) AS value FROM ev
ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 20"""),
        "value_counts_status": _with(
            "SELECT payment_status, count(*) AS cnt FROM tx WHERE payment_status IS NOT NULL GROUP BY payment_status"),
        "value_counts_with_nulls": _with("SELECT promo_code, count(*) AS cnt FROM tx GROUP BY promo_code"),
        "count_by_colour": _with(
            "SELECT baseColour, count(prod_id) AS cnt FROM prods WHERE baseColour IS NOT NULL GROUP BY baseColour"),
        "customers_by_birth_year": _with("""
SELECT coalesce(CAST(year(birthdate) AS VARCHAR), 'Unknown') AS birth_year, count(customer_id) AS count_customers
FROM cust GROUP BY 1"""),
        "event_ratio": _with("""
SELECT event_name, count(event_id) AS event_count, count(DISTINCT session_id) AS session_unique,
  round_even(count(event_id) / count(DISTINCT session_id), 1) AS ratio
FROM ev WHERE event_name IS NOT NULL GROUP BY event_name"""),
        "daily_method_counts": _with("SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM daily", DAILY),
        "daily_method_rolling7": _rolling(),
        "head_orders": _with("""
(SELECT booking_id, created_at, CAST(total_amount AS DOUBLE) AS total_amount, 'head' AS part FROM tx ORDER BY booking_id LIMIT 5)
UNION ALL
(SELECT booking_id, created_at, CAST(total_amount AS DOUBLE) AS total_amount, 'tail' AS part FROM tx ORDER BY booking_id DESC LIMIT 5)"""),
        "sql_source": _with("""
SELECT traffic_source, count(*) AS sessions,
  CAST(sum(CASE WHEN click_cnt > 0 THEN 1 ELSE 0 END) AS BIGINT) AS click_sessions,
  CAST(sum(CASE WHEN purchase_time IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS booked_sessions,
  round_even(avg(session_events_cnt), 6) AS avg_events
FROM sess GROUP BY traffic_source"""),
    })
    return sql
