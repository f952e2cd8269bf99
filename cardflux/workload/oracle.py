"""The registered queries in SQL (DuckDB dialect), over the same whole tables.

Shared steps are named common table expressions; ``_sql`` puts the ones a query needs in front of it.
``a_`` steps start from the events, ``b_`` steps from the order lines, ``c_`` is ``b_`` with amounts
divided by 50.
"""

from __future__ import annotations

import re

from cardflux import model
from cardflux.functions.rules import RULE_NAMES


def _list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def _day(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"


def _time(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr}"


def _money(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name or expr}"


def _count(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _half_up(part: str, whole: str, digits: int) -> str:
    """Exact half-up rounding of a ratio of integers."""
    scale = 10**digits
    return f"((2 * {scale} * ({part}) + ({whole})) // (2 * ({whole}))) / {scale}.0"


_UUID = r"regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"

CTES: dict[str, str] = {
    "a_numbered": "SELECT *, user_id // 50 AS c, event_id % 37 AS m FROM events",
    "a_raw": f"""
        SELECT {_UUID.format("CAST(event_id AS VARCHAR)")} AS transaction_id,
               'CUST_' || c AS customer_id, 'MER_' || m AS merchant_id, 'Merchant ' || m AS merchant_name,
               {_list([*model.MERCHANT_CATEGORIES, "pawn_shop"])}[m % 13 + 1] AS merchant_category,
               'Town ' || m % 5 AS city, 'S' || m % 5 AS state,
               value AS amount_usd, 'USD' AS currency,
               {_list(model.ACCOUNT_TYPES)}[c % 3 + 1] AS account_type,
               CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'refund' WHEN 'view' THEN 'chargeback'
                               WHEN 'click' THEN 'atm_withdrawal' ELSE event_type END AS transaction_type,
               {_list(model.CHANNELS)}[event_id % 4 + 1] AS channel,
               {_ISO.format("ts")} AS event_time,
               {_ISO.format("ts + to_seconds(event_id % 300)")} AS kafka_ingest_time,
               CASE WHEN event_id % 97 <> 0 THEN event_id % 5 = 0 END AS is_international,
               lpad(CAST(m AS VARCHAR), 5, '0') AS zip_code
        FROM a_numbered""",
    "b_raw": f"""
        SELECT {_UUID.format("l_orderkey || '-' || l_linenumber")} AS transaction_id,
               'CUST_' || o_custkey AS customer_id, 'MER_' || l_suppkey AS merchant_id, s_name AS merchant_name,
               {_list(model.MERCHANT_CATEGORIES)}[l_suppkey % 12 + 1] AS merchant_category,
               n_name AS city, upper(substr(n_name, 1, 2)) AS state, l_extendedprice AS amount_usd, 'USD' AS currency,
               {_list(model.ACCOUNT_TYPES)}[o_custkey % 3 + 1] AS account_type,
               {_list(model.TRANSACTION_TYPES)}[o_orderkey % 4 + 1] AS transaction_type,
               {_list(model.CHANNELS)}[l_linenumber % 4 + 1] AS channel,
               {_ISO.format("l_shipdate")} AS event_time, {_ISO.format("l_shipdate")} AS kafka_ingest_time,
               s_nationkey <> c_nationkey AS is_international, CAST(NULL AS VARCHAR) AS zip_code
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
}

_VERDICTS = {
    "_chk_txn_id_notnull": "transaction_id IS NOT NULL",
    "_chk_customer_notnull": "customer_id IS NOT NULL",
    "_chk_merchant_notnull": "merchant_id IS NOT NULL",
    "_chk_amount_notnull": "amount_usd IS NOT NULL",
    "_chk_event_time_notnull": "event_time IS NOT NULL",
    "_chk_amount_range": "amount_usd >= 0.01 AND amount_usd <= 50000.0",
    "_chk_account_type": f"account_type IN {_in(model.ACCOUNT_TYPES)}",
    "_chk_txn_type": f"transaction_type IN {_in(model.TRANSACTION_TYPES)}",
    "_chk_channel": f"channel IN {_in(model.CHANNELS)}",
    "_chk_category": f"merchant_category IN {_in(model.MERCHANT_CATEGORIES)}",
    "_chk_event_time_valid": "event_time_ts <= TIMESTAMP '2026-01-01 00:00:00'",
    "_chk_txn_id_format": f"regexp_matches(transaction_id, '{model.TRANSACTION_ID_PATTERN}')",
}
_FLAGS = ", ".join(f"coalesce({verdict}, FALSE) AS {name}" for name, verdict in _VERDICTS.items())
_ALL = " AND ".join(RULE_NAMES)
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {name} THEN '{name}' END" for name in RULE_NAMES) + ") AS _failed_checks"
_SEGMENT = (
    "CASE merchant_category "
    + " ".join(f"WHEN '{category}' THEN '{segment}'" for category, segment in model.SEGMENT_OF_CATEGORY.items())
    + " ELSE 'other' END"
)
_LABEL = """risk_tier || CASE WHEN cross_merchant_flag THEN '_cross_merchant' ELSE '' END
    || CASE WHEN is_international THEN '_intl' ELSE '' END || CASE WHEN high_velocity_flag THEN '_high_velocity' ELSE '' END"""
_ATTRIBUTES = ", ".join(model.MERCHANT_ATTRIBUTES)

CTES["h_raw"] = "SELECT * REPLACE (CASE WHEN zip_code = '00005' THEN 'unknown' ELSE event_time END AS event_time) FROM a_raw"

for _p in ("a", "b", "h"):
    CTES |= {
        f"{_p}_typed": f"""
            SELECT *, try_strptime(event_time, '%Y-%m-%dT%H:%M:%S+00:00') AS event_time_ts,
                   CAST(try_strptime(event_time, '%Y-%m-%dT%H:%M:%S+00:00') AS DATE) AS ingest_date FROM {_p}_raw""",
        f"{_p}_flagged": f"SELECT *, {_FLAGS} FROM {_p}_typed",
        f"{_p}_valid": f"SELECT * EXCLUDE ({', '.join(RULE_NAMES)}) FROM {_p}_flagged WHERE {_ALL}",
        f"{_p}_rolling": f"""
            SELECT *, count(transaction_id) OVER hour AS txn_count_last_1h,
                   count(DISTINCT merchant_id) OVER hour AS distinct_merchants_1h,
                   CAST(sum(CAST(amount_usd AS DECIMAL(18,2))) OVER day AS DOUBLE) AS spend_velocity_24h
            FROM (SELECT *, CAST(floor(epoch(event_time_ts)) AS BIGINT) AS sec FROM {_p}_valid)
            WINDOW hour AS (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
                   day AS (PARTITION BY customer_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""",
        f"{_p}_curated": f"""
            SELECT *, distinct_merchants_1h >= 5 AS cross_merchant_flag,
                   CASE WHEN spend_velocity_24h >= 5000 THEN 'high' WHEN spend_velocity_24h >= 1000 THEN 'medium' ELSE 'low' END AS risk_tier,
                   {_SEGMENT} AS merchant_segment,
                   CAST(hour(event_time_ts) AS INTEGER) AS hour_of_day,
                   CAST(dayofweek(event_time_ts) + 1 AS INTEGER) AS day_of_week,
                   CAST(weekofyear(event_time_ts) AS INTEGER) AS week_of_year
            FROM {_p}_rolling""",
        f"{_p}_stage": f"""
            SELECT * REPLACE (CAST(amount_usd AS DECIMAL(12,2)) AS amount_usd,
                              CAST(spend_velocity_24h AS DECIMAL(18,2)) AS spend_velocity_24h, event_time_ts AS event_time)
            FROM {_p}_curated""",
    }

CTES["c_stage"] = """
    SELECT * REPLACE (CAST(((CAST(amount_usd * 100 AS BIGINT) * 2 + 50) // 100) / 100.0 AS DECIMAL(12,2)) AS amount_usd) FROM b_stage"""

for _p in ("a", "b", "c"):
    CTES |= {
        f"{_p}_merchants": f"""
            SELECT merchant_id, {_ATTRIBUTES} FROM {_p}_stage
            QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY event_time DESC, transaction_id DESC) = 1""",
        f"{_p}_customers": f"""
            SELECT customer_id, account_type, risk_tier FROM {_p}_stage
            QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, transaction_id DESC) = 1""",
        f"{_p}_distinct": f"""
            SELECT * FROM {_p}_stage
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY event_time, amount_usd, merchant_id) = 1""",
        f"{_p}_fact": f"""
            SELECT *, {_LABEL} AS signal_label, CAST(strftime(ingest_date, '%Y%m%d') AS INTEGER) AS date_key,
                   TIMESTAMP '2024-01-31 00:00:00' AS dw_loaded_at
            FROM (SELECT * REPLACE (coalesce(is_international, FALSE) AS is_international), txn_count_last_1h > 10 AS high_velocity_flag
                  FROM {_p}_distinct)""",
    }

CTES |= {
    "b_performance": f"""
        SELECT *, sum(revenue) OVER (by_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling, lag(revenue) OVER by_day AS previous
        FROM (SELECT f.ingest_date AS txn_date, f.merchant_id, {", ".join("m." + name for name in model.MERCHANT_ATTRIBUTES)},
                     count(*) AS txn_count, sum(f.amount_usd) AS revenue, max(f.amount_usd) AS top, min(f.amount_usd) AS bottom
              FROM b_fact f JOIN b_merchants m USING (merchant_id) GROUP BY ALL)
        WINDOW by_day AS (PARTITION BY merchant_id ORDER BY txn_date)""",
    "b_recent": "SELECT * FROM b_performance WHERE txn_date >= DATE '2001-11-05' - 30",
    "a_alerts": f"""
        SELECT f.event_time, f.ingest_date, f.customer_id, c.account_type, c.risk_tier AS customer_risk_tier, f.merchant_id,
               {", ".join("m." + name for name in model.MERCHANT_ATTRIBUTES)}, f.transaction_id, f.amount_usd, f.currency, f.channel,
               f.transaction_type, f.txn_count_last_1h, f.distinct_merchants_1h, f.spend_velocity_24h, f.cross_merchant_flag,
               f.is_international, f.high_velocity_flag, f.risk_tier, f.signal_label, s.alert_severity,
               CAST(CASE s.alert_severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS INTEGER) AS alert_score
        FROM (SELECT *, CASE WHEN risk_tier = 'high' AND (high_velocity_flag OR cross_merchant_flag OR is_international) THEN 'critical'
                             WHEN high_velocity_flag OR cross_merchant_flag THEN 'high'
                             WHEN is_international OR risk_tier = 'high' THEN 'medium' ELSE 'low' END AS alert_severity
              FROM a_fact) s
        JOIN a_fact f USING (transaction_id) JOIN a_customers c ON c.customer_id = f.customer_id JOIN a_merchants m ON m.merchant_id = f.merchant_id
        WHERE f.high_velocity_flag OR f.cross_merchant_flag OR f.is_international OR f.risk_tier = 'high'""",
    "c_profiles": f"""
        SELECT *, CAST(date_diff('day', last_day, DATE '2001-11-05') AS INTEGER) AS recency_days,
               CASE WHEN active_days > 0 THEN {_half_up("txns", "active_days", 2)} END AS frequency,
               CASE WHEN spend >= 50000 THEN 'platinum' WHEN spend >= 10000 THEN 'gold' WHEN spend >= 1000 THEN 'silver' ELSE 'bronze' END AS spend_segment
        FROM (SELECT f.customer_id, c.account_type, c.risk_tier, count(*) AS txns, sum(f.amount_usd) AS spend, max(f.event_time) AS last,
                     min(f.event_time) AS first, CAST(max(f.event_time) AS DATE) AS last_day,
                     CAST(date_diff('day', CAST(min(f.event_time) AS DATE), CAST(max(f.event_time) AS DATE)) AS INTEGER) AS active_days,
                     count(DISTINCT f.merchant_id) AS merchants, count(DISTINCT m.merchant_category) AS categories,
                     count(*) FILTER (f.cross_merchant_flag) AS cross_merchant, count(*) FILTER (f.is_international) AS intl
              FROM c_fact f JOIN c_customers c USING (customer_id) JOIN c_merchants m ON f.merchant_id = m.merchant_id
              GROUP BY f.customer_id, c.account_type, c.risk_tier)""",
    "a_health": f"""
        SELECT (SELECT max(dw_loaded_at) FROM today) AS last_flush,
               (SELECT count(*) FROM today WHERE dw_loaded_at = (SELECT max(dw_loaded_at) FROM today)) AS records_last_batch,
               (SELECT count(*) FROM today) AS total_loaded_today,
               (SELECT {_half_up("sum(CAST(epoch(dw_loaded_at) - floor(epoch(event_time)) AS BIGINT))", "count(*)", 1)} FROM today) AS load_latency_s,
               (SELECT {_half_up(f"100 * count(*) FILTER (NOT ({_ALL}))", "count(*)", 2)} FROM checked) AS quarantine_rate_pct,
               (SELECT sum({" + ".join(f"CAST(NOT {name} AS BIGINT)" for name in RULE_NAMES)}) FROM checked) AS schema_violations_today,
               (SELECT count(*) FROM a_raw WHERE city = 'Town 3' AND kafka_ingest_time LIKE '2024-01-30%') AS dlq_count_today""",
    "a_batches": """SELECT count(*) FILTER (transaction_id IN (SELECT transaction_id FROM a_stage WHERE ingest_date < DATE '2024-01-16')) AS early,
        count(*) AS total FROM a_fact""",
    "today": "SELECT * FROM a_fact WHERE ingest_date = DATE '2024-01-30'",
    "checked": "SELECT * FROM h_flagged WHERE coalesce(ingest_date, CAST(left(kafka_ingest_time, 10) AS DATE)) = DATE '2024-01-30'",
}


def _sql(query: str) -> str:
    """Prefix the steps the query refers to, each after the steps it needs itself."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    steps = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed)
    return f"WITH {steps}\n{query}"


_FLAG_TEXT = "CAST(is_international AS VARCHAR) AS is_international"
_RAW = ", ".join({"is_international": _FLAG_TEXT}.get(name, name) for name in model.RAW_SCHEMA.fieldNames())
_CURATED = ", ".join(
    {"event_time_ts": _time("event_time_ts"), "ingest_date": _day("ingest_date"), "is_international": _FLAG_TEXT}.get(name, name)
    for name in model.CURATED_COLUMNS
)
_STAGE = ", ".join(
    {
        "event_time": _time("event_time"),
        "ingest_date": _day("ingest_date"),
        "is_international": _FLAG_TEXT,
        "amount_usd": _money("amount_usd"),
        "spend_velocity_24h": _money("spend_velocity_24h"),
    }.get(name, name)
    for name in model.STAGE_COLUMNS
)
_VELOCITY = "transaction_id, customer_id, txn_count_last_1h, distinct_merchants_1h, spend_velocity_24h, distinct_merchants_1h >= 5 AS cross_merchant_flag"
_FACT = f"""customer_id, merchant_id, signal_label, date_key, transaction_id, {_money("amount_usd")}, txn_count_last_1h, distinct_merchants_1h,
    {_money("spend_velocity_24h")}, hour_of_day, day_of_week, transaction_type, channel, currency, {_time("event_time")}, {_day("ingest_date")},
    {_time("dw_loaded_at")}"""
_PERFORMANCE = f"""{_day("txn_date")}, strftime(txn_date, '%b') AS month_name, CAST(quarter(txn_date) AS INTEGER) AS quarter,
    CAST(year(txn_date) AS INTEGER) AS year, merchant_id, merchant_name, merchant_category, merchant_segment, state, txn_count,
    {_money("revenue", "total_revenue_usd")}, CAST(revenue AS DOUBLE) / txn_count AS avg_ticket_usd, {_money("top", "max_ticket_usd")},
    {_money("bottom", "min_ticket_usd")}, {_money("rolling", "revenue_rolling_7d")}, {_money("previous", "prev_day_revenue")},
    {_money("revenue - previous", "revenue_dod_delta")}"""
_ALERT = f"""{_time("event_time")}, {_day("ingest_date")}, customer_id, account_type, customer_risk_tier, merchant_id, {_ATTRIBUTES}, transaction_id,
    {_money("amount_usd")}, currency, channel, transaction_type, txn_count_last_1h, distinct_merchants_1h, {_money("spend_velocity_24h")},
    cross_merchant_flag, is_international, high_velocity_flag, risk_tier, signal_label, alert_severity, alert_score"""
_TOP20 = f"""SELECT merchant_name, merchant_category, state, sum(revenue) AS revenue, {_count("sum(txn_count)", "txns")} FROM b_recent
    GROUP BY merchant_name, merchant_category, state ORDER BY sum(revenue) DESC, merchant_name, merchant_category, state LIMIT 20"""
_SPLIT_DAY = "DATE '1998-07-01'"


def _upserted(key: str, attributes: list[str]) -> str:
    """State after a load of the earlier rows and a load of the later ones."""

    def latest(side: str) -> str:
        return f"""SELECT {key}, {", ".join(attributes)} FROM b_stage WHERE ingest_date {side} {_SPLIT_DAY}
            QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY event_time DESC, transaction_id DESC) = 1"""

    values = ", ".join(f"CASE WHEN n.{key} IS NOT NULL THEN n.{name} ELSE o.{name} END AS {name}" for name in attributes)
    return f"""SELECT coalesce(n.{key}, o.{key}) AS {key}, {values},
        CASE WHEN o.{key} IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-31 00:00:00' END AS dw_created_at,
        CASE WHEN n.{key} IS NULL THEN '2024-01-31 00:00:00' ELSE '2024-02-01 00:00:00' END AS dw_updated_at
        FROM ({latest("<")}) o FULL JOIN ({latest(">=")}) n ON o.{key} = n.{key}"""


def _orphans(key: str, condition: str) -> str:
    return f"""SELECT '{key}' AS foreign_key, count(DISTINCT {"date_key" if key == "date_key" else "customer_id"}) AS orphan_keys,
        count(*) AS orphan_rows FROM b_fact WHERE {condition}"""


_QUERIES: dict[str, str] = {
    # sources and sinks
    "scan_raw": f"SELECT {_RAW} FROM a_raw",
    "parse_json_events": f"SELECT {_RAW} FROM a_raw",
    "quarantine_roundtrip": f"SELECT transaction_id, {_day('ingest_date')}, amount_usd, {_FAILED} FROM a_flagged WHERE NOT ({_ALL})",
    "curated_roundtrip": f"SELECT {_CURATED} FROM a_curated",
    "stage_curated": f"SELECT {_STAGE} FROM a_stage",
    "adhoc_sql": f"""SELECT merchant_segment, CAST(year(txn_date) AS INTEGER) AS year, {_money("sum(revenue)", "revenue")},
        {_count("sum(txn_count)", "txns")} FROM b_performance GROUP BY merchant_segment, year(txn_date)""",
    # validation
    "enforce_schema": f"SELECT {_RAW}, {_time('event_time_ts')}, {_day('ingest_date')} FROM a_typed",
    "validation_flags": f"SELECT transaction_id, {', '.join(RULE_NAMES)} FROM a_flagged",
    "valid_rows": f"SELECT {_RAW}, {_time('event_time_ts')}, {_day('ingest_date')} FROM a_valid",
    "quarantine_rows": f"SELECT transaction_id, transaction_type, merchant_category, {_day('ingest_date')}, {_FAILED} FROM a_flagged WHERE NOT ({_ALL})",
    "validation_summary": f"SELECT count(*) AS total, count(*) FILTER ({_ALL}) AS passed, count(*) FILTER (NOT ({_ALL})) AS quarantined FROM a_flagged",
    "lineitem_validation_summary": f"SELECT count(*) AS total, count(*) FILTER ({_ALL}) AS passed, count(*) FILTER (NOT ({_ALL})) AS quarantined FROM b_flagged",
    "rule_failure_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (NOT {name}) AS failures FROM a_flagged" for name in RULE_NAMES
    ),
    # features
    "time_features": f"""SELECT transaction_id, {_time("event_time_ts")}, CAST(hour(event_time_ts) AS INTEGER) AS hour_of_day,
        CAST(dayofweek(event_time_ts) + 1 AS INTEGER) AS day_of_week, CAST(weekofyear(event_time_ts) AS INTEGER) AS week_of_year FROM a_typed""",
    "velocity_features": f"SELECT {_VELOCITY} FROM a_rolling",
    "velocity_with_history": f"SELECT {_VELOCITY} FROM a_rolling WHERE event_time_ts >= TIMESTAMP '2024-01-15 12:00:00'",
    "velocity_late_rows": f"SELECT {_VELOCITY}, risk_tier FROM a_curated",
    "risk_tier": "SELECT risk_tier, count(*) AS txns, max(spend_velocity_24h) AS max_spend FROM a_curated GROUP BY risk_tier",
    "merchant_segment": f"SELECT transaction_id, merchant_category, {_SEGMENT} AS merchant_segment FROM a_raw",
    "merchant_segment_join": f"SELECT transaction_id, merchant_category, {_SEGMENT} AS merchant_segment FROM a_raw",
    "enrich": f"SELECT {_CURATED} FROM a_curated",
    # dimensions and fact
    "dim_date": f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, {_day("d", "full_date")}, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week,
        strftime(d, '%a') AS day_name, CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
        CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month_num, strftime(d, '%b') AS month_name,
        CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, dayofweek(d) IN (0, 6) AS is_weekend, FALSE AS is_holiday
        FROM (SELECT unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS d FROM lineitem)""",
    "dim_fraud_signal": f"""SELECT CAST(row_number() OVER (ORDER BY cross_merchant_flag DESC, is_international DESC,
            list_position(['high', 'medium', 'low'], risk_tier), high_velocity_flag DESC) AS INTEGER) AS fraud_signal_key,
            cross_merchant_flag, is_international, risk_tier, high_velocity_flag, signal_label, txns
        FROM (SELECT s.*, (SELECT count(*) FROM a_fact f WHERE f.signal_label = s.signal_label) AS txns
              FROM (SELECT *, {_LABEL} AS signal_label FROM (VALUES (TRUE), (FALSE)) x(cross_merchant_flag), (VALUES (TRUE), (FALSE)) y(is_international),
                    (VALUES ('high'), ('medium'), ('low')) z(risk_tier), (VALUES (TRUE), (FALSE)) w(high_velocity_flag)) s)""",
    "merchant_candidates": f"SELECT DISTINCT merchant_id, {_ATTRIBUTES} FROM b_stage",
    "latest_merchant_row": f"SELECT merchant_id, {_ATTRIBUTES} FROM b_merchants",
    "dedup_transactions": f"SELECT transaction_id, customer_id, merchant_id, {_time('event_time')}, {_money('amount_usd')} FROM b_distinct",
    "upsert_dim_merchant": _upserted("merchant_id", model.MERCHANT_ATTRIBUTES),
    "upsert_dim_customer": _upserted("customer_id", model.CUSTOMER_ATTRIBUTES),
    "load_star_fact": f"SELECT {_FACT} FROM b_fact",
    "load_star_unresolved": f"""SELECT transaction_id, customer_id, merchant_id, {_day("ingest_date")}, {_money("amount_usd")},
        'date_key' AS missing_keys FROM b_fact WHERE ingest_date > DATE '2000-06-30'""",
    "incremental_fact_load": f"""SELECT transaction_id, date_key, {_money("amount_usd")}, {_time("event_time")}, '2024-02-01 00:00:00' AS dw_loaded_at
        FROM b_fact WHERE transaction_id NOT IN (SELECT transaction_id FROM b_stage WHERE ingest_date < {_SPLIT_DAY})""",
    "warehouse_load_twice": f"SELECT {_FACT} FROM a_fact",
    "warehouse_load_after_crash": f"SELECT {_FACT} FROM a_fact",
    "load_log": """SELECT CAST(1 AS INTEGER) AS seq, '2024-01-31 00:00:00' AS dw_loaded_at, early AS rows, early AS greatest_key, TRUE AS in_fact FROM a_batches
        UNION ALL SELECT 2, '2024-02-01 00:00:00', total - early, total, TRUE FROM a_batches
        UNION ALL SELECT 3, '2024-02-02 00:00:00', 0, total, TRUE FROM a_batches""",
    "stage_skipped_files": """SELECT strftime(ingest_date, '%Y-%m-%d') AS ingest_date,
            CASE ingest_date WHEN DATE '2024-01-05' THEN 'damaged' WHEN DATE '2024-01-09' THEN 'missing' ELSE 'whole' END AS state,
            count(*) AS promised_rows, count(*) FILTER (readable) AS read_rows, count(*) FILTER (NOT readable) AS lost_rows, count(*) FILTER (readable) AS staged_rows
        FROM (SELECT *, ingest_date NOT IN (DATE '2024-01-05', DATE '2024-01-09') AS readable FROM a_curated) GROUP BY ALL
        UNION ALL SELECT '2024-01-12', 'unreadable', 0, 0, 0, (SELECT count(*) FROM a_curated WHERE ingest_date = DATE '2024-01-12')""",
    "warehouse_unresolved": """SELECT count(*) AS stage_rows, count(*) - count(DISTINCT transaction_id) AS duplicate_rows,
        (SELECT count(*) FROM a_fact WHERE ingest_date <= DATE '2024-01-16') AS fact_rows,
        (SELECT count(*) FROM a_fact WHERE ingest_date <= DATE '2024-01-16') AS greatest_key,
        (SELECT count(*) FROM a_fact WHERE ingest_date <= DATE '2024-01-16') AS keys,
        (SELECT count(*) FROM a_fact WHERE ingest_date > DATE '2024-01-16') AS unresolved_rows FROM a_stage""",
    "batch_job": f"""SELECT {_day("ingest_date")}, count(*) AS rows, {_count("sum(txn_count_last_1h)", "txns_in_windows")},
        {_count("sum(distinct_merchants_1h)", "merchants_in_windows")}, (SELECT count(*) FROM a_flagged) AS total,
        (SELECT count(*) FROM a_valid) AS passed, (SELECT count(*) FROM a_flagged WHERE NOT ({_ALL})) AS quarantined,
        (SELECT count(*) FROM a_valid) AS written FROM a_rolling GROUP BY ingest_date""",
    "check_declared_unique": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) - count(DISTINCT {key}) AS repeated FROM {source}"
        for name, key, source in (
            ("dim_customer", "customer_id", "b_customers"),
            ("dim_merchant", "merchant_id", "b_merchants"),
            ("dim_date", "d", "(SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d)"),
            ("dim_fraud_signal", "i", "range(24) AS signals(i)"),
            ("fact", "transaction_id", "b_fact"),
        )
    ),
    "check_fact_not_null": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(*) FILTER ({source} IS NULL) AS nulls FROM b_fact"
        for name, source in zip(model.FACT_REQUIRED, ("transaction_id", "customer_id", "merchant_id", "date_key", "signal_label", "amount_usd", "event_time"))
    ),
    "assign_surrogate_keys": """SELECT count(*) AS customers, CAST(1 AS BIGINT) AS least, count(*) AS greatest, count(*) AS keys
        FROM (SELECT DISTINCT customer_id FROM b_stage)""",
    "kafka_records": f"""SELECT customer_id AS key, transaction_id, merchant_category, event_time, zip_code, amount_usd,
        concat_ws(',', {", ".join(f"CASE WHEN {name} IS NOT NULL THEN '{name}' END" for name in model.RAW_SCHEMA.fieldNames())}) AS field_order
        FROM a_raw""",
    "velocity_approx": f"SELECT {_VELOCITY}, CAST(0 AS BIGINT) AS merchants_error, TRUE AS within_one FROM a_rolling",
    "check_declarations": " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", CAST({repeated} AS VARCHAR) AS repeated_values, CAST(count(*) FILTER ({source} IS NULL) AS VARCHAR) AS nulls,
            CAST({keys} AS VARCHAR) AS orphan_keys, CAST({lost} AS VARCHAR) AS orphan_rows FROM b_fact"""
        for name, source, repeated, keys, lost in (
            ("transaction_id", "transaction_id", "count(*) - count(DISTINCT transaction_id)", "NULL", "NULL"),
            ("customer_key", "customer_id", "NULL", "count(DISTINCT customer_id) FILTER (customer_id NOT IN (SELECT customer_id FROM b_customers))", "0"),
            ("merchant_key", "merchant_id", "NULL", "count(DISTINCT merchant_id) FILTER (merchant_id NOT IN (SELECT merchant_id FROM b_merchants))", "0"),
            ("date_key", "date_key", "NULL", "count(DISTINCT date_key) FILTER (ingest_date > DATE '2000-06-30')", "count(*) FILTER (ingest_date > DATE '2000-06-30')"),
            ("fraud_signal_key", "signal_label", "NULL", "0", "count(*) FILTER (risk_tier NOT IN ('high', 'medium', 'low'))"),
            ("amount_usd", "amount_usd", "NULL", "NULL", "NULL"),
            ("event_time", "event_time", "NULL", "NULL", "NULL"),
        )
    ),
    "check_unique": "SELECT transaction_id, count(*) AS rows FROM b_stage GROUP BY transaction_id HAVING count(*) > 1",
    "check_not_null": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(*) FILTER ({name} IS NULL) AS nulls FROM a_raw"
        for name in ("transaction_id", "customer_id", "merchant_id", "amount_usd", "is_international")
    ),
    "check_foreign_keys": " UNION ALL ".join(
        [
            _orphans("customer_key", "customer_id NOT IN (SELECT customer_id FROM b_customers)"),
            _orphans("merchant_key", "merchant_id NOT IN (SELECT merchant_id FROM b_merchants)"),
            _orphans("date_key", "ingest_date > DATE '2000-06-30'"),
            _orphans("fraud_signal_key", "risk_tier NOT IN ('high', 'medium', 'low')"),
        ]
    ),
    # views and sample questions
    "merchant_daily_performance": f"SELECT {_PERFORMANCE} FROM b_performance",
    "fraud_velocity_alerts": f"SELECT {_ALERT} FROM a_alerts",
    "customer_spend_profile": f"""SELECT customer_id, account_type, risk_tier, txns AS lifetime_txn_count, {_money("spend", "lifetime_spend_usd")},
        CAST(spend AS DOUBLE) / txns AS avg_txn_usd, {_time("last", "last_txn_time")}, {_time("first", "first_txn_time")}, active_days,
        merchants AS distinct_merchants_visited, categories AS distinct_categories_visited, cross_merchant AS cross_merchant_events,
        intl AS intl_txn_count, recency_days, frequency AS txn_frequency_per_day, spend_segment FROM c_profiles""",
    "top_merchants_30d": f"""SELECT m.merchant_name, m.merchant_category, {_money("sum(f.amount_usd)", "total_revenue")}, count(*) AS txn_count
        FROM b_fact f JOIN b_merchants m USING (merchant_id) WHERE f.ingest_date >= DATE '2001-11-05' - 30
        GROUP BY m.merchant_name, m.merchant_category ORDER BY sum(f.amount_usd) DESC, m.merchant_name, m.merchant_category LIMIT 10""",
    "high_velocity_signals": f"""SELECT customer_id, txn_count_last_1h, {_money("spend_velocity_24h")}, cross_merchant_flag, count(*) AS alert_count
        FROM a_fact WHERE txn_count_last_1h > 10 OR cross_merchant_flag OR spend_velocity_24h > 5000
        GROUP BY customer_id, txn_count_last_1h, spend_velocity_24h, cross_merchant_flag""",
    # merchant panel
    "merchant_kpis": f"""SELECT {_money("sum(revenue)", "total_revenue")}, {_count("sum(txn_count)", "total_transactions")},
        round(avg(CAST(revenue AS DOUBLE) / txn_count), 4) AS avg_ticket, count(DISTINCT merchant_name) AS active_merchants FROM b_recent""",
    "revenue_by_category": f"SELECT merchant_category, {_money('sum(revenue)', 'total_revenue_usd')} FROM b_recent GROUP BY merchant_category",
    "revenue_share_by_segment": f"""SELECT merchant_segment, {_money("sum(revenue)", "total_revenue_usd")},
        CAST(sum(revenue) AS DOUBLE) / (SELECT CAST(sum(revenue) AS DOUBLE) FROM b_recent) AS revenue_share FROM b_recent GROUP BY merchant_segment""",
    "daily_revenue_trend": f"SELECT {_day('txn_date')}, {_money('sum(revenue)', 'total_revenue_usd')} FROM b_recent GROUP BY b_recent.txn_date",
    "top20_merchants": f"SELECT * REPLACE ({_money('revenue')}) FROM ({_TOP20})",
    "top20_merchants_formatted": f"""SELECT * REPLACE ('$' || format('{{:,.2f}}', CAST(revenue AS DOUBLE)) AS revenue, format('{{:,}}', txns) AS txns)
        FROM ({_TOP20})""",
    "latest_merchant_days": f"SELECT {_PERFORMANCE} FROM (SELECT * FROM b_performance ORDER BY b_performance.txn_date DESC, merchant_id LIMIT 500)",
    # fraud panel
    "alert_kpis": """SELECT count(*) FILTER (alert_score = 4) AS critical_alerts, count(*) FILTER (alert_score IN (2, 3)) AS medium_alerts,
        count(*) FILTER (is_international) AS international_txns, count(*) FILTER (cross_merchant_flag) AS cross_merchant_events FROM a_alerts""",
    "alert_score_distribution": "SELECT alert_score AS score, count(*) AS count FROM a_alerts GROUP BY alert_score",
    "signal_heatmap": """SELECT merchant_category, count(*) FILTER (risk_tier = 'high') AS high, count(*) FILTER (risk_tier = 'low') AS low,
        count(*) FILTER (risk_tier = 'medium') AS medium FROM a_alerts GROUP BY merchant_category""",
    "velocity_profile": f"""SELECT txn_count_last_1h, {_money("spend_velocity_24h")}, risk_tier, {_money("amount_usd")}, customer_id, merchant_name,
        channel, alert_score FROM a_alerts""",
    "alert_feed": f"""SELECT {_time("event_time")}, transaction_id, customer_id, merchant_name,
        '$' || format('{{:,.2f}}', CAST(amount_usd AS DOUBLE)) AS amount_usd, alert_score, risk_tier, cross_merchant_flag, is_international, channel
        FROM (SELECT * FROM a_alerts ORDER BY alert_score DESC, a_alerts.event_time DESC, transaction_id LIMIT 50)""",
    "latest_alerts": f"SELECT {_ALERT} FROM (SELECT * FROM a_alerts ORDER BY a_alerts.event_time DESC, transaction_id LIMIT 500)",
    # customer panel
    "customer_kpis": """SELECT count(*) AS total_customers, CAST(sum(spend) AS DOUBLE) / count(*) AS avg_lifetime_spend,
        count(*) FILTER (risk_tier = 'high') AS high_risk_customers, count(*) FILTER (spend_segment = 'platinum') AS platinum_customers FROM c_profiles""",
    "spend_segment_distribution": """SELECT spend_segment AS segment, count(*) AS count,
        CAST(list_position(['platinum', 'gold', 'silver', 'bronze'], spend_segment) AS INTEGER) AS segment_rank FROM c_profiles GROUP BY spend_segment""",
    "recency_frequency": f"""SELECT customer_id, recency_days, frequency AS txn_frequency_per_day, spend_segment,
        {_money("spend", "lifetime_spend_usd")} FROM c_profiles""",
    "customer_table": """SELECT customer_id, account_type, risk_tier, spend_segment, txns AS lifetime_txn_count,
        '$' || format('{:,.2f}', CAST(spend AS DOUBLE)) AS lifetime_spend_usd, '$' || format('{:,.2f}', CAST(spend AS DOUBLE) / txns) AS avg_txn_usd,
        recency_days, merchants AS distinct_merchants_visited FROM c_profiles ORDER BY customer_id LIMIT 100""",
    # health panel
    "health_report": f"""SELECT {_time("last_flush")}, records_last_batch, total_loaded_today, load_latency_s, quarantine_rate_pct,
        {_count("schema_violations_today", "schema_violations_today")}, dlq_count_today FROM a_health""",
    "quality_scorecard": """SELECT check_name, value, threshold, CASE WHEN value > threshold THEN 'WARN' ELSE 'OK' END AS status FROM (
        SELECT 'Failed rule checks' AS check_name, CAST(schema_violations_today AS DOUBLE) AS value, CAST(5 AS DOUBLE) AS threshold FROM a_health
        UNION ALL SELECT 'Records that do not parse', CAST(dlq_count_today AS DOUBLE), 5 FROM a_health
        UNION ALL SELECT 'Share of rejected records in percent', quarantine_rate_pct, 1 FROM a_health)""",
    "load_freshness": f"""SELECT {_time("max(dw_loaded_at)", "last_load")}, CAST(7 AS BIGINT) AS age_minutes, 'green' AS status FROM a_fact""",
    # streaming results equal the batch results
    "stream_landing": f"SELECT {_RAW} FROM a_raw",
    "stream_validate": f"SELECT transaction_id, CASE WHEN {_ALL} THEN 'valid' ELSE 'quarantined' END AS side FROM a_flagged",
}


def statements() -> dict[str, str]:
    return {name: _sql(query) for name, query in _QUERIES.items()}
