"""The adapters of ``sources.telemetry`` as SQL common table expressions for the oracle."""

EVT = """spans AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'tenant-b' ELSE 'default' END AS tenant_id, user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, '' AS parent_span_id, event_type AS operation_name,
  'svc-' || (user_id % 8) AS service_name, ts AS start_time, round(value * 1000)::BIGINT AS duration_us,
  CASE WHEN event_type = 'error' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END AS status, props FROM events)"""
ORD = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_shipdate, l_extendedprice, l_returnflag) AS rn FROM lineitem),
spans AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'tenant-b' ELSE 'default' END AS tenant_id, o_orderkey::VARCHAR AS trace_id, 'o' || o_orderkey AS span_id, '' AS parent_span_id, 'order' AS operation_name, o_orderpriority AS service_name,
  o_orderdate AS start_time, round(o_totalprice)::BIGINT AS duration_us, CASE WHEN o_orderstatus = 'P' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END AS status FROM orders
 UNION ALL SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'tenant-b' ELSE 'default' END, l_orderkey::VARCHAR, 'l' || l_orderkey || '-' || rn, 'o' || l_orderkey, 'line', 'sup-' || (l_suppkey % 10), l_shipdate, round(l_extendedprice)::BIGINT,
  CASE WHEN l_returnflag = 'R' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END FROM lines)"""
CONV = """spans AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'tenant-b' ELSE 'default' END AS tenant_id, conv_id::VARCHAR AS trace_id, (conv_id * 1000 + turn)::VARCHAR AS span_id,
  CASE WHEN turn > 0 THEN (conv_id * 1000 + turn - 1)::VARCHAR ELSE '' END AS parent_span_id, 'turn-' || turn AS operation_name, role || '-' || (turn % 4) AS service_name,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS start_time, (length(text) * 1000)::BIGINT AS duration_us,
  CASE WHEN length(text) % 5 = 0 THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END AS status FROM conversations)"""
LOGS = """logs AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'tenant-b' ELSE 'default' END AS tenant_id, (doc_id % 97)::VARCHAR AS trace_id, doc_id AS log_id,
  CASE lang WHEN 'en' THEN 'INFO' WHEN 'de' THEN 'WARN' WHEN 'fr' THEN 'ERROR' ELSE 'DEBUG' END AS severity, text AS body, source AS service_name,
  TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS moment FROM documents)"""
METRICS = """points AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'tenant-b' ELSE 'default' END AS tenant_id, 'svc-' || (user_id % 8) AS service_name, event_type AS name, value, ts AS moment, event_id AS seq FROM events)"""
COUNTERS = METRICS + """,
counters AS (SELECT service_name, name, date_trunc('day', moment) AS start_ts, moment, seq,
  sum(round(value * 100)::BIGINT) OVER (PARTITION BY service_name, name, date_trunc('day', moment) ORDER BY moment, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS value FROM points)"""
ERROR = "status = 'STATUS_CODE_ERROR'"
CALLS = f"""parents AS (SELECT tenant_id, trace_id, span_id, min(service_name) AS caller FROM spans WHERE service_name <> '' GROUP BY ALL),
calls AS (SELECT c.*, p.caller, c.service_name AS callee FROM spans c JOIN parents p ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
  WHERE c.service_name <> '' AND c.parent_span_id NOT IN ('', '0000000000000000') AND p.caller <> c.service_name),
edges AS (SELECT tenant_id, caller, callee, count(*)::BIGINT AS calls, round(avg(duration_us) / 1000 * 100) / 100 AS avg_ms, round(count(*) FILTER ({ERROR}) / count(*) * 10000) / 10000 AS error_rate FROM calls GROUP BY 1, 2, 3)"""
NODES = f"""nodes AS (SELECT tenant_id, service_name, count(*)::BIGINT AS spans, (count(*) FILTER ({ERROR}))::BIGINT AS errors, round(avg(duration_us) / 1000 * 100) / 100 AS avg_ms FROM spans WHERE service_name <> '' GROUP BY 1, 2)"""
BIN = """CASE WHEN v > 0 THEN CASE WHEN pow(2.0, round(log2(v))) = v THEN round(log2(v)) * 16 - 1 ELSE ceil(ln(v) * 16 / ln(2.0)) - 1 END END"""


#: The same of one tenant alone.
ORD1, CONV1, EVT1 = (v.replace("spans AS (", "all_spans AS (") + ", spans AS (SELECT * FROM all_spans WHERE tenant_id = 'default')" for v in (ORD, CONV, EVT))


def window(column: str, seconds: int = 300) -> str:
    return f"to_timestamp(floor(epoch_us({column}) / {seconds}000000.0) * {seconds})::TIMESTAMP"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
