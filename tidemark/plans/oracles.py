"""The same queries as ANSI SQL over the driver's tables."""

from __future__ import annotations

PRELUDE = r"""
WITH RECURSIVE src AS (
  SELECT event_id AS n, user_id AS u, ts, value,
         CASE WHEN event_type = 'error' THEN 'refund' ELSE event_type END AS type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
base AS (
  SELECT n, u, k,
    'p' || CAST(u % 3 AS VARCHAR) AS project_id,
    lpad(CAST(n AS VARCHAR), 12, '0') AS event_id,
    type AS event_type,
    CAST(1 AS INTEGER) AS schema_version,
    CASE WHEN n % 10 <> 0 THEN 'u' || CAST(u AS VARCHAR) END AS user_id,
    CASE WHEN n % 10 IN (0, 1) THEN 'a' || CAST(u AS VARCHAR) END AS anonymous_id,
    CASE WHEN n % 7 <> 0 THEN 's' || CAST(u AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') END AS session_id,
    ts AS occurred_at,
    ts + to_days(CAST(CASE WHEN n % 50 = 0 THEN 10 ELSE 0 END AS INTEGER)) + to_seconds(n % 97) AS received_at,
    concat('{',
      CASE WHEN type IN ('purchase', 'refund') THEN concat('"amountMinor":',
        CASE WHEN k = 1 THEN '"x"' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END, ',') ELSE '' END,
      CASE WHEN type IN ('purchase', 'refund') AND k <> 0
        THEN concat('"currency":"', ['USD', 'EUR', 'VND'][CAST(k % 3 + 1 AS INTEGER)], '",') ELSE '' END,
      '"k":', k, '}') AS properties
  FROM src),
ev AS (
  SELECT *, concat('{"anonymousId":', coalesce('"' || anonymous_id || '"', 'null'),
    ',"eventId":"', event_id, '","eventType":"', event_type,
    '","occurredAt":"', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ'),
    '","properties":', properties, ',"schemaVersion":1,"sessionId":', coalesce('"' || session_id || '"', 'null'),
    ',"userId":', coalesce('"' || user_id || '"', 'null'), '}') AS payload
  FROM base),
inbox AS (
  SELECT n, project_id, event_id, payload, user_id, received_at,
    CASE WHEN n % 20 <> 0 THEN received_at + to_seconds(n % 13) END AS processed_at FROM ev),
identity AS (
  SELECT project_id, event_id, upper(sha256(payload)) AS payload_hash, occurred_at, received_at,
    CAST(strlen(payload) * 2 + 1024 AS BIGINT) AS stored_bytes FROM ev),
proj AS (
  SELECT id, CASE WHEN id = 'p1' THEN '' ELSE 'Project ' || id END AS name
  FROM (SELECT DISTINCT project_id AS id FROM base UNION ALL SELECT 'p9')),
queue AS (
  SELECT project_id, event_id, received_at AS created_at,
    CASE WHEN n % 33 <> 0 THEN received_at + INTERVAL 2 SECOND END AS completed_at FROM ev WHERE n % 33 <> 1),
mirror AS (
  SELECT project_id, event_id, event_type, occurred_at, schema_version, received_at AS version FROM ev WHERE n % 33 > 1
  UNION ALL
  SELECT project_id, event_id, event_type, occurred_at, 2, received_at + INTERVAL 1 HOUR FROM ev WHERE n % 33 > 1 AND n % 5 = 0),
mirror_new AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, event_id ORDER BY version DESC) AS rn FROM mirror) WHERE rn = 1),
outb AS (
  SELECT n, project_id, event_id, payload, received_at AS created_at,
    CASE WHEN n % 6 IN (1, 2, 3, 5) THEN received_at + INTERVAL 1 SECOND END AS published_at,
    CASE WHEN n % 6 IN (2, 3) THEN received_at + INTERVAL 3 SECOND END AS completed_at,
    received_at + to_minutes(CASE WHEN n % 6 = 4 THEN 5 ELSE 0 END) AS next_attempt_at,
    CASE WHEN n % 6 = 5 THEN received_at + INTERVAL 1 HOUR END AS dead_lettered_at,
    CAST(CASE WHEN n % 6 = 4 THEN n % 7 + 1 WHEN n % 6 = 5 THEN 8 ELSE 0 END AS INTEGER) AS attempts,
    CASE WHEN n % 6 IN (4, 5) THEN 'TimeoutException: broker did not confirm' END AS last_error
  FROM ev),
members AS (
  SELECT c_custkey AS user_id, 'p' || CAST(c_custkey % 3 AS VARCHAR) AS project_id,
    c_custkey % 2 = 0 AS can_demo, c_custkey % 5 = 0 AS can_manage FROM customer),
registered AS (
  SELECT DISTINCT project_id, event_type FROM ev WHERE NOT (project_id = 'p1' AND event_type = 'click')),
deliv0 AS (
  SELECT project_id, n // 10 AS batch, CAST(n % 10 AS INTEGER) AS ordinal, event_id, payload FROM ev
  UNION ALL
  SELECT project_id, n // 10, CAST(n % 10 + 10 AS INTEGER), event_id, payload FROM ev WHERE n % 35 = 0
  UNION ALL
  SELECT project_id, n // 10 + 1000000000, CAST(n % 10 AS INTEGER), event_id,
    CASE WHEN n % 100 = 0 THEN replace(payload, '"eventType":"' || event_type || '"', '"eventType":"' || event_type || '_changed"') ELSE payload END
  FROM ev WHERE n % 5 = 0
  UNION ALL
  SELECT project_id, n // 10 + 1000000000, CAST(n % 10 AS INTEGER), 'r' || event_id,
    replace(payload, '"eventId":"' || event_id || '"', '"eventId":"r' || event_id || '"') FROM ev WHERE n % 10 = 3),
deliv AS (
  SELECT project_id, lpad(CAST(batch AS VARCHAR), 12, '0') AS batch_id,
    TIMESTAMP '2024-02-01' + to_seconds(batch % 1000000000) + to_days(CASE WHEN batch >= 1000000000 THEN 400 ELSE 0 END) AS batch_at,
    ordinal, event_id, upper(sha256(payload)) AS payload_hash, CAST(strlen(payload) * 2 + 1024 AS BIGINT) AS stored_bytes
  FROM deliv0),
attempts AS (
  SELECT event_id AS attempt_id, 'user-' || CAST(u % 7 AS VARCHAR) AS name,
    'account-' || substr(sha256('user-' || CAST(u % 7 AS VARCHAR)), 1, 3) AS bucket,
    epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(occurred_at) - epoch_us(TIMESTAMP '2024-01-01')) // 500 AS t
  FROM ev)
"""

START, END, NOW = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-02-01'"
SUMMARY = "SELECT project_id, event_type, count(*) AS events FROM ev WHERE {} GROUP BY ALL"
HOUR = "date_trunc('hour', occurred_at)"
DAY = "CAST(date_trunc('day', occurred_at) AS TIMESTAMP)"


def _funnel(steps: list[str], hours: int) -> str:
    """One CTE per step, each the earliest match joined on the previous step."""
    parts = [
        f", f AS (SELECT project_id, user_id, event_type, occurred_at AS tm FROM ev WHERE user_id IS NOT NULL "
        f"AND occurred_at >= {START} AND occurred_at < {END}), "
        f"s1 AS (SELECT project_id, user_id, min(tm) AS tm FROM f WHERE event_type = '{steps[0]}' GROUP BY ALL)"
    ]
    for i, step in enumerate(steps[1:], start=2):
        parts.append(
            f", s{i} AS (SELECT f.project_id, f.user_id, min(f.tm) AS tm FROM f JOIN s{i - 1} p USING (project_id, user_id) "
            f"WHERE f.event_type = '{step}' AND f.tm >= p.tm AND f.tm <= p.tm + INTERVAL {hours} HOUR GROUP BY ALL)"
        )
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS step, '{s}' AS event_type, project_id FROM s{i}" for i, s in enumerate(steps, start=1)
    )
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(steps, start=1))
    return (
        "".join(parts)
        + f", hits AS ({rows}) SELECT p.project_id, CAST(l.step AS INTEGER) AS step, l.event_type, count(h.step) AS users "
        + f"FROM (SELECT DISTINCT project_id FROM f WHERE event_type IN ({', '.join(repr(s) for s in steps)})) p "
        + f"CROSS JOIN (VALUES {names}) l(step, event_type) "
        + "LEFT JOIN hits h ON h.project_id = p.project_id AND h.step = l.step GROUP BY ALL"
    )


def _chain(name: str, key: str, source: str, limit: int) -> str:
    """Fixed windows as a recursion over attempts in order: opening time and running count."""
    return f""",
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, attempt_id) AS i FROM {source}),
{name}_f AS (
  SELECT {key} AS key, i, attempt_id, t AS w, 1 AS used FROM {name}_o WHERE i = 1
  UNION ALL
  SELECT f.key, o.i, o.attempt_id,
    CASE WHEN f.w > o.t - 60000000 THEN f.w ELSE o.t END,
    CASE WHEN f.w > o.t - 60000000 THEN least(f.used + 1, {limit} + 1) ELSE 1 END
  FROM {name}_f f JOIN {name}_o o ON o.{key} = f.key AND o.i = f.i + 1),
{name} AS (SELECT * FROM {name}_o WHERE attempt_id IN (SELECT attempt_id FROM {name}_f WHERE used <= {limit}))"""


QUOTA = """,
ord AS (
  SELECT project_id, batch_id, batch_at, row_number() OVER (PARTITION BY project_id ORDER BY batch_at, batch_id) AS i, ids, pairs, inner_clash
  FROM (SELECT project_id, batch_id, batch_at, list(DISTINCT event_id) AS ids, list(DISTINCT event_id || payload_hash) AS pairs,
          count(DISTINCT event_id || payload_hash) > count(DISTINCT event_id) AS inner_clash
        FROM deliv GROUP BY ALL)),
fold AS (
  SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS pairs,
    true AS accepted, CAST(NULL AS VARCHAR) AS reason, '' AS batch_id FROM ord
  UNION ALL
  SELECT project_id, i,
    CASE WHEN clash OR full_up THEN ids ELSE list_concat(ids, fresh) END,
    CASE WHEN clash OR full_up THEN pairs ELSE list_concat(pairs, list_filter(new_pairs, lambda x: list_contains(fresh, substr(x, 1, length(x) - 64)))) END,
    NOT (clash OR full_up), CASE WHEN clash THEN 'conflict' WHEN full_up THEN 'quota' END, batch_id
  FROM (
    SELECT *, len(fresh) > 0 AND len(ids) + len(fresh) > {limit} AS full_up,
      inner_clash OR len(list_filter(new_pairs, lambda x: list_contains(ids, substr(x, 1, length(x) - 64)) AND NOT list_contains(pairs, x))) > 0 AS clash
    FROM (SELECT f.project_id, o.i, f.ids, f.pairs, o.batch_id, o.inner_clash, o.pairs AS new_pairs,
            list_filter(o.ids, lambda x: NOT list_contains(f.ids, x)) AS fresh
          FROM fold f JOIN ord o ON o.project_id = f.project_id AND o.i = f.i + 1)))
"""

WIRE = """,
w AS (SELECT *, n % 20 AS fault, '00000000-0000-4000-8000-' || event_id AS guid,
   (received_at - INTERVAL 7 DAY) > occurred_at AS late FROM ev),
wv AS (SELECT *,
   CASE WHEN n % 400 = 14 THEN 'size' WHEN fault IN (2, 7, 10, 13) THEN 'malformed'
        WHEN late OR fault IN (1, 3, 5, 6, 11, 12) THEN 'validation' END AS reject_reason FROM w)"""

BODIES: dict[str, str] = {
    "event_summary": SUMMARY.format("true"),
    "event_summary_filtered": SUMMARY.format(
        "occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-20' AND event_type = 'purchase'"
    ),
    "user_summary": SUMMARY.format("user_id = 'u7'"),
    "property_filter_summary": SUMMARY.format("k = 5"),
    "property_filter_text": SUMMARY.format("event_type IN ('purchase', 'refund') AND k % 3 = 1"),
    "timeseries_hour": f"SELECT project_id, {HOUR} AS bucket, event_type, count(*) AS events FROM ev GROUP BY ALL",
    "timeseries_day": f"SELECT project_id, {DAY} AS bucket, event_type, count(*) AS events FROM ev GROUP BY ALL",
    "timeseries_dense_day": f"""SELECT p.project_id, a.bucket, count(e.event_id) AS events
        FROM (SELECT DISTINCT project_id FROM ev) p
        CROSS JOIN (SELECT unnest(generate_series({START}, TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS bucket) a
        LEFT JOIN ev e ON e.project_id = p.project_id AND {DAY.replace('occurred_at', 'e.occurred_at')} = a.bucket GROUP BY ALL""",
    "timeseries_dense_hour": f"""SELECT p.project_id, a.bucket, count(e.event_id) AS events
        FROM (SELECT DISTINCT project_id FROM ev WHERE event_type = 'refund') p
        CROSS JOIN (SELECT unnest(generate_series({START}, TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS bucket) a
        LEFT JOIN ev e ON e.project_id = p.project_id AND e.event_type = 'refund'
          AND {HOUR.replace('occurred_at', 'e.occurred_at')} = a.bucket GROUP BY ALL""",
    "active_users": """SELECT project_id, count(DISTINCT user_id) AS identified_users,
        count(DISTINCT anonymous_id) FILTER (WHERE user_id IS NULL) AS anonymous_users FROM ev GROUP BY ALL""",
    "event_share": """SELECT project_id, event_type, events,
        CAST(floor(events * 100 / CAST(sum(events) OVER (PARTITION BY project_id) AS DOUBLE) + 0.5) AS BIGINT) AS percent
        FROM (SELECT project_id, event_type, count(*) AS events FROM ev GROUP BY ALL)""",
    "funnel_conversion": _funnel(["view", "purchase", "refund"], 6),
    "funnel_repeat_step": _funnel(["view", "view", "click", "view"], 48),
    "retention_cohorts": """, c AS (SELECT DISTINCT project_id, user_id, CAST(occurred_at AS DATE) AS d FROM ev
          WHERE user_id IS NOT NULL AND event_type = 'signup'),
        sizes AS (SELECT project_id, d, count(*) AS n FROM c GROUP BY ALL),
        rets AS (SELECT c.project_id, c.d, date_diff('day', c.d, CAST(e.occurred_at AS DATE)) AS day, count(DISTINCT c.user_id) AS n
          FROM c JOIN ev e ON e.project_id = c.project_id AND e.user_id = c.user_id AND e.event_type = 'purchase'
            AND CAST(e.occurred_at AS DATE) >= c.d GROUP BY ALL)
        SELECT s.project_id, s.d AS cohort_date, CAST(r.day AS INTEGER) AS day, s.n AS cohort_users, r.n AS returned_users,
          s.d + CAST(r.day + 1 AS INTEGER) <= DATE '2024-02-01' AS complete
        FROM sizes s JOIN rets r ON r.project_id = s.project_id AND r.d = s.d""",
    "sessions": """SELECT project_id, session_id, min(user_id) AS user_id, min(occurred_at) AS started_at,
        max(occurred_at) AS ended_at, count(*) AS events FROM ev WHERE session_id IS NOT NULL GROUP BY ALL""",
    "revenue_by_currency": """, m AS (SELECT project_id, event_type, json_extract_string(properties, '$.currency') AS currency,
          json_extract_string(properties, '$.amountMinor') AS a FROM ev WHERE event_type IN ('purchase', 'refund')),
        ok AS (SELECT project_id, event_type, currency, CAST(a AS BIGINT) AS a FROM m
          WHERE currency IS NOT NULL AND regexp_full_match(a, '-?[0-9]+'))
        SELECT project_id, currency,
          CAST(coalesce(sum(a) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS gross_minor,
          CAST(coalesce(sum(a) FILTER (WHERE event_type = 'refund'), 0) AS BIGINT) AS refund_minor,
          CAST(coalesce(sum(a) FILTER (WHERE event_type = 'purchase'), 0) - coalesce(sum(a) FILTER (WHERE event_type = 'refund'), 0) AS BIGINT) AS net_minor,
          count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
          count(*) FILTER (WHERE event_type = 'refund') AS refunds FROM ok GROUP BY ALL""",
    "timeline_first_page": """SELECT project_id, event_id, event_type, occurred_at, received_at, user_id, anonymous_id, session_id,
        properties, schema_version FROM ev WHERE project_id = 'p1' ORDER BY occurred_at, event_id LIMIT 50""",
    "timeline_next_page": """SELECT project_id, event_id, event_type, occurred_at, received_at, user_id, anonymous_id, session_id,
        properties, schema_version FROM ev WHERE project_id = 'p1' AND (occurred_at, event_id) > (TIMESTAMP '2024-01-15', '000000000000')
        ORDER BY occurred_at, event_id LIMIT 100""",
    "subject_export": """SELECT event_id, event_type, occurred_at, received_at, user_id, anonymous_id, session_id, properties,
        schema_version FROM ev WHERE project_id = 'p1' AND user_id = 'u7'""",
    "canonical_fingerprint": "SELECT project_id, event_id, payload_hash, stored_bytes FROM identity",
    "validate_errors": WIRE
    + """ SELECT n AS source_event, reject_reason,
        concat_ws(',', CASE WHEN fault IN (10, 13, 7) THEN NULL WHEN fault = 1 THEN 'eventType' END,
          CASE WHEN fault = 11 THEN 'schemaVersion' END, CASE WHEN late THEN 'occurredAt' END,
          CASE WHEN fault = 12 THEN 'userId' END, CASE WHEN fault IN (3, 5, 6) THEN 'properties' END) AS fields
        FROM wv WHERE reject_reason = 'validation'
        UNION ALL
        SELECT n, reject_reason, CASE WHEN late THEN 'occurredAt' ELSE '' END FROM wv WHERE reject_reason = 'size'
        UNION ALL
        SELECT n, reject_reason, CASE fault
          WHEN 2 THEN CASE WHEN late THEN 'occurredAt' ELSE '' END
          WHEN 10 THEN CASE WHEN late THEN 'occurredAt' ELSE '' END
          ELSE 'eventId,eventType,schemaVersion,occurredAt' END FROM wv WHERE reject_reason = 'malformed'""",
    "wire_canonical": WIRE
    + """ SELECT n AS source_event, guid AS event_id, event_type, occurred_at, user_id,
        CASE fault WHEN 4 THEN '{"a":{"b":{"c":{"d":1}}}}' WHEN 8 THEN '{}' WHEN 9 THEN '{"a":[1,0,"1.0"],"b":150}'
          ELSE properties END AS properties FROM wv WHERE reject_reason IS NULL""",
    "browser_policy": WIRE
    + """ SELECT 'properties.source' AS field, count(*) AS failures FROM wv WHERE fault NOT IN (2, 7, 10, 13)
        UNION ALL
        SELECT 'eventType', count(*) + count(*) FILTER (WHERE fault = 1) FROM wv WHERE fault NOT IN (2, 7, 10, 13)""",
    "late_rejects": """SELECT project_id, event_id, occurred_at, received_at FROM ev
        WHERE occurred_at < received_at - INTERVAL 7 DAY OR occurred_at > received_at + INTERVAL 5 MINUTE""",
    "dedup_first_arrival": """, o AS (SELECT *, first_value(batch_at) OVER w AS first_at, first_value(payload_hash) OVER w AS first_hash,
          row_number() OVER w AS rn FROM deliv WINDOW w AS (PARTITION BY project_id, event_id ORDER BY batch_at, batch_id, ordinal))
        SELECT project_id, batch_id, ordinal, event_id, first_at AS received_at,
          CASE WHEN rn = 1 THEN 'first' WHEN payload_hash = first_hash THEN 'repeat' ELSE 'conflict' END AS arrival FROM o""",
    "batch_conflicts": """SELECT project_id, substr(batch_id, 4, 9) AS batch_id, event_id, count(*) AS copies FROM deliv
        GROUP BY ALL HAVING count(DISTINCT payload_hash) > 1""",
    "identity_lookup": """SELECT d.project_id, CASE WHEN i.payload_hash IS NULL THEN 'new' WHEN i.payload_hash = d.payload_hash THEN 'repeat'
          ELSE 'conflict' END AS state, count(*) AS deliveries
        FROM deliv d LEFT JOIN identity i ON i.project_id = d.project_id AND i.event_id = d.event_id GROUP BY ALL""",
    "batch_receipts": """, first_seen AS (
          SELECT *, row_number() OVER (PARTITION BY project_id, event_id ORDER BY batch_at, batch_id, ordinal) AS rn,
            first_value(payload_hash) OVER (PARTITION BY project_id, event_id ORDER BY batch_at, batch_id, ordinal) AS first_hash,
            first_value(batch_at) OVER (PARTITION BY project_id, event_id ORDER BY batch_at, batch_id, ordinal) AS first_at
          FROM deliv),
        bad AS (SELECT DISTINCT project_id, batch_id FROM first_seen WHERE payload_hash <> first_hash)
        SELECT f.project_id, f.batch_id, f.ordinal, f.event_id, 'accepted' AS status, f.first_at AS received_at,
          'durable' AS durability, f.rn > 1 AS already_accepted
        FROM first_seen f LEFT JOIN bad b ON b.project_id = f.project_id AND b.batch_id = f.batch_id WHERE b.batch_id IS NULL""",
    "quota_admission": QUOTA.format(limit=2500) + "SELECT project_id, batch_id, accepted, reason FROM fold WHERE i > 0",
    "deployment_quota": """, alld AS (SELECT 'all' AS project_id, batch_id || '/' || project_id AS batch_id, batch_at,
          project_id || '/' || event_id AS event_id, payload_hash FROM deliv)"""
    + QUOTA.format(limit=5000).replace("FROM deliv", "FROM alld")
    + "SELECT split_part(batch_id, '/', 2) AS project_id, split_part(batch_id, '/', 1) AS batch_id, accepted, reason FROM fold WHERE i > 0",
    "admission_counters": QUOTA.format(limit=2500)
    + """SELECT d.project_id, coalesce(f.reason, 'accepted') AS outcome, count(*) AS events
        FROM deliv d JOIN fold f ON f.project_id = d.project_id AND f.batch_id = d.batch_id WHERE f.i > 0 GROUP BY ALL""",
    "batch_envelopes": """, b AS (SELECT n // 10 AS batch, list(event_id ORDER BY event_id) AS ids FROM ev GROUP BY ALL),
        f AS (SELECT *, CASE batch % 20 WHEN 1 THEN 'events' WHEN 2 THEN 'malformed' WHEN 3 THEN CASE WHEN len(ids) > 9 THEN 'events' END
          WHEN 4 THEN 'batch too large' END AS batch_error FROM b)
        SELECT batch, batch_error, CAST(0 AS INTEGER) AS ordinal, CAST(NULL AS VARCHAR) AS event FROM f WHERE batch_error IS NOT NULL
        UNION ALL SELECT batch, batch_error, CAST(unnest(range(len(ids))) AS INTEGER), '{"eventId":"' || unnest(ids) || '"}' FROM f WHERE batch_error IS NULL""",
    "saved_view_upsert": f"""SELECT CAST(c_custkey AS VARCHAR) AS id, 'p' || CAST(c_custkey % 3 AS VARCHAR) AS project_id,
          CAST(c_custkey % 40 AS VARCHAR) AS user_id, CASE WHEN c_custkey = 3 THEN 'North' ELSE c_name END AS name,
          CASE WHEN c_custkey = 3 THEN '{{"eventType":"view"}}' ELSE '{{"eventType":"' || ['view', 'click', 'purchase'][CAST(c_custkey % 3 + 1 AS INTEGER)] || '"}}' END AS definition,
          TIMESTAMP '2024-01-01' AS created_at, CASE WHEN c_custkey = 3 THEN {NOW} ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM customer""",
    "saved_view_list": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '{"eventType":"click"}' AS definition
        FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 40 = 1""",
    "schema_list": "SELECT event_type, 1 AS version, '{}' AS definition FROM registered WHERE project_id = 'p1'",
    "audit_append": f"""SELECT o_orderkey AS id, {NOW} AS occurred_at, 'operator' AS actor, 'p' || CAST(o_custkey % 3 AS VARCHAR) AS project_id,
        'order.change' AS action, substr(repeat(CAST(o_custkey AS VARCHAR), 80), 1, 200) AS target, '{{}}' AS details FROM orders""",
    "delivery_cycle": f"""SELECT o.project_id, o.event_id, e.event_type, e.occurred_at, {NOW} AS published_at, {NOW} AS completed_at,
          coalesce(i.processed_at, {NOW}) AS processed_at, i.processed_at IS NULL AS mirrored
        FROM outb o JOIN ev e ON e.project_id = o.project_id AND e.event_id = o.event_id
          JOIN inbox i ON i.project_id = o.project_id AND i.event_id = o.event_id
        WHERE o.published_at IS NULL AND o.completed_at IS NULL AND o.dead_lettered_at IS NULL AND o.next_attempt_at <= {NOW}""",
    "outbox_claim": f"""SELECT project_id, event_id, {NOW} AS published_at, CAST(NULL AS VARCHAR) AS last_error FROM outb
        WHERE published_at IS NULL AND completed_at IS NULL AND dead_lettered_at IS NULL AND next_attempt_at <= {NOW}
        ORDER BY created_at, project_id, event_id LIMIT 100""",
    "order_pricing": """, o AS (SELECT l_orderkey AS order_id, l_linenumber AS line,
          ['mug', 'tote', 'notebook', 'poster'][CAST(l_partkey % 4 + 1 AS INTEGER)] AS product_id,
          CAST(trunc(l_quantity) AS INTEGER) AS quantity FROM lineitem),
        p AS (SELECT o.*, CASE product_id WHEN 'mug' THEN 2400 WHEN 'tote' THEN 3200 WHEN 'notebook' THEN 1800 END AS price FROM o)
        SELECT product_id, order_id, line, quantity, coalesce(price IS NOT NULL AND quantity BETWEEN 1 AND 10, false) AS valid,
          CASE WHEN price IS NOT NULL AND quantity BETWEEN 1 AND 10 THEN CAST(price * quantity AS BIGINT) END AS amount_minor,
          CASE WHEN price IS NOT NULL AND quantity BETWEEN 1 AND 10 THEN 'USD' END AS currency FROM p""",
    "processing_status": f""", q AS (SELECT i.project_id, count(*) FILTER (WHERE processed_at IS NULL) AS pending,
          (epoch_us({NOW}) - epoch_us(min(i.received_at) FILTER (WHERE processed_at IS NULL))) / 1e6 AS age,
          quantile_cont((epoch_us(processed_at) - epoch_us(i.received_at)) / 1e6, 0.95)
            FILTER (WHERE processed_at >= {NOW} - INTERVAL 5 MINUTE) AS p95,
          (SELECT max(received_at) FROM identity d WHERE d.project_id = i.project_id) AS last_received_at
        FROM inbox i GROUP BY i.project_id)
        SELECT project_id, pending, CASE WHEN age IS NOT NULL THEN greatest(0.0, age) END AS oldest_pending_seconds,
          CASE WHEN p95 IS NOT NULL THEN round(greatest(0.0, p95), 6) END AS processing_p95_seconds, last_received_at FROM q""",
    "outbox_status": f"""SELECT project_id,
          count(*) FILTER (WHERE completed_at IS NULL AND dead_lettered_at IS NULL) AS pending,
          (epoch_us({NOW}) - epoch_us(min(created_at) FILTER (WHERE completed_at IS NULL AND dead_lettered_at IS NULL))) / 1e6 AS oldest_pending_seconds,
          count(*) FILTER (WHERE completed_at IS NOT NULL) AS completed,
          count(*) FILTER (WHERE dead_lettered_at IS NOT NULL) AS dead_lettered,
          count(*) FILTER (WHERE completed_at IS NULL AND dead_lettered_at IS NULL AND attempts > 0) AS retrying
        FROM outb GROUP BY ALL""",
    "outbox_depth": "SELECT count(*) FILTER (WHERE completed_at IS NULL AND dead_lettered_at IS NULL) AS pending FROM outb",
    "storage_report": """SELECT i.project_id, count(*) FILTER (WHERE processed_at IS NULL) AS pending_events,
          CAST(sum(d.stored_bytes) AS BIGINT) AS logical_bytes
        FROM inbox i JOIN identity d ON d.project_id = i.project_id AND d.event_id = i.event_id GROUP BY ALL""",
    "latency_percentiles": """, l AS (SELECT project_id, epoch_us(processed_at) - epoch_us(received_at) AS v FROM inbox WHERE processed_at IS NOT NULL),
        r AS (SELECT project_id, v, row_number() OVER (PARTITION BY project_id ORDER BY v) AS i, count(*) OVER (PARTITION BY project_id) AS n FROM l)
        SELECT project_id, max(v) FILTER (WHERE i = CAST(ceil(n * CAST(0.5 AS DECIMAL(6, 5))) AS BIGINT)) / 1000.0 AS p50_ms,
          max(v) FILTER (WHERE i = CAST(ceil(n * CAST(0.95 AS DECIMAL(6, 5))) AS BIGINT)) / 1000.0 AS p95_ms,
          max(v) FILTER (WHERE i = CAST(ceil(n * CAST(0.99 AS DECIMAL(6, 5))) AS BIGINT)) / 1000.0 AS p99_ms
        FROM r GROUP BY ALL""",
    "throughput_summary": """SELECT project_id, count(*) AS total, count(processed_at) AS succeeded, count(*) - count(processed_at) AS open,
          (epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6 AS elapsed_seconds,
          round(count(*) / ((epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6), 6) AS per_second
        FROM inbox GROUP BY ALL""",
    "counters_overflow": """, c AS (SELECT user_id, count(*) AS total, min(received_at) AS seen FROM ev WHERE user_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (ORDER BY seen, user_id) AS rn FROM c)
        SELECT CASE WHEN rn <= 40 THEN user_id ELSE '_other' END AS user_id, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY ALL""",
    "projected_by_project": """SELECT project_id, count(*) AS projected, min(received_at) AS oldest_receipt FROM inbox
        WHERE processed_at IS NOT NULL GROUP BY ALL""",
    "inbox_claim": """SELECT project_id, event_id, received_at FROM inbox WHERE processed_at IS NULL
        ORDER BY received_at, project_id, event_id LIMIT 100""",
    "overview": f"""SELECT 'summary' AS part, project_id, event_type AS label, CAST(NULL AS TIMESTAMP) AS bucket, count(*) AS amount FROM ev GROUP BY ALL
        UNION ALL SELECT 'series', project_id, event_type, {DAY}, count(*) FROM ev GROUP BY ALL
        UNION ALL SELECT 'identified', project_id, NULL, NULL, count(DISTINCT user_id) FROM ev GROUP BY ALL
        UNION ALL SELECT 'anonymous', project_id, NULL, NULL, count(DISTINCT anonymous_id) FILTER (WHERE user_id IS NULL) FROM ev GROUP BY ALL
        UNION ALL SELECT 'pending', project_id, NULL, max(received_at), count(*) - count(processed_at) FROM inbox GROUP BY ALL""",
    "dataset_fingerprint": """SELECT 'events' AS measure, count(*) AS amount FROM ev UNION ALL SELECT 'identities', count(*) FROM identity
        UNION ALL SELECT 'bytes', CAST(sum(stored_bytes) AS BIGINT) FROM identity UNION ALL SELECT 'inbox', count(*) FROM inbox""",
    "retention_survivors": f""", x AS (SELECT e.project_id, e.event_id, i.processed_at IS NULL AS open,
            e.occurred_at < {NOW} - INTERVAL 15 DAY AS old, e.occurred_at < {NOW} - INTERVAL 20 DAY AS ancient
          FROM ev e JOIN inbox i USING (project_id, event_id)),
        gone AS (SELECT project_id, event_id FROM x WHERE ancient AND NOT open)
        SELECT 'events' AS table_name, project_id, event_id FROM x WHERE open OR NOT old
        UNION ALL SELECT 'inbox', project_id, event_id FROM x WHERE open OR NOT old
        UNION ALL SELECT 'identity', project_id, event_id FROM x WHERE open OR NOT ancient
        UNION ALL SELECT 'mirror_queue', project_id, event_id FROM queue ANTI JOIN gone USING (project_id, event_id)
        UNION ALL SELECT 'outbox', project_id, event_id FROM outb ANTI JOIN gone USING (project_id, event_id)""",
    "retention_removed": f"""SELECT e.project_id, e.event_id, e.occurred_at FROM ev e JOIN inbox i USING (project_id, event_id)
        WHERE e.occurred_at < {NOW} - INTERVAL 20 DAY AND i.processed_at IS NOT NULL""",
    "retention_usage": f"""SELECT p.id, p.name, count(d.event_id) AS event_count, CAST(coalesce(sum(d.stored_bytes), 0) AS BIGINT) AS stored_bytes
        FROM proj p LEFT JOIN (SELECT d.* FROM identity d JOIN inbox i USING (project_id, event_id)
          WHERE i.processed_at IS NULL OR d.occurred_at >= {NOW} - INTERVAL 20 DAY) d ON d.project_id = p.id GROUP BY ALL""",
    "project_usage": """SELECT p.id, p.name, count(d.event_id) AS event_count, CAST(coalesce(sum(d.stored_bytes), 0) AS BIGINT) AS stored_bytes
        FROM proj p LEFT JOIN identity d ON d.project_id = p.id GROUP BY ALL""",
    "subject_erasure": """, gone AS (SELECT project_id, event_id FROM ev WHERE project_id = 'p1' AND user_id = 'u7')
        SELECT 'events' AS table_name, project_id, count(*) AS amount FROM ev ANTI JOIN gone USING (project_id, event_id) GROUP BY ALL
        UNION ALL SELECT 'inbox', project_id, count(*) FROM inbox ANTI JOIN gone USING (project_id, event_id) GROUP BY ALL
        UNION ALL SELECT 'identity', project_id, count(*) FROM identity ANTI JOIN gone USING (project_id, event_id) GROUP BY ALL
        UNION ALL SELECT 'mirror_queue', project_id, count(*) FROM queue ANTI JOIN gone USING (project_id, event_id) GROUP BY ALL
        UNION ALL SELECT 'outbox', project_id, count(*) FROM outb ANTI JOIN gone USING (project_id, event_id) GROUP BY ALL
        UNION ALL SELECT 'erased', project_id, count(*) FROM gone GROUP BY ALL""",
    "audit_latest": """SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS occurred_at,
          'operator-' || CAST(o_custkey % 20 AS VARCHAR) AS actor, 'order.' || lower(o_orderpriority) AS action,
          CAST(o_custkey AS VARCHAR) AS target, '{}' AS details
        FROM orders WHERE o_custkey % 3 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
    "mirror_latest": "SELECT project_id, event_id, event_type, schema_version, version FROM mirror_new",
    "mirror_counts": "SELECT project_id, count(DISTINCT event_id) AS mirror_events FROM mirror GROUP BY ALL",
    "mirror_pending": """SELECT strftime(occurred_at, '%Y%m') AS yyyymm,
          concat('{"project_id":"', project_id, '","event_id":"', event_id, '","event_type":"', event_type, '","schema_version":1,"user_id":',
            coalesce('"' || user_id || '"', 'null'), ',"anonymous_id":', coalesce('"' || anonymous_id || '"', 'null'),
            ',"session_id":', coalesce('"' || session_id || '"', 'null'),
            ',"occurred_at":"', strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f'), '","received_at":"', strftime(received_at, '%Y-%m-%d %H:%M:%S.%f'),
            '","properties":"', replace(properties, '"', '\\"'), '","version":"', strftime(received_at, '%Y-%m-%d %H:%M:%S.%f'), '"}') AS value
        FROM ev WHERE n % 33 = 0""".replace("\\\\", "\\"),
    "mirror_backfill": f"""SELECT project_id, event_id, {NOW} AS created_at FROM ev ANTI JOIN queue USING (project_id, event_id)
        WHERE occurred_at >= {START} AND occurred_at <= {END}""",
    "reconcile_buckets": """, a AS (SELECT project_id, event_type, CAST(occurred_at AS DATE) AS day, count(*) AS n FROM ev GROUP BY ALL),
        b AS (SELECT project_id, event_type, CAST(occurred_at AS DATE) AS day, count(*) AS n FROM mirror_new GROUP BY ALL)
        SELECT project_id, event_type, day, coalesce(a.n, 0) AS source_events, coalesce(b.n, 0) AS mirror_events,
          coalesce(a.n, 0) - coalesce(b.n, 0) AS discrepancy, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches
        FROM a FULL JOIN b USING (project_id, event_type, day)""",
    "reconcile_projects": """, a AS (SELECT project_id, count(*) AS n FROM ev GROUP BY ALL),
        b AS (SELECT project_id, count(DISTINCT event_id) AS n FROM mirror GROUP BY ALL)
        SELECT project_id, coalesce(a.n, 0) AS source_events, coalesce(b.n, 0) AS mirror_events,
          coalesce(a.n, 0) - coalesce(b.n, 0) AS discrepancy, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches
        FROM a FULL JOIN b USING (project_id)""",
    "outbox_publish": f"""SELECT project_id, event_id, concat('{{"project_id":"', project_id, '","event_id":"', event_id, '","payload":"',
          replace(payload, '"', '\\"'), '"}}') AS value FROM outb
        WHERE published_at IS NULL AND completed_at IS NULL AND dead_lettered_at IS NULL AND next_attempt_at <= {NOW}""",
    "broker_deliveries": """SELECT project_id, CASE WHEN n % 40 = 9 THEN 'x' || event_id ELSE event_id END AS event_id,
          CASE WHEN n % 40 = 9 THEN NULL ELSE received_at END AS received_at,
          CASE n % 40 WHEN 11 THEN 'JsonException' WHEN 13 THEN 'JsonException' WHEN 17 THEN 'JsonException' WHEN 7 THEN 'InvalidOperationException' WHEN 9 THEN 'InvalidOperationException' END AS error_type,
          CASE n % 40 WHEN 11 THEN 'The message''s payload is no JSON.'
            WHEN 13 THEN 'The message''s payload is no event.' WHEN 17 THEN 'The message''s payload is no event.' WHEN 7 THEN 'Envelope and payload name different events.'
            WHEN 9 THEN 'No outbox row has this event.' END AS message FROM ev""",
    "outbox_transition": """, t AS (SELECT *, n % 6 IN (0, 1, 4) AS hit, attempts + CASE WHEN n % 6 IN (0, 1, 4) THEN 1 ELSE 0 END AS tries,
            created_at + INTERVAL 1 DAY AS failed_at FROM outb),
        d AS (SELECT *, hit AND (n % 5 = 0 OR tries >= 8) AS dead FROM t)
        SELECT project_id, event_id, created_at, CASE WHEN hit AND NOT dead THEN NULL ELSE published_at END AS published_at, completed_at,
          CASE WHEN hit AND NOT dead THEN failed_at + to_microseconds(CAST(round(least(300.0, pow(2.0, tries)) * 1.1 * 1e6) AS BIGINT))
            ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN dead THEN failed_at ELSE dead_lettered_at END AS dead_lettered_at, CAST(tries AS INTEGER) AS attempts,
          CASE WHEN hit THEN CASE WHEN n % 5 = 0 THEN 'FormatException' ELSE 'IOException' END || ': delivery ' || CAST(n AS VARCHAR)
            ELSE last_error END AS last_error FROM d""",
    "outbox_complete": f"""SELECT project_id, event_id,
          CASE WHEN n % 40 IN (7, 9, 11, 13, 17) THEN completed_at ELSE coalesce(completed_at, {NOW}) END AS completed_at,
          CASE WHEN n % 40 IN (7, 9, 11, 13, 17) THEN last_error END AS last_error FROM outb""",
    "dead_letters": """SELECT event_id, project_id, created_at, attempts, last_error, dead_lettered_at FROM outb
        WHERE dead_lettered_at IS NOT NULL""",
    "dead_letter_replay": f""", r AS (SELECT *, dead_lettered_at IS NOT NULL AND project_id = 'p1' AS hit FROM outb)
        SELECT project_id, event_id, created_at, CASE WHEN NOT hit THEN published_at END AS published_at, completed_at,
          CASE WHEN hit THEN {NOW} ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN NOT hit THEN dead_lettered_at END AS dead_lettered_at,
          CASE WHEN hit THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT hit THEN last_error END AS last_error FROM r""",
    "schema_registry_gaps": """SELECT project_id, event_type, schema_version AS version, count(*) AS events FROM ev
        ANTI JOIN registered USING (project_id, event_type) GROUP BY ALL""",
    "schema_publish": """SELECT DISTINCT e.project_id, e.event_type, CAST(1 AS INTEGER) AS version,
          CASE WHEN r.project_id IS NULL THEN 'published' ELSE 'refused' END AS outcome
        FROM ev e LEFT JOIN registered r ON r.project_id = e.project_id AND r.event_type = e.event_type""",
    "saved_view_run": SUMMARY.format(
        "k = 5 AND event_type = 'view' AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-20'"
    ),
    "saved_view_counts": """, v AS (SELECT 'p' || CAST(c_custkey % 3 AS VARCHAR) AS project_id, CAST(c_custkey % 40 AS VARCHAR) AS user_id,
          c_name AS name, ['view', 'click', 'purchase'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS event_type FROM customer)
        SELECT v.project_id, v.user_id, v.name, v.event_type, count(e.event_id) AS events FROM v
        LEFT JOIN ev e ON e.project_id = v.project_id AND e.event_type = v.event_type GROUP BY ALL""",
    "project_catalog": """SELECT m.user_id, m.project_id, coalesce(nullif(p.name, ''), p.id) AS display_name, m.can_demo, m.can_manage
        FROM members m JOIN proj p ON p.id = m.project_id""",
    "member_roster": """SELECT c_name AS username, c_custkey % 10 = 0 AS disabled, can_demo, can_manage
        FROM members JOIN customer ON c_custkey = user_id WHERE project_id = 'p1' ORDER BY c_name LIMIT 200""",
    "project_managers": """SELECT project_id, count(*) AS managers FROM members WHERE can_manage AND user_id % 10 <> 0 GROUP BY ALL""",
    "membership_upsert": """SELECT user_id, project_id, can_demo OR user_id % 2 = 0 AS can_demo, can_manage FROM members
        UNION ALL SELECT user_id, 'p9', true, can_manage FROM members WHERE user_id % 2 <> 0""",
    "account_buckets": "SELECT c_custkey AS id, 'account-' || substr(sha256(lower(trim(c_name))), 1, 3) AS bucket FROM customer",
    "attempt_budget": _chain("g", "scope", "(SELECT *, 'global' AS scope FROM attempts)", 12)
    + _chain("b", "bucket", "(SELECT attempt_id, bucket, t FROM g)", 3)
    + """ SELECT a.attempt_id, a.bucket, make_timestamp(a.t) AS attempted_at, b.attempt_id IS NOT NULL AS allowed
        FROM attempts a LEFT JOIN b ON b.attempt_id = a.attempt_id""",
    "request_budget": """SELECT project_id, date_trunc('minute', received_at) AS minute, count(*) AS requests,
        greatest(count(*) - 2, 0) AS over FROM ev GROUP BY ALL""",
    "synthetic_events": """, k AS (SELECT '42:' || CAST(event_id AS VARCHAR) AS key FROM events),
        d AS (SELECT sha256(key) AS id, {picks} FROM k),
        r AS (SELECT *, ['signup', 'view_item', 'purchase', 'refund'][CAST(kind % 4 + 1 AS INTEGER)] AS event_type FROM d)
        SELECT concat_ws('-', substr(id, 1, 8), substr(id, 9, 4), substr(id, 13, 4), substr(id, 17, 4), substr(id, 21, 12)) AS event_id,
          event_type, 'user-' || CAST(person % 1000 AS VARCHAR) AS user_id, 'session-' || CAST(visit % 4000 AS VARCHAR) AS session_id,
          TIMESTAMP '2024-01-01' + to_seconds(moment % 2592000) AS occurred_at,
          CASE event_type WHEN 'purchase' THEN concat('{{"amountMinor":', money % 9900 + 100, ',"currency":"USD"}}')
            WHEN 'refund' THEN concat('{{"amountMinor":', money % 4900 + 100, ',"currency":"USD"}}') ELSE '{{}}' END AS properties FROM r""".format(
        picks=", ".join(
            f"CAST(('0x' || substr(sha256(key || ':{name}'), 1, 8)) AS BIGINT) AS {column}"
            for name, column in (("type", "kind"), ("user", "person"), ("session", "visit"), ("time", "moment"), ("amount", "money"))
        )
    ),
    "stream_project_inbox": """SELECT project_id, event_id, event_type, schema_version, user_id, anonymous_id, session_id, occurred_at,
        received_at, properties FROM ev""",
    "stream_dedup": "SELECT DISTINCT project_id, event_id FROM deliv",
    "stream_mirror": "SELECT project_id, event_id, event_type, received_at AS version FROM ev",
    "stream_event_counts": f"SELECT project_id, {DAY} AS bucket, event_type, count(*) AS events FROM ev GROUP BY ALL",
    "stream_attempt_budget": _chain("g", "scope", "(SELECT *, 'global' AS scope FROM attempts)", 12)
    + _chain("b", "bucket", "(SELECT attempt_id, bucket, t FROM g)", 3)
    + " SELECT a.attempt_id, a.bucket, b.attempt_id IS NOT NULL AS allowed FROM attempts a LEFT JOIN b ON b.attempt_id = a.attempt_id",
}

DELIVERY = """, arr AS MATERIALIZED (SELECT project_id, event_id, n, received_at AS created_at,
          CASE WHEN received_at < TIMESTAMP '2024-01-08' THEN 1 WHEN received_at < TIMESTAMP '2024-01-15' THEN 2
            WHEN received_at < TIMESTAMP '2024-01-22' THEN 3 ELSE 4 END AS since FROM ev),
        ticks AS (SELECT since AS k, max(created_at) AS now FROM arr GROUP BY since UNION ALL SELECT 5, TIMESTAMP '2024-02-12'
          UNION ALL SELECT 6, TIMESTAMP '2024-02-12 00:00:03' UNION ALL SELECT 7, TIMESTAMP '2024-02-19'),
        sim AS (SELECT 0 AS k, *, CAST(NULL AS TIMESTAMP) AS now, created_at AS due, 0 AS tries, CAST(NULL AS TIMESTAMP) AS sent, CAST(NULL AS TIMESTAMP) AS done,
            CAST(NULL AS TIMESTAMP) AS dead, CAST(NULL AS VARCHAR) AS error, FALSE AS tried FROM arr
          UNION ALL
          SELECT k, project_id, event_id, n, created_at, since, now,
            CASE WHEN fails AND NOT gone THEN now + to_microseconds(CAST(round(least(300.0, pow(2.0, tries + 1)) * 1.1 * 1e6) AS BIGINT)) ELSE due END,
            CAST(tries + CASE WHEN fails THEN 1 ELSE 0 END AS INTEGER), CASE WHEN fails AND NOT gone THEN NULL WHEN tried THEN now ELSE sent END,
            CASE WHEN tried AND NOT fails THEN now ELSE done END, CASE WHEN gone THEN now ELSE dead END,
            CASE WHEN fails THEN kind || ': ' || said WHEN tried THEN NULL ELSE error END, tried
          FROM (SELECT *, tried AND kind IS NOT NULL AS fails, tried AND kind IS NOT NULL AND (kind = 'FormatException' OR tries + 1 >= 4) AS gone,
              CASE WHEN n % 10 = 8 THEN 'The broker did not answer.' ELSE 'event ' || event_id END AS said
            FROM (SELECT s.* EXCLUDE (k, now, tried), t.k, t.now, s.done IS NULL AND s.dead IS NULL AND s.since <= t.k AND s.due <= t.now AS tried,
                CASE WHEN n % 10 = 3 THEN 'FormatException' WHEN n % 10 IN (5, 6) AND tries < 2 THEN 'IOException'
                  WHEN n % 10 = 7 OR (n % 10 = 8 AND tries = 0) THEN 'TimeoutException' END AS kind
              FROM sim s JOIN ticks t ON t.k = s.k + 1)))"""
BODIES["stream_delivery"] = DELIVERY + """ SELECT project_id, event_id, created_at, sent AS published_at, done AS completed_at, due AS next_attempt_at,
          dead AS dead_lettered_at, tries AS attempts, error AS last_error FROM sim WHERE k = 7"""
BODIES["stream_gauges"] = DELIVERY + """, seen AS (SELECT *, done IS NULL AND dead IS NULL AS open FROM sim WHERE k > 0 AND since <= k)
        SELECT CAST(k - 1 AS BIGINT) AS batch, now AS at, count(*) FILTER (since = k) AS arrived, count(*) FILTER (tried) AS published,
          count(*) FILTER (tried AND done = now) AS delivered, count(*) FILTER (tried AND done IS NULL) AS failed,
          count(*) FILTER (dead = now) AS dead_lettered, count(*) FILTER (open) AS outbox_pending, count(*) FILTER (open AND tries > 0) AS outbox_retrying,
          (epoch_us(now) - min(epoch_us(created_at)) FILTER (open)) / 1e6 AS outbox_oldest_seconds, count(*) FILTER (done IS NULL) AS inbox_pending,
          CASE WHEN k < 5 THEN count(*) FILTER (since = k) ELSE 1 END AS input_rows, count(*) FILTER (since = k) AS observed
        FROM seen GROUP BY k, now"""
BODIES["retention_in_place"] = BODIES["retention_survivors"]
BODIES["subject_erasure_in_place"] = BODIES["subject_erasure"].split("UNION ALL SELECT 'erased'")[0]
BODIES["membership_upsert_stored"] = BODIES["membership_upsert"]
BODIES["timeline_cursor"] = """, page AS (SELECT event_id, occurred_at FROM ev WHERE project_id = 'p1' ORDER BY occurred_at, event_id LIMIT 1 OFFSET 49)
        SELECT base64(encode('{"scope": "' || upper(sha256('{"end": "2024-02-01T00:00:00", "event_type": null, "project": "p1", "property_name": null, "property_value": null, "start": "2024-01-01T00:00:00", "user_id": null}'))
          || '", "at": "' || replace(strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '", "id": "' || event_id || '"}')) AS cursor, occurred_at AS at, event_id FROM page"""
BODIES["timeline_by_day"] = BODIES["timeline_next_page"]
BODIES["stream_mirror_merged"] = BODIES["stream_mirror"]
BODIES["identity_lookup_bucketed"] = BODIES["identity_lookup"]
BODIES["direct_receipts"] = BODIES["batch_receipts"].replace("'accepted' AS status", "'persisted' AS status").replace("'durable' AS durability, ", "")

ORACLES = {name: PRELUDE + body for name, body in BODIES.items()}
