"""DuckDB oracle SQL for the registered queries (same fixture rules as
``featurestats.sources.fixtures``, written independently in SQL)."""

from __future__ import annotations

# ---- fixture: the wide event table, from `events` -------------------------
EVENT_ROWS = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         0 AS version
  FROM events
)"""
EVENT_ROWS_DUP = """
ev0 AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
ev AS (
  SELECT *, 0 AS version FROM ev0
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value + 1, k, 1 FROM ev0 WHERE event_id % 50 = 0
)"""
EVENT_RESULT = """
event_result AS (
  SELECT CAST(event_id AS VARCHAR) AS eventId, event_type AS eventType, CAST(user_id AS VARCHAR) AS userId,
         ts AS eventTime,
         ts + to_hours(CAST((event_id * 7) % 37 - 1 + version AS BIGINT)) AS processingTime,
         [CAST(event_id % 13 AS INTEGER)] AS rules,
         CASE WHEN event_id % 7 = 0 THEN ['block'] ELSE ['pass'] END AS actions,
         (event_id % 11 = 0) AS fromUpdateAPI,
         value AS txn_amount,
         (['US', 'CN', 'NA', 'DE'])[CAST(user_id % 4 AS INTEGER) + 1] AS country,
         k AS score
  FROM ev
)"""


def with_events(body: str, duplicates: bool = False) -> str:
    rows = EVENT_ROWS_DUP if duplicates else EVENT_ROWS
    return f"WITH {rows},{EVENT_RESULT}\n{body}"


ACTIVITY_CASE = (
    "CASE WHEN eventType IN ('purchase', 'signup') THEN 'conversion' "
    "WHEN eventType = 'error' THEN 'error' ELSE 'engagement' END"
)

SQL: dict[str, str] = {}


def _long(where: str, seg: str = ACTIVITY_CASE, features=("txn_amount", "score")) -> str:
    parts = [
        f"SELECT '{f}' AS feature, {seg} AS segment_value, CAST(eventTime AS DATE) AS stat_date, "
        f"CAST({f} AS DOUBLE) AS x FROM event_result WHERE {where}"
        for f in features
    ]
    return ",\nlong AS (\n  " + "\n  UNION ALL\n  ".join(parts) + "\n)"


def _exact_stats(where: str, actual: str, window: int, status: str, source: str, seg=ACTIVITY_CASE,
                 features=("txn_amount", "score")) -> str:
    return (
        f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(where, seg, features)}\n"
        "SELECT feature, segment_value, count(x) AS \"count\", round(sum(x), 4) AS \"sum\",\n"
        "  round(min(x), 4) AS \"min\", round(max(x), 4) AS \"max\", round(avg(x), 4) AS mean,\n"
        "  round(stddev_pop(x), 4) AS std, count(*) - count(x) AS missing_count,\n"
        "  count(DISTINCT stat_date) AS active_days,\n"
        f"  CAST({actual} AS BIGINT) AS actual_days, CAST({window} AS BIGINT) AS window_days,\n"
        f"  round(CAST({actual} AS DOUBLE) / {window}.0, 4) AS coverage,\n"
        f"  '{status}' AS coverage_status, '{source}' AS source\n"
        "FROM long GROUP BY feature, segment_value"
    )


JAN = lambda d: f"TIMESTAMP '2024-01-{d:02d}'"
JAN_END = "TIMESTAMP '2024-01-31'"

SQL["cube_rollup_daily"] = with_events(
    f"""
SELECT 'acme' AS tenant, strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date,
       {ACTIVITY_CASE} AS segment_value, count(*) AS n_rows,
       count(txn_amount) AS txn_amount__cnt, round(sum(txn_amount), 4) AS txn_amount__sum_val,
       round(min(txn_amount), 4) AS txn_amount__min_val, round(max(txn_amount), 4) AS txn_amount__max_val,
       round(sum(txn_amount * txn_amount), 4) AS txn_amount__sum_sq,
       count(*) - count(txn_amount) AS txn_amount__missing_cnt,
       count(score) AS score__cnt, round(sum(CAST(score AS DOUBLE)), 4) AS score__sum_val,
       CAST(min(score) AS BIGINT) AS score__min_val, CAST(max(score) AS BIGINT) AS score__max_val,
       round(sum(CAST(score AS DOUBLE) * score), 4) AS score__sum_sq,
       count(*) - count(score) AS score__missing_cnt
FROM event_result GROUP BY ALL"""
)
SQL["cube_window_stats"] = _exact_stats(f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}", 30, 30, "COMPLETE", "rollup")
SQL["cube_partial_coverage"] = _exact_stats(f"eventTime >= {JAN(1)} AND eventTime < {JAN(21)}", 20, 30, "PARTIAL", "rollup")
SQL["cube_hybrid_stats"] = _exact_stats(f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}", 30, 30, "COMPLETE", "hybrid")
SQL["cube_raw_fallback"] = _exact_stats(f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}", 30, 30, "COMPLETE", "raw")
SQL["cube_fallback_clamped"] = _exact_stats(f"eventTime >= {JAN(24)} AND eventTime < {JAN_END}", 7, 90, "PARTIAL", "raw")
SQL["cube_column_dimension"] = _exact_stats(
    f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}", 30, 30, "COMPLETE", "raw", seg="country", features=("txn_amount",)
)
SQL["cube_incremental_refresh"] = _exact_stats(f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}", 30, 30, "COMPLETE", "rollup")

_WIN = f"eventTime >= {JAN(1)} AND eventTime < {JAN_END}"
SQL["cube_exact_percentiles"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN)}\n"
    "SELECT feature, segment_value, count(x) AS n, round(quantile_cont(x, 0.5), 4) AS p50,\n"
    "  round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95,\n"
    "  round(quantile_cont(x, 0.99), 4) AS p99\n"
    "FROM long WHERE x IS NOT NULL GROUP BY feature, segment_value"
)
SQL["cube_exact_distinct"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN)}\n"
    "SELECT feature, segment_value, count(DISTINCT x) AS distinct_exact FROM long GROUP BY feature, segment_value"
)
SQL["cube_sketch_percentile_check"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN)}\n"
    "SELECT feature, segment_value, m.measure, count(x) AS n, true AS within_tolerance\n"
    "FROM long, (VALUES ('p50'), ('p90'), ('p99')) m(measure) WHERE x IS NOT NULL\n"
    "GROUP BY feature, segment_value, m.measure"
)
SQL["cube_sketch_distinct_check"] = with_events(
    f"""
, long AS (
  SELECT {ACTIVITY_CASE} AS segment_value, 'txn_amount' AS feature, CAST(txn_amount AS VARCHAR) AS x FROM event_result WHERE {_WIN}
  UNION ALL SELECT {ACTIVITY_CASE}, 'score', CAST(score AS VARCHAR) FROM event_result WHERE {_WIN}
  UNION ALL SELECT {ACTIVITY_CASE}, 'userId', userId FROM event_result WHERE {_WIN}
)
SELECT feature, segment_value, count(DISTINCT x) AS distinct_exact, true AS within_tolerance
FROM long GROUP BY feature, segment_value"""
).replace("\n\n, long", "\n, long")
SQL["cube_affected_days"] = with_events(
    """
SELECT DISTINCT strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date FROM event_result
WHERE processingTime >= TIMESTAMP '2024-01-21' AND processingTime < TIMESTAMP '2024-01-22'"""
)
SQL["cube_late_refresh"] = _exact_stats(
    f"processingTime < TIMESTAMP '2024-01-22' AND eventTime >= {JAN(1)} AND eventTime < {JAN(21)}", 20, 20, "COMPLETE",
    "rollup",
)
SQL["cube_rebuild"] = _exact_stats(
    _WIN, 30, 30, "COMPLETE", "rollup", seg="CASE WHEN eventType = 'purchase' THEN 'buyer' ELSE 'other' END"
)
SQL["cube_status"] = with_events(
    f"""
SELECT CAST(30 AS BIGINT) AS expected_days, CAST(20 AS BIGINT) AS active_days, CAST(1 AS BIGINT) AS error_days,
       CAST(9 AS BIGINT) AS missing_days,
       (SELECT count(*) FROM (SELECT DISTINCT CAST(eventTime AS DATE), {ACTIVITY_CASE} FROM event_result
         WHERE eventTime < {JAN(21)})) AS rollup_rows,
       'ERROR' AS status"""
)
SQL["feature_compatibility"] = with_events(
    """
, c AS (
  SELECT count(*) AS n_rows,
    count(txn_amount) AS a1, count(TRY_CAST(CAST(txn_amount AS VARCHAR) AS DOUBLE)) AS a2,
    count(score) AS b1, count(TRY_CAST(CAST(score AS VARCHAR) AS DOUBLE)) AS b2,
    count(country) AS c1, count(TRY_CAST(country AS DOUBLE)) AS c2,
    count(eventType) AS d1, count(TRY_CAST(eventType AS DOUBLE)) AS d2
  FROM event_result)
SELECT 'txn_amount' AS feature, n_rows, a1 AS n_present, a2 AS n_numeric, round(a2 / a1, 4) AS numeric_rate FROM c
UNION ALL SELECT 'score', n_rows, b1, b2, round(b2 / b1, 4) FROM c
UNION ALL SELECT 'country', n_rows, c1, c2, round(c2 / c1, 4) FROM c
UNION ALL SELECT 'eventType', n_rows, d1, d2, round(d2 / d1, 4) FROM c"""
).replace("\n\n, c AS", "\n, c AS")
SQL["cube_reference_coverage"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN)}\n"
    "SELECT feature, segment_value, count(x) AS \"count\", round(sum(x), 4) AS \"sum\",\n"
    "  round(min(x), 4) AS \"min\", round(max(x), 4) AS \"max\", round(avg(x), 4) AS mean,\n"
    "  round(stddev_pop(x), 4) AS std, count(*) - count(x) AS missing_count,\n"
    "  count(DISTINCT stat_date) AS active_days, count(DISTINCT stat_date) AS actual_days,\n"
    "  CAST(29 AS BIGINT) AS window_days, round(count(DISTINCT stat_date) / 29.0, 4) AS coverage,\n"
    "  CASE WHEN count(DISTINCT stat_date) >= 29 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage_status,\n"
    "  'raw' AS source\n"
    "FROM long GROUP BY feature, segment_value"
)
_BLOCKED = "list_contains(actions, 'block')"
SQL["block_rate_by_event_type"] = with_events(
    f"""
SELECT eventType, count(*) AS n, count(*) FILTER (WHERE {_BLOCKED}) AS n_blocked,
       round(count(*) FILTER (WHERE {_BLOCKED}) / count(*), 4) AS block_rate
FROM event_result GROUP BY eventType"""
)
SQL["block_rate_via_rollup"] = SQL["block_rate_by_event_type"]
SQL["action_daily_rollup"] = with_events(
    f"""
SELECT strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date, eventType, count(*) AS n,
       count(*) FILTER (WHERE {_BLOCKED}) AS n_blocked
FROM event_result GROUP BY ALL"""
)
SQL["adhoc_top_event_types"] = with_events(
    """
SELECT eventType, count(*) AS n FROM event_result GROUP BY eventType ORDER BY n DESC, eventType LIMIT 20"""
)
SQL["count_and_sample"] = with_events(
    """
SELECT eventId, eventType, userId, strftime(eventTime, '%Y-%m-%d %H:%M:%S') AS eventTime,
       round(txn_amount, 4) AS txn_amount, (SELECT count(*) FROM event_result) AS total_rows
FROM event_result ORDER BY event_result.eventTime, eventId LIMIT 5"""
)

# ---- resolution: straight from `events`, independent of the JSON path -----
RES = """
r AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""
# a message object whose rules are no list: the record is kept with NULL rules
EDGE = "event_id % 1000 = 5"
SQL["resolve_fixed"] = f"""WITH {RES}
SELECT CAST(event_id AS VARCHAR) AS eventId, event_type AS eventType, CAST(user_id AS VARCHAR) AS userId,
  CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000000) * 1000 ELSE epoch_us(ts) // 1000 END AS event_ms,
  epoch_us(ts + to_hours(CAST((event_id * 7) % 37 - 1 AS BIGINT))) // 1000 AS proc_ms,
  CAST(to_json([CAST(event_id % 13 AS INTEGER), CAST(event_id % 5 AS INTEGER)]) AS VARCHAR) AS rules,
  CAST(to_json([CASE WHEN event_id % 7 = 0 THEN 'block' ELSE 'pass' END, NULL]) AS VARCHAR) AS actions,
  (event_id % 11 = 0) AS fromUpdateAPI,
  CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS originId
FROM r
UNION ALL SELECT 'x' || event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE {EDGE}"""
SQL["resolve_features"] = f"""WITH {RES}
SELECT CAST(event_id AS VARCHAR) AS eventId,
  (['US', 'CN', 'NA', 'DE'])[CAST(user_id % 4 AS INTEGER) + 1] AS country,
  round(CASE WHEN event_id % 100 = 11 THEN NULL ELSE value END, 4) AS txn_amount,
  CAST(CASE WHEN event_id % 100 = 12 THEN NULL ELSE k END AS BIGINT) AS score,
  CAST(k AS BIGINT) * 1000000000 AS score_big,
  round(CAST(CASE WHEN event_id % 100 = 14 THEN CAST('NaN' AS FLOAT) ELSE CAST(value AS FLOAT) END AS DOUBLE), 4) AS amount_f,
  CASE WHEN event_id % 100 = 12 THEN false ELSE event_id % 2 = 0 END AS is_even,
  '["' || event_type || '",null]' AS tags,
  event_type AS legacy_note,
  CAST(CASE WHEN event_id % 4 <> 0 THEN user_id ELSE k END AS BIGINT) AS account_id,
  event_id AS txn_ref
FROM r
UNION ALL SELECT 'x' || event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE {EDGE}"""
SQL["resolve_event_fields_override"] = f"""WITH {RES}
SELECT account_id IS NULL AS account_missing, count(*) AS n, CAST(sum(account_id) AS BIGINT) AS account_sum
FROM (SELECT CAST(CASE WHEN event_id % 4 <> 0 THEN user_id ELSE k END AS BIGINT) AS account_id FROM r
      UNION ALL SELECT NULL FROM r WHERE {EDGE})
GROUP BY ALL"""
SQL["resolve_coercions"] = f"""WITH {RES},
c AS (
  SELECT CASE WHEN event_id % 100 = 11 THEN NULL ELSE value END AS amount,
         CASE WHEN event_id % 100 = 14 THEN CAST('NaN' AS FLOAT) ELSE CAST(value AS FLOAT) END AS amount_f,
         CASE WHEN event_id % 100 = 12 THEN NULL ELSE k END AS score,
         CASE WHEN event_id % 100 = 12 THEN false ELSE event_id % 2 = 0 END AS is_even
  FROM r
  UNION ALL SELECT NULL, NULL, NULL, NULL FROM r WHERE {EDGE})
SELECT count(*) AS n, count(amount) AS amount_present, round(sum(amount), 4) AS amount_sum,
       count(*) FILTER (WHERE isnan(amount_f)) AS amount_f_nan, count(amount_f) AS amount_f_present,
       count(score) AS score_present, CAST(sum(score) AS BIGINT) AS score_sum,
       count(*) FILTER (WHERE is_even) AS even_true, count(*) FILTER (WHERE NOT is_even) AS even_false
FROM c"""
SQL["resolve_epoch"] = f"""WITH {RES},
m AS (SELECT CASE WHEN event_id % 3 = 0 THEN 's' ELSE 'ms' END AS unit,
        CASE WHEN event_id % 3 = 0 THEN (epoch_us(ts) // 1000000) * 1000 ELSE epoch_us(ts) // 1000 END AS ms
      FROM r
      UNION ALL SELECT 'ms', NULL FROM r WHERE {EDGE})
SELECT unit, count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms, CAST(sum(ms % 1000) AS BIGINT) AS sum_ms_part FROM m GROUP BY unit"""
SQL["resolve_arrays"] = f"""WITH {RES}
SELECT CAST(to_json([CAST(event_id % 13 AS INTEGER), CAST(event_id % 5 AS INTEGER)]) AS VARCHAR) AS rules,
  CAST(to_json([CASE WHEN event_id % 7 = 0 THEN 'block' ELSE 'pass' END, NULL]) AS VARCHAR) AS actions, count(*) AS n
FROM r GROUP BY ALL
UNION ALL SELECT NULL, NULL, count(*) FROM r WHERE {EDGE} HAVING count(*) > 0"""
SQL["unresolved_features"] = f"""WITH {RES}
SELECT '30' AS feature_id, count(k) AS n_events FROM r
UNION ALL SELECT '99', count(*) FROM r"""
SQL["resolve_quarantine"] = """
SELECT CASE event_id % 1000 WHEN 1 THEN 'not json ' || event_id WHEN 2 THEN '[' || event_id || ']'
         ELSE CAST(event_id AS VARCHAR) END AS raw_value, 'not_an_object' AS reason
FROM events WHERE event_id % 1000 IN (1, 2, 3)"""
SQL["stream_resolve"] = f"""WITH {RES}
SELECT CAST(event_id AS VARCHAR) AS eventId, event_type AS eventType,
  (['US', 'CN', 'NA', 'DE'])[CAST(user_id % 4 AS INTEGER) + 1] AS country,
  round(CASE WHEN event_id % 100 = 11 THEN NULL ELSE value END, 4) AS txn_amount,
  CAST(CASE WHEN event_id % 100 = 12 THEN NULL ELSE k END AS BIGINT) AS score,
  CAST(CASE WHEN event_id % 4 <> 0 THEN user_id ELSE k END AS BIGINT) AS account_id,
  strftime(CAST(ts + to_hours(CAST((event_id * 7) % 37 - 1 AS BIGINT)) AS DATE), '%Y-%m-%d') AS processing_day
FROM r
UNION ALL SELECT 'x' || event_id, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE {EDGE}"""
SQL["stream_dedup"] = f"""
SELECT event_type AS eventType, count(*) AS n, count(DISTINCT event_id) AS n_ids
FROM (SELECT event_type, event_id FROM events UNION ALL SELECT NULL, event_id FROM events WHERE {EDGE}) GROUP BY event_type"""
SQL["stream_restart_new_checkpoint"] = SQL["stream_dedup"]
SQL["stream_quarantine"] = SQL["resolve_quarantine"]
SQL["stream_two_batches_type_change"] = f"""WITH {RES}
SELECT event_type AS eventType, count(*) AS n, count(score) AS n_score, CAST(sum(score) AS DOUBLE) AS score_sum
FROM (SELECT event_type, CASE WHEN event_id % 100 = 12 THEN NULL ELSE k END AS score FROM r
      UNION ALL SELECT NULL, NULL FROM r WHERE {EDGE}) GROUP BY event_type"""

# ---- backfill source (A4) ----------------------------------------------------
SRC = EVENT_ROWS_DUP + """,
src AS (
  SELECT user_id AS pk, CAST(event_id AS VARCHAR) AS eventId, epoch_us(ts) // 1000 AS time, event_type AS eventType,
         epoch_us(ts + to_hours(CAST((event_id * 7) % 37 - 1 + version AS BIGINT))) // 1000 AS timeInserted,
         CASE WHEN event_id % 17 = 0 THEN 'user' END AS dv_reevaluate_entity,
         CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS origin_id,
         CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'batch' END AS origin_category,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS dv_isDetection,
         value AS txn_amount, event_id, version
  FROM ev
),
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk, eventId, time, eventType ORDER BY timeInserted DESC) AS rn
                 FROM src) WHERE rn = 1
)"""
SQL["dedup_keep_last"] = f"WITH {SRC}\nSELECT pk, eventId, time, eventType, timeInserted, round(txn_amount, 4) AS txn_amount FROM dedup"
SQL["dedup_then_filter_day"] = f"""WITH {SRC}
SELECT eventId, timeInserted, round(txn_amount, 4) AS txn_amount FROM dedup
WHERE timeInserted >= epoch_ms(TIMESTAMP '2024-01-10') AND timeInserted < epoch_ms(TIMESTAMP '2024-01-11')"""
SQL["duplicate_profile"] = f"""WITH {SRC}
SELECT count(*) AS total_rows, count(DISTINCT (pk, eventId, time, eventType)) AS unique_keys,
       count(*) - count(DISTINCT (pk, eventId, time, eventType)) AS duplicates FROM src"""
SQL["backfill_rename_types"] = f"""WITH {SRC}
SELECT eventId, CAST(pk AS VARCHAR) AS userId, eventType, time AS event_ms, timeInserted AS proc_ms,
       dv_isDetection <> 1 AS fromUpdateAPI, dv_reevaluate_entity AS reEvaluateEntity, origin_id AS originId,
       origin_category AS originCategory, round(txn_amount, 4) AS txn_amount,
       strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d') AS processing_day
FROM dedup"""
SQL["backfill_invert_flag"] = f"""WITH {SRC}
SELECT dv_isDetection <> 1 AS fromUpdateAPI, count(*) AS n FROM dedup GROUP BY ALL"""
_DAY = "strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d')"
_DAY_COUNTS = f"""WITH {SRC},
days AS (SELECT DISTINCT {_DAY} AS unit FROM src),
per_day AS (SELECT {_DAY} AS unit, count(*) AS n FROM dedup GROUP BY ALL)"""
SQL["backfill_resume"] = f"""{_DAY_COUNTS}
SELECT unit, 'DONE' AS state, coalesce(n, 0) AS "rows" FROM days LEFT JOIN per_day USING (unit)"""
SQL["backfill_dry_run"] = f"""{_DAY_COUNTS}
SELECT unit, coalesce(n, 0) AS "rows", CAST(0 AS BIGINT) AS ledger_rows FROM days LEFT JOIN per_day USING (unit)"""
SQL["backfill_parse_lists"] = f"""WITH {SRC}
SELECT eventId, CAST(to_json([CAST(event_id % 13 AS INTEGER)]) AS VARCHAR) AS rules,
       CAST(to_json([CASE WHEN event_id % 7 = 0 THEN 'block' ELSE 'pass' END]) AS VARCHAR) AS actions,
       '[]' AS trialRules, CASE WHEN event_id % 89 = 0 THEN NULL ELSE '[]' END AS trialActions,
       (['US', 'CN', 'NA', 'DE'])[CAST(pk % 4 AS INTEGER) + 1] AS country,
       CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS score,
       CASE WHEN event_id % 97 = 0 THEN 'first line' || chr(10) || 'second, "quoted" line ' || eventId END AS note,
       strftime(make_timestamp(time * 1000), '%Y-%m-%d %H:%M:%S') AS created,
       timeInserted AS proc_ms
FROM src JOIN events e USING (event_id)"""
SQL["backfill_stitch_slices"] = EVENT_ROWS_DUP.join(["WITH ", ""]) + """,
w AS (
  SELECT user_id AS pk, CAST(event_id AS VARCHAR) AS eventId, epoch_us(ts) // 1000 AS time, event_type AS eventType,
         epoch_us(ts + to_hours(CAST((event_id * 7) % 37 - 1 + version AS BIGINT))) // 1000 AS timeInserted,
         ((event_id * 3 + version) % 1000) / 10.0 AS f_000,
         ((event_id * 38 + version) % 1000) / 10.0 AS f_005,
         ((event_id * 80 + version) % 1000) / 10.0 AS f_011
  FROM ev
)
SELECT eventId, round(f_000, 4) AS f_000, round(f_005, 4) AS f_005, round(f_011, 4) AS f_011 FROM (
  SELECT *, row_number() OVER (PARTITION BY pk, eventId, time, eventType ORDER BY timeInserted DESC) AS rn FROM w
) WHERE rn = 1"""
SQL["prune_correlated"] = f"""WITH {SRC}
SELECT eventType, count(*) AS n FROM src
WHERE timeInserted >= epoch_ms(TIMESTAMP '2024-01-10') AND timeInserted < epoch_ms(TIMESTAMP '2024-01-11')
GROUP BY eventType"""
SQL["prune_parity"] = f"""WITH {SRC}
SELECT strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d') AS day, count(*) AS pruned_count,
       count(*) AS full_count, true AS parity FROM src GROUP BY ALL"""
SQL["distinct_months"] = "SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS period FROM orders"

# ---- layout and profiles ---------------------------------------------------------
_PDAY = "strftime(CAST(processingTime AS DATE), '%Y-%m-%d')"
SQL["layout_write_read"] = with_events(f"""
SELECT {_PDAY} AS processing_day, eventType, count(*) AS n, round(sum(txn_amount), 4) AS amount
FROM event_result GROUP BY ALL""")
SQL["schema_evolve"] = with_events("""
SELECT count(*) AS n, count(score) FILTER (WHERE eventTime >= TIMESTAMP '2024-01-16') AS n_score,
       count(score) FILTER (WHERE eventTime >= TIMESTAMP '2024-01-16') AS n_risk, 'score,risk' AS added
FROM event_result""")
SQL["compact_preserves_rows"] = with_events("""
SELECT count(*) AS rows_before, count(*) AS rows_after, true AS rows_match, true AS fewer_files, true AS sums_match
FROM event_result""")
SQL["retention_expired"] = with_events(f"""
SELECT {_PDAY} AS processing_day, count(*) AS n_rows FROM event_result
WHERE CAST(processingTime AS DATE) < DATE '2024-01-11' GROUP BY ALL""")
SQL["profile_gap"] = with_events("""
SELECT count(*) AS n, round(avg((epoch_us(processingTime) - epoch_us(eventTime)) / 3.6e9), 4) AS avg_gap_h,
       round(max((epoch_us(processingTime) - epoch_us(eventTime)) / 3.6e9), 4) AS max_gap_h,
       round(min((epoch_us(processingTime) - epoch_us(eventTime)) / 3.6e9), 4) AS min_gap_h,
       count(*) FILTER (WHERE processingTime < eventTime) AS n_negative
FROM event_result""")
SQL["profile_hourly"] = with_events("""
, h AS (SELECT CAST(hour(eventTime) AS BIGINT) AS hour, count(*) AS n FROM event_result GROUP BY ALL)
SELECT hour, n, n = (SELECT max(n) FROM h) AS is_peak FROM h""").replace("\n\n, h AS", "\n, h AS")
SQL["profile_partitions"] = with_events(f"""
SELECT {_PDAY} AS partition, count(*) AS n FROM event_result GROUP BY ALL""")
SQL["reconcile_counts"] = f"""WITH {SRC},
per_day AS (SELECT {_DAY} AS day, count(*) AS n FROM dedup GROUP BY ALL)
SELECT day, n AS source_rows, n AS target_rows, CAST(0 AS BIGINT) AS diff, true AS match FROM per_day"""
_SRC_TYPES = [("pk", "bigint"), ("eventId", "string"), ("time", "bigint"), ("eventType", "string"),
              ("timeInserted", "bigint"), ("rules", "array<int>"), ("actions", "array<string>"),
              ("dv_reevaluate_entity", "string"), ("origin_id", "bigint"), ("origin_category", "string"),
              ("dv_isDetection", "tinyint"), ("txn_amount", "double"), ("country", "string"), ("score", "int")]
_TGT_TYPES = [("eventId", "string"), ("eventType", "string"), ("userId", "string"), ("eventTime", "timestamp"),
              ("processingTime", "timestamp"), ("rules", "array<int>"), ("actions", "array<string>"),
              ("trialRules", "array<int>"), ("trialActions", "array<string>"), ("reEvaluateEntity", "string"),
              ("originId", "int"), ("originCategory", "string"), ("fromUpdateAPI", "boolean"),
              ("txn_amount", "double"), ("country", "string"), ("score", "int")]
_SRC_FILL = {"dv_reevaluate_entity": "count(*) FILTER (WHERE event_id % 17 = 0)",
             "origin_id": "count(*) FILTER (WHERE event_id % 2 = 0)", "txn_amount": "count(value)"}
_TGT_FILL = {"reEvaluateEntity": "0", "originId": "0", "originCategory": "0", "txn_amount": "count(value)"}


def _drift_sql() -> str:
    st, tt = dict(_SRC_TYPES), dict(_TGT_TYPES)
    rows = []
    for c in sorted(set(st) | set(tt)):
        status = ("missing_in_target" if c not in tt else "missing_in_source" if c not in st
                  else "type_differs" if st[c] != tt[c] else "same")
        s_src = (f"(SELECT round(CAST({_SRC_FILL.get(c, 'count(*)')} AS DOUBLE) / count(*), 4) FROM ev)"
                 if c in st else "CAST(NULL AS DOUBLE)")
        t_src = (f"(SELECT round(CAST({_TGT_FILL.get(c, 'count(*)')} AS DOUBLE) / count(*), 4) FROM ev WHERE version = 0)"
                 if c in tt else "CAST(NULL AS DOUBLE)")
        stype = f"'{st[c]}'" if c in st else "CAST(NULL AS VARCHAR)"
        ttype = f"'{tt[c]}'" if c in tt else "CAST(NULL AS VARCHAR)"
        rows.append(f"SELECT '{c}' AS \"column\", {stype} AS source_type, {ttype} AS target_type, "
                    f"{s_src} AS source_fill, {t_src} AS target_fill, '{status}' AS status")
    return f"WITH {EVENT_ROWS_DUP}\n" + "\nUNION ALL\n".join(rows)


SQL["column_drift"] = _drift_sql()
SQL["file_profile"] = "SELECT count(*) AS n_rows, true AS has_files FROM events"
SQL["refresh_non_empty"] = f"""WITH {EVENT_ROWS},{EVENT_RESULT}
SELECT count(*) AS n, count(*) > 0 AS ok FROM (
  SELECT DISTINCT CAST(eventTime AS DATE), {ACTIVITY_CASE} FROM event_result)"""

# ---- audit (A7) and execution log (A8) from orders ------------------------------
AUDIT = """
audit AS (
  SELECT 'q' || o_orderkey AS queryId,
         o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS "timestamp",
         CASE WHEN o_orderkey % 4 = 0 THEN 'default_catalog' ELSE 'lake_catalog' END AS catalog,
         CASE WHEN o_orderkey % 23 = 0 THEN 'ERR' WHEN o_orderkey % 31 = 0 THEN 'TIMEOUT' ELSE 'EOF' END AS state,
         CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 31 = 0 THEN 'E' || (o_orderkey % 5) ELSE '' END AS errorCode,
         (o_orderkey * 37) % 5000 AS queryTime,
         CAST(trunc(o_totalprice * 1000) AS BIGINT) AS scanBytes,
         o_orderkey % 100000 AS scanRows,
         (o_orderkey * 7919) % 1000000000 AS cpuCostNs,
         (o_orderkey * 104729) % 4294967296 AS memCostBytes,
         CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS isQuery,
         'SELECT eventType, count(*) FROM event_result WHERE priority = ''' || o_orderpriority
           || ''' AND amount > ' || CAST(o_totalprice AS VARCHAR) || ' GROUP BY eventType /* ' || o_custkey || ' */' AS stmt,
         CASE WHEN o_orderkey % 2 = 0 THEN 'mv_action_daily' ELSE '' END AS candidateMVs,
         CASE WHEN o_orderkey % 3 = 0 THEN 'mv_action_daily' ELSE '' END AS hitMvs
  FROM orders
)"""
LOG = """
log0 AS (
  SELECT o_orderkey AS id, 'q' || o_orderkey AS query_id, 'tenant_' || (o_custkey % 7) AS tenant,
         (['DAILY_MV_REFRESH', 'DAILY_WINDOW_MERGE', 'ADHOC_QUERY'])[o_orderkey % 3 + 1] AS query_type,
         (['DAILY_WH', 'ADHOC_WH', 'DAILY_HEAVY', 'ADHOC_HEAVY'])[o_orderkey % 4 + 1] AS routing_path,
         CAST(trunc(o_totalprice * 1000) AS BIGINT) + 1 AS actual_scan_bytes,
         CASE WHEN floor(o_orderkey / 8) % 3 = 0 THEN 5.0 ELSE 1.5 END AS factor,
         (o_orderkey * 13) % 60000 AS actual_duration_ms,
         o_orderkey % 13 = 0 AS is_retry,
         CASE WHEN o_orderkey % 13 = 0 THEN (['SPOT_RECLAIMED', 'OOM', 'TIMEOUT'])[o_orderkey % 3 + 1] END AS retry_reason,
         o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS created_at,
         o_orderkey % 4 + 1 AS mem_factor
  FROM orders
),
log AS (
  SELECT *, CAST(trunc(actual_scan_bytes * CAST(factor AS DOUBLE)) AS BIGINT) AS l1_estimate_bytes,
         actual_scan_bytes * 2 AS l2_estimate_bytes, actual_scan_bytes * mem_factor AS peak_memory_bytes
  FROM log0
)"""
_RES_COLS = """queryTime AS wall_ms, scanBytes AS scan_bytes, scanRows AS scan_rows,
       round(cpuCostNs / 1e6, 2) AS cpu_ms, round(memCostBytes / 1024 / 1024, 2) AS mem_mb, left(stmt, 80) AS query"""
SQL["audit_recent"] = f"""WITH {AUDIT}
SELECT queryId, strftime("timestamp", '%H:%M:%S') AS time, {_RES_COLS}
FROM audit WHERE isQuery = 1 AND catalog = 'lake_catalog' ORDER BY "timestamp" DESC, queryId DESC LIMIT 20"""
SQL["audit_top_cpu"] = f"""WITH {AUDIT}
SELECT queryId, {_RES_COLS}
FROM audit WHERE isQuery = 1 AND catalog = 'lake_catalog' ORDER BY cpuCostNs DESC, queryId DESC LIMIT 10"""
SQL["audit_failed"] = f"""WITH {AUDIT}
SELECT queryId, strftime("timestamp", '%H:%M:%S') AS time, state, errorCode, left(stmt, 80) AS query
FROM audit WHERE state <> 'EOF' ORDER BY "timestamp" DESC, queryId DESC LIMIT 10"""
SQL["audit_calibration"] = f"""WITH {LOG}
SELECT query_type, round(avg(peak_memory_bytes / actual_scan_bytes), 4) AS memory_ratio,
       round(avg(actual_scan_bytes / l2_estimate_bytes), 4) AS compression_ratio, count(*) AS n
FROM log WHERE created_at > (SELECT max(created_at) FROM log) - INTERVAL 30 DAY GROUP BY query_type"""
SQL["audit_deviation_streaks"] = f"""WITH {LOG},
d AS (SELECT tenant, id, created_at,
             coalesce(abs(l1_estimate_bytes - actual_scan_bytes) / actual_scan_bytes > 3, false) AS dev FROM log),
g AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at, id)
              - row_number() OVER (PARTITION BY tenant, dev ORDER BY created_at, id) AS grp FROM d)
SELECT tenant, strftime(first(created_at ORDER BY created_at, id), '%Y-%m-%d %H:%M:%S') AS first_at,
       first(id ORDER BY created_at, id) AS first_id, first(id ORDER BY created_at DESC, id DESC) AS last_id,
       count(*) AS run_len
FROM g WHERE dev GROUP BY tenant, grp HAVING count(*) >= 5"""
_WEEK = "strftime(make_timestamp(CAST(floor(epoch(created_at) / 604800) * 604800 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"
_DAYW = "strftime(make_timestamp(CAST(floor(epoch(created_at) / 86400) * 86400 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"
SQL["audit_frequency_alerts"] = f"""WITH {LOG}
SELECT 'retry' AS alert, {_WEEK} AS window_start, retry_reason AS detail, count(*) AS n
FROM log WHERE is_retry GROUP BY ALL HAVING count(*) > 2
UNION ALL
SELECT 'upgrade', {_DAYW}, 'ADHOC_HEAVY', count(*) FROM log WHERE routing_path = 'ADHOC_HEAVY' GROUP BY ALL HAVING count(*) > 5"""
SQL["audit_estimate_join"] = f"""WITH {AUDIT},{LOG}
SELECT a.queryId AS query_id, l.query_type, a.scanBytes, l.l1_estimate_bytes,
       round(l.l1_estimate_bytes / a.scanBytes, 4) AS l1_over_actual
FROM audit a LEFT JOIN log l ON a.queryId = l.query_id"""
SQL["audit_tenant_graduation"] = f"""WITH {LOG},
t AS (SELECT tenant, count(*) AS n_queries, avg(CAST(actual_scan_bytes > 50000000000 AS INTEGER)) AS heavy_scan_share,
             quantile_cont(actual_duration_ms, 0.99) AS p99_ms FROM log GROUP BY tenant),
steps AS (SELECT tenant, epoch_ms(created_at) AS t_ms, 1 AS step FROM log
          UNION ALL SELECT tenant, epoch_ms(created_at) + greatest(actual_duration_ms, 1), -1 FROM log),
run AS (SELECT tenant, sum(step) OVER (PARTITION BY tenant ORDER BY t_ms, step ROWS UNBOUNDED PRECEDING) AS n FROM steps),
c AS (SELECT tenant, CAST(max(n) AS BIGINT) AS peak_queries FROM run GROUP BY tenant),
ev AS (SELECT 'tenant_' || (user_id % 7) AS tenant, date_trunc('minute', ts) AS m, event_type FROM events),
e AS (SELECT tenant, max(n) / 60.0 AS peak_events_per_s FROM (SELECT tenant, m, count(*) AS n FROM ev GROUP BY ALL) GROUP BY tenant),
u AS (SELECT tenant, count(DISTINCT event_type) AS n_rollups FROM ev GROUP BY tenant)
SELECT tenant, n_queries, round(heavy_scan_share, 4) AS heavy_scan_share, round(peak_events_per_s, 4) AS peak_events_per_s,
       peak_queries, round(p99_ms, 4) AS p99_ms, n_rollups,
       (coalesce(peak_events_per_s > 2000, false) OR peak_queries > 15 OR p99_ms > 3000 OR coalesce(n_rollups > 50, false)
        OR heavy_scan_share >= 0.1) AS graduate
FROM t LEFT JOIN c USING (tenant) LEFT JOIN e USING (tenant) LEFT JOIN u USING (tenant)"""
SQL["audit_rollup_hit_rate"] = f"""WITH {AUDIT}
SELECT strftime(CAST("timestamp" AS DATE), '%Y-%m-%d') AS day, count(*) AS n,
       round(avg(CAST(hitMvs <> '' AS INTEGER)), 4) AS hit_rate,
       round(avg(CAST(candidateMVs <> '' AS INTEGER)), 4) AS candidate_rate
FROM audit WHERE isQuery = 1 GROUP BY ALL"""

SQL["sql_catalog_query"] = with_events("""
SELECT eventType, count(*) AS n, count(*) FILTER (WHERE list_contains(actions, 'block')) AS n_blocked
FROM event_result GROUP BY eventType""")
SQL["cube_tenant_filter"] = SQL["cube_window_stats"]
SQL["cube_feature_rollup"] = with_events(f"""
SELECT 'mv_acme_activity_txn_amount' AS rollup, 'acme' AS tenant,
       strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date, {ACTIVITY_CASE} AS segment_value,
       count(txn_amount) AS cnt, round(sum(txn_amount), 4) AS sum_val, round(min(txn_amount), 4) AS min_val,
       round(max(txn_amount), 4) AS max_val, round(sum(txn_amount * txn_amount), 4) AS sum_sq,
       count(*) - count(txn_amount) AS missing_cnt
FROM event_result GROUP BY ALL""")
SQL["cube_raw_pruned"] = SQL["cube_fallback_clamped"]
SQL["reconcile_keys"] = f"""WITH {SRC}
SELECT 'source_only' AS side, eventId FROM dedup
WHERE timeInserted >= epoch_ms(TIMESTAMP '2024-01-10') AND timeInserted < epoch_ms(TIMESTAMP '2024-01-11')"""
SQL["cube_rebuild_add_feature"] = SQL["cube_window_stats"]

_SHIP_SEG = "l_returnflag || ':' || CASE WHEN l_quantity >= 25 THEN 'bulk' ELSE 'small' END"


def _ship_window(n: int) -> str:
    feats = ("l_extendedprice", "l_discount", "l_quantity", "l_tax")
    longs = "\n  UNION ALL\n  ".join(
        f"SELECT '{f}' AS feature, {_SHIP_SEG} AS segment_value, CAST(l_shipdate AS DATE) AS stat_date, "
        f"CAST({f} AS DOUBLE) AS x FROM lineitem WHERE l_shipdate >= DATE '2001-11-05' - INTERVAL {n} DAY "
        f"AND l_shipdate < DATE '2001-11-05'" for f in feats)
    return (
        f"SELECT feature, segment_value, count(x) AS \"count\", round(sum(x), 4) AS \"sum\", round(min(x), 4) AS \"min\",\n"
        f"  round(max(x), 4) AS \"max\", round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std,\n"
        f"  count(*) - count(x) AS missing_count, count(DISTINCT stat_date) AS active_days,\n"
        f"  CAST({n} AS BIGINT) AS actual_days, CAST({n} AS BIGINT) AS window_days, CAST(1.0 AS DOUBLE) AS coverage,\n"
        f"  'COMPLETE' AS coverage_status, 'rollup' AS source\n"
        f"FROM (\n  {longs}\n) GROUP BY feature, segment_value"
    )


SQL["cube_lineitem_windows"] = "\nUNION ALL\n".join(f"({_ship_window(n)})" for n in (30, 90, 180))
SQL["stream_pending_refresh"] = f"""WITH {RES},
x AS (SELECT 'txn_amount' AS feature, event_type AS segment_value, CAST(ts AS DATE) AS stat_date,
             CASE WHEN event_id % 100 = 11 THEN NULL ELSE value END AS x FROM r
      WHERE ts < TIMESTAMP '2024-01-31')
SELECT feature, segment_value, count(x) AS "count", round(sum(x), 4) AS "sum", round(min(x), 4) AS "min",
  round(max(x), 4) AS "max", round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std,
  count(*) - count(x) AS missing_count, count(DISTINCT stat_date) AS active_days,
  CAST(30 AS BIGINT) AS actual_days, CAST(30 AS BIGINT) AS window_days, CAST(1.0 AS DOUBLE) AS coverage,
  'COMPLETE' AS coverage_status, 'rollup' AS source
FROM x GROUP BY feature, segment_value"""
SQL["retention_apply"] = with_events(f"""
SELECT {_PDAY} AS processing_day, count(*) AS n_rows FROM event_result
WHERE CAST(processingTime AS DATE) >= DATE '2024-01-11' GROUP BY ALL""")
SQL["backfill_into_live_table"] = f"""WITH {SRC}
SELECT 'live' AS writer, count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(0 AS BIGINT) AS n_origin FROM events
UNION ALL SELECT 'day', count(*), count(DISTINCT eventId), count(origin_id) FROM dedup
UNION ALL SELECT 'file', count(*), count(DISTINCT eventId), count(origin_id) FROM src"""
SQL["backfill_mixed_headers"] = f"""WITH {RES}
SELECT CAST(event_id AS VARCHAR) AS eventId, event_type AS eventType, round(value, 4) AS txn_amount, CAST(k AS BIGINT) AS score,
       round(CASE WHEN event_id % 3 = 2 THEN k / 100.0 END, 4) AS risk, epoch_us(ts) // 1000 AS event_ms FROM r"""
SQL["backfill_corrupt_export"] = """
SELECT 'part' || (event_id % 3) AS part, CASE WHEN event_id % 3 = 1 THEN 'FAILED' ELSE 'DONE' END AS state,
       CASE WHEN event_id % 3 = 1 THEN 0 ELSE count(*) END AS "rows", CASE WHEN event_id % 3 = 1 THEN 0 ELSE count(*) END AS table_rows
FROM events GROUP BY event_id % 3"""
SQL["backfill_supersede_rerun"] = f"""WITH {SRC}
SELECT strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d') AS processing_day, count(*) AS n, count(DISTINCT eventId) AS n_ids
FROM dedup GROUP BY ALL"""
SQL["dedup_tie"] = f"""WITH {SRC}
SELECT eventType, count(*) AS n, count(DISTINCT eventId) AS n_ids, max(timeInserted) AS last_ms FROM dedup GROUP BY eventType"""
SQL["cube_refresh_emptied_day"] = with_events("""
SELECT strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date, count(*) AS n_rows FROM event_result
WHERE eventTime < TIMESTAMP '2024-01-16' GROUP BY ALL""")
SQL["cube_rebuild_twice"] = with_events(f"""
SELECT {ACTIVITY_CASE} AS segment_value, count(*) AS n_rows, count(DISTINCT CAST(eventTime AS DATE)) AS n_states
FROM event_result GROUP BY ALL""")
SQL["cube_refresh_error_status"] = with_events("""
SELECT count(DISTINCT CAST(eventTime AS DATE)) AS expected_days, CAST(20 AS BIGINT) AS active_days,
       count(DISTINCT CAST(eventTime AS DATE)) - 20 AS error_days, CAST(0 AS BIGINT) AS missing_days, 'ERROR' AS status FROM event_result""")
SQL["cube_null_segment"] = with_events("""
SELECT nullif(country, 'NA') AS country, count(txn_amount) AS n, round(quantile_cont(txn_amount, 0.5), 4) AS p50,
       round(quantile_cont(txn_amount, 0.99), 4) AS p99, count(*) AS n_rows
FROM event_result GROUP BY nullif(country, 'NA')""")

# ---- arrival index, schema log ----------------------------------------------
SQL["cube_index_pruned"] = SQL["cube_raw_fallback"]
SQL["cube_stale_day"] = SQL["cube_hybrid_stats"]
SQL["cube_stale_partial"] = _exact_stats(f"eventTime >= {JAN(11)} AND eventTime < {JAN_END}", 20, 30, "PARTIAL", "rollup")
SQL["cube_stale_refresh"] = SQL["cube_window_stats"].replace(
    "SELECT feature, segment_value, count(x)", "SELECT CAST(10 AS BIGINT) AS n_refreshed, feature, segment_value, count(x)")
SQL["cube_rebuild_null_time"] = SQL["cube_rebuild"].replace("FROM event_result WHERE", "FROM event_result WHERE CAST(eventId AS BIGINT) % 41 <> 0 AND")
_STATES = """SELECT '{0}' AS definition, strftime(CAST(eventTime AS DATE), '%Y-%m-%d') AS stat_date, {1} AS segment_value, count(*) AS n_rows,
  count(txn_amount) AS n_amount, round(sum(txn_amount), 4) AS amount FROM event_result GROUP BY ALL"""
SQL["cube_rebuild_states"] = with_events(
    _STATES.format("old", ACTIVITY_CASE) + "\nUNION ALL\n"
    + _STATES.format("new", "CASE WHEN eventType = 'purchase' THEN 'buyer' ELSE 'other' END"))
SQL["schema_log_evolve"] = with_events("""
SELECT u."column", u.type, u.version, u.n_values FROM (
  SELECT count(*) AS n, count(txn_amount) AS amount, count(score) FILTER (WHERE CAST(eventId AS BIGINT) % 4 IN (1, 2)) AS score,
    count(score) FILTER (WHERE CAST(eventId AS BIGINT) % 4 = 2) AS risk, count(score) FILTER (WHERE CAST(eventId AS BIGINT) % 4 = 3) AS text
  FROM event_result) s,
LATERAL (VALUES ('eventId', 'string', CAST(1 AS BIGINT), s.n), ('txn_amount', 'double', 1, s.amount), ('score', 'int', 2, s.score),
  ('risk', 'double', 3, s.risk), ('score__string', 'string', 4, s.text)) u("column", type, version, n_values)""")
SQL["backfill_key_index"] = f"""WITH {SRC}
SELECT strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d') AS processing_day, count(*) AS n, count(DISTINCT eventId) AS n_ids,
  round(sum(txn_amount), 4) AS amount
FROM dedup GROUP BY ALL"""
SQL["backfill_tie"] = f"""WITH {SRC}
SELECT eventId, timeInserted AS proc_ms, CAST(k + 1 AS BIGINT) AS score FROM dedup JOIN ev0 USING (event_id)"""
SQL["compact_bins"] = with_events("""
SELECT count(*) AS n_rows, count(DISTINCT eventId) AS n_ids, round(sum(txn_amount), 4) AS amount, true AS packed, true AS large_files_stay,
  CAST(0 AS BIGINT) AS files_rewritten_again FROM event_result""")
SQL["reconcile_values"] = f"""WITH {SRC}
SELECT strftime(CAST(make_timestamp(timeInserted * 1000) AS DATE), '%Y-%m-%d') AS day, eventId, CAST(1 AS BIGINT) AS source_n,
  CAST(CASE event_id % 500 WHEN 7 THEN 0 WHEN 11 THEN 2 ELSE 1 END AS BIGINT) AS target_n,
  CASE event_id % 500 WHEN 7 THEN 'missing' WHEN 11 THEN 'count' ELSE 'value' END AS status,
  CASE event_id % 500 WHEN 3 THEN 'txn_amount' END AS changed
FROM dedup WHERE event_id % 500 IN (3, 7, 11)"""
SQL["cube_bitmap_distinct"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN, features=('txn_amount', 'score', 'userId'))}\n"
    "SELECT feature, segment_value, count(DISTINCT x) AS distinct_count FROM long GROUP BY feature, segment_value")
SQL["cube_guided_percentiles"] = (
    f"WITH {EVENT_ROWS},{EVENT_RESULT}{_long(_WIN)}\n"
    "SELECT feature, segment_value, q.measure, count(x) AS n, round(any_value(CASE q.measure WHEN 'p50' THEN p50 WHEN 'p90' THEN p90\n"
    "  WHEN 'p95' THEN p95 ELSE p99 END), 4) AS value\n"
    "FROM long JOIN (SELECT feature, segment_value, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90,\n"
    "  quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM long GROUP BY ALL) USING (feature, segment_value),\n"
    "  (VALUES ('p50'), ('p90'), ('p95'), ('p99')) q(measure)\n"
    "WHERE x IS NOT NULL GROUP BY feature, segment_value, q.measure")
SQL["cube_dyadic_windows"] = "\nUNION ALL\n".join(f"({_ship_window(n)})" for n in (180, 730))
SQL["cube_rebuild_coarser"] = SQL["cube_window_stats"]
SQL["stream_alerts"] = f"SELECT *, CAST(1 AS BIGINT) AS late_rows FROM ({SQL['audit_frequency_alerts']}\n)"
SQL["stream_estimate_join"] = SQL["audit_estimate_join"]
SQL["prune_indexed"] = f"""WITH {SRC}
SELECT eventType, count(*) AS n FROM (SELECT eventType, timeInserted + CASE WHEN event_id % 97 = 0 THEN 2592000000 ELSE 0 END AS moment FROM src)
WHERE moment >= epoch_ms(TIMESTAMP '2024-02-05') AND moment < epoch_ms(TIMESTAMP '2024-02-06') GROUP BY eventType"""
