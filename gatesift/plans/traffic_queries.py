"""Registered queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatesift.operators import limits as L
from gatesift.operators import traffic as R
from gatesift.patterns import gates as G
from gatesift.plans import duck as K
from gatesift.plans import inputs as I

NOW = (I.EPOCH + 600) * 1_000_000  # ten minutes into the log
TRUSTED = ["10.0.0.1", "10.0.0.7", "10.0.0.42"]


def _listings(spark, sf):
    return I.requests(spark, sf).filter(F.col("method") == "view")


def _tasks(spark, sf):
    r = I.requests(spark, sf)
    return r.select(
        F.col("request_id").alias("task_id"), F.col("session_id").alias("user_id"), F.col("client").alias("tenant_id"),
        F.col("at_us").alias("start_us"), (F.col("at_us") + F.col("duration_ns")).alias("end_us"),
    )


def _client_ip(spark, sf):
    r = I.requests(spark, sf)
    forwarded = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, " , 9.9.9.9 , 10.0.0.1").otherwise("203.0.113.5")
    real = F.when(F.col("k") % 3 == 0, "198.51.100.7").otherwise("")
    remote = F.concat("client_ip", F.lit(":443"))
    return r.select("request_id", R.client_ip(remote, forwarded, real, TRUSTED).alias("ip"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _decisions(spark, sf):
    return L.token_bucket(I.requests(spark, sf), "client")


QUERIES = {
    "request_summary": lambda spark, sf: R.request_summary(I.requests(spark, sf), F.lit(NOW)),
    "rps": lambda spark, sf: _rounded(R.rps(I.requests(spark, sf)).select("request_id", "in_window", "rps"), "rps"),
    "rps_summary": lambda spark, sf: _rounded(R.rps_summary(I.requests(spark, sf)), "current_rps", "peak_rps", "average_rps"),
    "recent_requests": lambda spark, sf: R.recent_requests(I.requests(spark, sf)).select("request_id", "at_us", "method", "status"),
    "attacks_by_category": lambda spark, sf: R.attacks_by_category(I.requests(spark, sf)),
    "health_summary": lambda spark, sf: R.health_summary(I.requests(spark, sf), F.lit(NOW)),
    "latency_percentiles": lambda spark, sf: R.latency_percentiles(I.requests(spark, sf), "method"),
    "status_counts": lambda spark, sf: R.status_counts(I.requests(spark, sf), "method"),
    "client_stats": lambda spark, sf: R.client_stats(_decisions(spark, sf).withColumnRenamed("key", "client")),
    "client_totals": lambda spark, sf: _rounded(R.client_totals(_decisions(spark, sf).withColumnRenamed("key", "client"), F.lit(NOW)), "requests_per_second"),
    "log_write_rate": lambda spark, sf: _rounded(R.log_write_rate(I.requests(spark, sf)).select("request_id", "n", "writes_per_second"), "writes_per_second"),
    "counters": lambda spark, sf: R.counters(I.requests(spark, sf)),
    "access_log": lambda spark, sf: R.access_log(I.requests(spark, sf)),
    "client_ip": _client_ip,
    "task_concurrency": lambda spark, sf: R.task_concurrency(_tasks(spark, sf)),
    "total_concurrency": lambda spark, sf: R.total_concurrency(_tasks(spark, sf)),
    "tenant_concurrency": lambda spark, sf: R.tenant_concurrency(_tasks(spark, sf)),
    "recon_rate": lambda spark, sf: R.recon_rate(_listings(spark, sf)).select("request_id", "session_id", "calls_per_minute"),
    "token_bucket": lambda spark, sf: _decisions(spark, sf).select("request_id", "key", "allowed"),
    "replay": lambda spark, sf: L.replay(I.requests(spark, sf).withColumn("msg_id", F.col("k").cast("string")), "session_id", "msg_id").select("request_id", "replayed"),
    "sid_rotation": lambda spark, sf: L.sid_rotation(_rotating(spark, sf), "identity", "sid").select("request_id", "honored"),
}


def _rotating(spark, sf):
    r = I.requests(spark, sf)
    number = F.substring("session_id", 2, 10).cast("bigint") % 10
    return r.select(
        "request_id", "at_us", F.concat(F.lit("i"), number).alias("identity"),
        F.concat(F.lit("x"), F.col("request_id") % (number * 6 + 5)).alias("sid"),
    )


def _sql(body: str, *more: str) -> str:
    return K.with_(I.REQUESTS, *more) + body


_SUMMARY = f"""totals AS (
  SELECT count(*) AS total, count(*) FILTER (at_us + duration_ns // 1000 > {NOW}) AS active, max(duration_ns) AS longest_ns,
         CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM requests_in),
recent AS (
  SELECT CAST(sum(duration_ns) // count(*) AS BIGINT) AS average_ns, list_sort(list(duration_ns))[count(*) // 2 + 1] AS median_ns FROM (
    SELECT duration_ns FROM requests_in WHERE at_us + duration_ns // 1000 <= {NOW}))"""
_RPS = """rates AS (
  SELECT request_id, at_us, count(*) OVER (ORDER BY at_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM requests_in)"""
_BUCKET = f"""numbered AS (
  SELECT request_id, client AS key, at_us, row_number() OVER (PARTITION BY client ORDER BY at_us, request_id) AS rn FROM requests_in),
steps(request_id, key, at_us, rn, credit, allowed) AS (
  SELECT request_id, key, at_us, rn, {(G.RATE_BURST - 1) * 600000}::BIGINT, true FROM numbered WHERE rn = 1
  UNION ALL
  SELECT request_id, key, at_us, rn, CASE WHEN c >= 600000 THEN c - 600000 ELSE c END, c >= 600000 FROM (
    SELECT n.request_id, n.key, n.at_us, n.rn, least({G.RATE_BURST * 600000}, s.credit + n.at_us - s.at_us) AS c
    FROM steps s JOIN numbered n ON n.key = s.key AND n.rn = s.rn + 1))"""
_REPLAY = """seen AS (
  SELECT request_id, session_id, k, at_us, row_number() OVER (PARTITION BY session_id, k ORDER BY at_us, request_id) AS rn FROM requests_in),
steps(request_id, session_id, k, rn, first_us, replayed) AS (
  SELECT request_id, session_id, k, rn, at_us, false FROM seen WHERE rn = 1
  UNION ALL
  SELECT n.request_id, n.session_id, n.k, n.rn, CASE WHEN n.at_us - s.first_us <= 60000000 THEN s.first_us ELSE n.at_us END,
         n.at_us - s.first_us <= 60000000
  FROM steps s JOIN seen n ON n.session_id = s.session_id AND n.k = s.k AND n.rn = s.rn + 1)"""
_ROTATION = f"""rot AS (
  SELECT request_id, at_us, CAST(session_id[2:] AS BIGINT) % 10 AS ident,
         request_id % ((CAST(session_id[2:] AS BIGINT) % 10) * 6 + 5) AS sid FROM requests_in),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY at_us, request_id) AS rn FROM rot),
steps(request_id, ident, rn, ids, degraded, honored) AS (
  SELECT request_id, ident, rn, [{{'s': sid, 't': at_us}}], false, true FROM numbered WHERE rn = 1
  UNION ALL
  SELECT request_id, ident, rn, CASE WHEN d OR known THEN live ELSE list_append(live, {{'s': sid, 't': at_us}}) END,
         d OR (NOT known AND len(live) + 1 > {G.ROTATION_LIMIT}), NOT d AND (known OR len(live) + 1 <= {G.ROTATION_LIMIT})
  FROM (SELECT *, degraded AND len(live) > 0 AS d, len(list_filter(live, lambda e: e.s = sid)) > 0 AS known FROM (
    SELECT n.request_id, n.ident, n.rn, n.sid, n.at_us, s.degraded,
           list_filter(s.ids, lambda e: n.at_us - e.t <= {G.ROTATION_WINDOW}000000) AS live
    FROM steps s JOIN numbered n ON n.ident = s.ident AND n.rn = s.rn + 1)))"""


_ADMITTED = f"""tasks AS (
  SELECT request_id AS task_id, session_id AS user_id, client AS tenant_id, at_us,
         least(at_us + duration_ns, at_us + {G.TASK_TIMEOUT}000000) AS end_us,
         row_number() OVER (ORDER BY at_us, request_id) AS rn FROM requests_in),
steps(task_id, user_id, tenant_id, at_us, end_us, rn, ends, admitted) AS (
  SELECT task_id, user_id, tenant_id, at_us, end_us, rn, [{{'e': end_us, 'u': user_id}}], true FROM tasks WHERE rn = 1
  UNION ALL
  SELECT task_id, user_id, tenant_id, at_us, end_us, rn, CASE WHEN ok THEN list_append(live, {{'e': end_us, 'u': user_id}}) ELSE live END, ok
  FROM (SELECT *, len(live) < {G.TASK_TOTAL} AND len(list_filter(live, lambda x: x.u = user_id)) < {G.TASK_LIMIT} AS ok
        FROM (SELECT n.*, list_filter(s.ends, lambda e: e.e > n.at_us) AS live FROM steps s JOIN tasks n ON n.rn = s.rn + 1))),
events AS (
  SELECT task_id, user_id, tenant_id, admitted, at_us, 1 AS kind, CAST(admitted AS INT) AS step FROM steps
  UNION ALL SELECT task_id, user_id, tenant_id, admitted, end_us, 0, -1 FROM steps WHERE admitted)"""


def _running(columns: str, over: str) -> str:
    return _sql(f"""SELECT {columns} FROM (
  SELECT *, CAST(sum(step) OVER ({over} ORDER BY at_us, kind, task_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events) WHERE kind = 1""", _ADMITTED)


_BOUNDS = ", ".join(f"({b})" for b in G.DURATION_BUCKETS)

ORACLES = {
    "request_summary": _sql("SELECT * FROM totals, recent", _SUMMARY),
    "rps": _sql("SELECT request_id, in_window, round(in_window / 60, 6) AS rps FROM rates", _RPS),
    "rps_summary": _sql("""SELECT round(arg_max(in_window, at_us * 1000000 + request_id) / 60, 6) AS current_rps, round(max(in_window) / 60, 6) AS peak_rps,
  round(count(*) / ((max(at_us) - min(at_us)) / 1000000), 6) AS average_rps FROM rates""".replace("at_us * 1000000 + request_id", "at_us::HUGEINT * 10000000 + request_id"), _RPS),
    "recent_requests": _sql("SELECT request_id, at_us, method, status FROM requests_in ORDER BY at_us DESC, request_id DESC LIMIT 50"),
    "attacks_by_category": _sql("SELECT category, count(*) AS attacks FROM (SELECT unnest(attacks) AS category FROM requests_in) GROUP BY ROLLUP (category)"),
    "health_summary": _sql(f"""SELECT attacks_last_minute, average_ns,
  concat_ws(',', CASE WHEN attacks_last_minute > 100 THEN 'attacks' END, CASE WHEN average_ns > 5000000000 THEN 'slow' END) AS alerts, CASE WHEN average_ns > 5000000000 THEN 'warning'
  WHEN attacks_last_minute > 100 THEN 'critical' ELSE 'healthy' END AS status FROM recent, (
    SELECT CAST(coalesce(sum(CASE WHEN at_us > {NOW} - 60000000 AND at_us <= {NOW} THEN len(attacks) ELSE 0 END), 0) AS BIGINT) AS attacks_last_minute FROM requests_in)""", _SUMMARY),
    "latency_percentiles": _sql("""SELECT method, d[greatest(1, CAST(floor(n * 0.5 + 0.5) AS BIGINT))] AS p50_ns, d[greatest(1, CAST(floor(n * 0.95 + 0.5) AS BIGINT))] AS p95_ns,
  d[greatest(1, CAST(floor(n * 0.99 + 0.5) AS BIGINT))] AS p99_ns, d[n] AS max_ns, n FROM (
  SELECT method, list_sort(list(duration_ns)) AS d, count(*) AS n FROM requests_in GROUP BY method)"""),
    "status_counts": _sql("SELECT method, status, count(*) AS n FROM requests_in GROUP BY ALL"),
    "client_stats": _sql("SELECT key AS client, count(*) AS requests, count(*) FILTER (NOT allowed) AS blocked, max(at_us) AS last_seen_us "
                         "FROM steps GROUP BY key ORDER BY requests DESC, client LIMIT 10", _BUCKET),
    "client_totals": _sql(f"""SELECT count(*) AS total_clients, count(*) FILTER (l > {NOW} - 300000000) AS active_clients,
  round(sum(r) / 3600, 6) AS requests_per_second, CAST(sum(b) AS BIGINT) AS blocked_requests FROM (
  SELECT key, count(*) AS r, count(*) FILTER (NOT allowed) AS b, max(at_us) AS l FROM steps GROUP BY key)""", _BUCKET),
    "log_write_rate": _sql("""SELECT request_id, n, round(CASE WHEN at_us = f THEN n ELSE n / ((at_us - f) / 1000000) END, 6) AS writes_per_second FROM (
  SELECT request_id, at_us, count(*) OVER w AS n, min(at_us) OVER w AS f FROM requests_in
  WINDOW w AS (ORDER BY at_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))"""),
    "counters": _sql(f"""SELECT CAST(le AS DOUBLE) AS le, count(*) FILTER (duration_ns <= le * 1e9 OR le IS NULL) AS requests,
  count(*) FILTER ((duration_ns <= le * 1e9 OR le IS NULL) AND status BETWEEN 400 AND 499) AS blocked
FROM requests_in, (VALUES {_BOUNDS}, (NULL)) AS b(le) GROUP BY b.le"""),
    "access_log": _sql("SELECT request_id, client_ip, method, path, status AS status_code, duration_ns // 1000000 AS duration_ms, user_agent FROM requests_in"),
    "client_ip": _sql(f"""SELECT request_id, CASE WHEN client_ip NOT IN ({", ".join(map(K.q, TRUSTED))}) THEN client_ip
  WHEN k % 4 = 1 THEN '9.9.9.9' WHEN k % 4 <> 0 THEN '203.0.113.5' WHEN k % 3 = 0 THEN '198.51.100.7' ELSE client_ip END AS ip FROM requests_in"""),
    "task_concurrency": _running("task_id, user_id, running, NOT admitted AS over_quota", "PARTITION BY user_id"),
    "total_concurrency": _running(f"task_id, running AS running_total, NOT admitted AND running >= {G.TASK_TOTAL} AS over_total", ""),
    "tenant_concurrency": _running("task_id, tenant_id, running", "PARTITION BY tenant_id"),
    "recon_rate": _sql(f"""SELECT request_id, session_id, n AS calls_per_minute FROM (
  SELECT a.request_id, a.session_id, count(*) AS n FROM requests_in a JOIN requests_in b ON a.session_id = b.session_id
    AND b.method = 'view' AND b.at_us > a.at_us - 60000000 AND (b.at_us, b.request_id) <= (a.at_us, a.request_id)
  WHERE a.method = 'view' GROUP BY ALL) WHERE n > {G.RECON_LIMIT}"""),
    "token_bucket": _sql("SELECT request_id, key, allowed FROM steps", _BUCKET),
    "replay": _sql("SELECT request_id, replayed FROM steps", _REPLAY),
    "sid_rotation": _sql("SELECT request_id, honored FROM steps", _ROTATION),
}
