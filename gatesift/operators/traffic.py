"""Statistics over a request log.

Columns: `request_id`, `at_us` (start, microseconds since 1970), `duration_ns`, `method`, `path`,
`status`, `bytes_in`, `bytes_out`, `client`, `client_ip`, `user_agent`, `attacks` (array of categories).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift.operators.limits import admitted
from gatesift.operators.slices import SLICE, carried, own_rows, running_total, side_by_side, with_halo
from gatesift.patterns import gates as G

SECOND = 1_000_000


def latest(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last `n` rows: a bounded top-n per partition, merged; never a full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def request_summary(requests: DataFrame, now_us: Column, recent: int | None = None) -> DataFrame:
    """One row: totals over the log, and mean and median time of the finished requests, or of the last `recent` of them.

    The median is the upper element of an even number; equal durations are counted before they are ranked.
    `now_us` decides which requests are running.
    """
    end = F.col("at_us") + F.expr("duration_ns div 1000")
    totals = requests.agg(
        F.count("*").alias("total"),
        F.count_if(end > now_us).alias("active"),
        F.max("duration_ns").alias("longest_ns"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
    )
    finished = requests.filter(end <= now_us).select("duration_ns", end.alias("end_us"), "request_id")
    if recent is not None:
        finished = latest(finished, recent, ["end_us", "request_id"])
    counts = finished.groupBy(F.col("duration_ns").alias("v")).agg(F.count("*").alias("c"))
    ranked = running_total(counts, [], F.expr("v div 200000"), ["v"], F.col("c"), "upto")
    number = finished.agg(F.count("*").alias("n"), F.expr("sum(duration_ns) div count(*)").alias("average_ns"))
    one = number.select("n", F.lit(1).alias("_all"))
    middle = ranked.withColumn("_all", F.lit(1)).join(F.broadcast(one), "_all").filter("upto > n div 2").agg(F.min("v").alias("median_ns"))
    return side_by_side(side_by_side(totals, number.select("average_ns")), middle)


def rps(requests: DataFrame, window_s: int = 60) -> DataFrame:
    """Requests per second at each request: those of the last `window_s` seconds over its length."""
    counted = _in_last(requests.select("request_id", "at_us"), window_s * SECOND, False)
    return counted.drop("first_us").withColumn("rps", F.col("in_window") / window_s)


def _instants(rows: DataFrame, window_us: int, closed: bool) -> DataFrame:
    """Per distinct `at_us` the rows of the time before it (its own instant included) and the time of the first of them.

    Rows are counted per instant first. Every instant enters at its time and leaves `window_us` later, so the rows
    in the window are a running total, and the first of them is the one that leaves next: both are found in slices
    of a second, of which each hands on one row in a scan of two levels. `closed` says whether a row exactly `window_us` old still counts.
    """
    age = window_us + (1 if closed else 0)
    counts = rows.groupBy("at_us").agg(F.count("*").alias("c"))
    enter = F.struct(F.col("at_us").alias("t"), F.col("c").alias("d"), F.lit(None).cast("bigint").alias("left"))
    leave = F.struct((F.col("at_us") + age).alias("t"), (-F.col("c")).alias("d"), F.col("at_us").alias("left"))
    events = counts.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*").groupBy("t").agg(
        F.sum("d").alias("d"), F.min("left").alias("left"), F.max(F.col("left").isNull()).alias("enters")
    )
    sliced = events.withColumn(SLICE, F.expr(f"t div {SECOND}"))
    inside = Window.partitionBy(SLICE)
    upto = inside.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    # The first row that leaves after an instant was the first in its window.
    later = inside.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    summary = sliced.groupBy(SLICE).agg(F.sum("d").alias("d"), F.min("left").alias("left"))
    carry = carried(summary, [], sums=["d"], minima=["left"])
    found = sliced.withColumn("_sum", F.sum("d").over(upto)).withColumn("_own", F.min("left").over(later)).join(carry, SLICE)
    return found.filter("enters").select(
        F.col("t").alias("at_us"), (F.col("_sum") + F.col("d_before")).alias("in_window"), F.coalesce("_own", "left_after").alias("first_us")
    )


def _in_last(rows: DataFrame, window_us: int, closed: bool) -> DataFrame:
    """Each row with `in_window` and `first_us` of its instant."""
    return rows.join(_instants(rows, window_us, closed), "at_us")


def rps_summary(requests: DataFrame, window_s: int = 60) -> DataFrame:
    """One row: current rate (at the last request), peak, and the mean over the span of the log."""
    at = F.col("at_us")
    rates = rps(requests, window_s).agg(
        F.max_by("rps", F.struct("at_us", "request_id")).alias("current_rps"),
        F.max("rps").alias("peak_rps"),
        F.count("*").alias("_n"),
        (F.max(at) - F.min(at)).alias("_span"),
    )
    mean = F.when((F.col("_n") < 2) | (F.col("_span") == 0), F.lit(0.0)).otherwise(F.col("_n") / (F.col("_span") / SECOND))
    return rates.select("current_rps", "peak_rps", mean.alias("average_rps"))


def recent_requests(requests: DataFrame, limit: int = 50) -> DataFrame:
    """The last requests; the limit is 50 unless it lies within 1 to 100."""
    n = 50 if limit <= 0 else min(limit, 100)
    return latest(requests, n, ["at_us", "request_id"])


def attacks_by_category(requests: DataFrame) -> DataFrame:
    """Count per attack category, and the total in the row without a category."""
    long = requests.select(F.explode("attacks").alias("category"))
    return long.rollup("category").agg(F.count("*").alias("attacks"))


def health_summary(requests: DataFrame, now_us: Column) -> DataFrame:
    """One row: status, alerts, and what they rest on: attacks of the last minute and the mean time.

    Every condition that holds is an alert; a slow average has the last word over many attacks in the status.
    """
    started = F.col("at_us").between(now_us - 60 * SECOND + 1, now_us)
    attacks = requests.agg(F.coalesce(F.sum(F.when(started, F.size("attacks"))), F.lit(0)).cast("bigint").alias("attacks_last_minute"))
    end = F.col("at_us") + F.expr("duration_ns div 1000")
    average = requests.filter(end <= now_us).agg(F.expr("sum(duration_ns) div count(*)").alias("average_ns"))
    both = side_by_side(attacks, average)
    slow = F.col("average_ns") > F.lit(int(G.SLOW_AVERAGE * 1_000_000_000))
    many = F.col("attacks_last_minute") > G.ATTACKS_PER_MINUTE
    alerts = F.array_compact(F.array(F.when(many, F.lit("attacks")), F.when(slow, F.lit("slow"))))
    status = F.when(slow, "warning").when(many, "critical").otherwise("healthy")
    return both.withColumns({"status": status, "alerts": F.array_join(alerts, ",")})


def latency_percentiles(requests: DataFrame, category: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles per category: the value at rank round(n·p), at least the first.

    Equal durations are counted before the shuffle; ranks come from running totals over the distinct
    values, so a category which holds most rows is spread over slices.
    """
    counts = requests.groupBy(category, F.col("duration_ns").alias("v")).agg(F.count("*").alias("c"))
    slices = F.expr("v div 200000")
    ranked = running_total(counts, [category], slices, ["v"], F.col("c"), "upto")
    totals = requests.groupBy(category).agg(F.count("*").alias("n"), F.max("duration_ns").alias("max_ns"))
    joined = ranked.join(totals, category)
    rank = {p: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p) + 0.5)) for p in shares}
    picked = [F.min(F.when(F.col("upto") >= rank[p], F.col("v"))).alias(f"p{round(p * 100)}_ns") for p in shares]
    return joined.groupBy(category).agg(*picked, F.max("max_ns").alias("max_ns"), F.max("n").alias("n"))


def status_counts(requests: DataFrame, category: str) -> DataFrame:
    return requests.groupBy(category, "status").agg(F.count("*").alias("n"))


def client_stats(decisions: DataFrame, top: int = 10) -> DataFrame:
    """The busiest clients of a table of decisions (`client`, `at_us`, `allowed`)."""
    per_client = decisions.groupBy("client").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("blocked"), F.max("at_us").alias("last_seen_us")
    )
    return per_client.orderBy(F.col("requests").desc(), "client").limit(top)


def client_totals(decisions: DataFrame, now_us: Column) -> DataFrame:
    """One row: clients, clients active in the last five minutes, requests per second over an hour, blocked."""
    per_client = decisions.groupBy("client").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("blocked"), F.max("at_us").alias("last")
    )
    active = F.count_if(F.col("last") > now_us - G.CLIENT_ACTIVE * SECOND)
    return per_client.agg(
        F.count("*").alias("total_clients"), active.alias("active_clients"),
        F.when(active > 0, F.sum("requests") / 3600.0).otherwise(0.0).alias("requests_per_second"),
        F.sum("blocked").alias("blocked_requests"),
    )


def log_write_rate(writes: DataFrame, window_s: int = 60) -> DataFrame:
    """Writes per second at each write: those of the last minute over the time from the first to the last.

    Where that time is zero the rate is their number.
    """
    seen = _in_last(writes.select("request_id", "at_us"), window_s * SECOND, True)
    span = (F.col("at_us") - F.col("first_us")) / SECOND
    rate = F.when(span == 0, F.col("in_window").cast("double")).otherwise(F.col("in_window") / span)
    return seen.select("request_id", "at_us", F.col("in_window").alias("n"), rate.alias("writes_per_second"))


def counters(requests: DataFrame, bounds: Sequence[float] = G.DURATION_BUCKETS) -> DataFrame:
    """Cumulative duration histogram: requests at or below each bound in seconds, +Inf (NULL) for all,
    with the number of refused requests (status 4xx) among them."""
    refused = F.count_if(F.col("status").between(400, 499))
    bucket = F.expr("CASE " + " ".join(f"WHEN duration_ns <= {round(b * 1e9)} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END")
    small = requests.groupBy(bucket.alias("b")).agg(F.count("*").alias("c"), refused.alias("r"))
    upto = small.select(F.explode(F.sequence("b", F.lit(len(bounds)))).alias("b"), "c", "r")
    table = F.expr("array(" + ", ".join(f"{b}D" for b in bounds) + ", cast(null as double))")
    return upto.groupBy("b").agg(F.sum("c").alias("requests"), F.sum("r").alias("blocked")).select(
        F.get(table, F.col("b")).alias("le"), "requests", "blocked"
    )


def access_log(requests: DataFrame) -> DataFrame:
    """The rows a request logger writes."""
    return requests.select(
        "request_id", "client_ip", "method", "path", F.col("status").alias("status_code"),
        F.expr("duration_ns div 1000000").alias("duration_ms"), "user_agent",
    )


def client_ip(remote: Column, forwarded: Column, real_ip: Column, trusted: Sequence[str]) -> Column:
    """Client address: forwarded headers count only when the peer itself is a trusted proxy."""
    peer = F.regexp_replace(remote, r":[^:]*\z", "")
    host = F.regexp_replace(peer, r"\A\[|\]\z", "")
    if not trusted:
        return host
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    proxied = peer.isin(list(trusted))
    return (
        F.when(proxied & (F.size(hops) > 0), F.get(hops, 0))
        .when(proxied & (real_ip != ""), real_ip)
        .otherwise(host)
    )


def running_tasks(tasks: DataFrame, keys: Sequence[str] = (), name: str = "running", slice_s: int = 60) -> DataFrame:
    """Admitted tasks which run when a task starts, itself included if admitted, per key or over all.

    `tasks` has `task_id`, the keys, `start_us`, `end_us`, `admitted`. Rows are counted in slices of time; only
    one number per slice is carried on.
    """
    start = F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("kind"), F.col("admitted").cast("int").alias("step"))
    stop = F.struct(F.col("end_us").alias("at_us"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    both = F.when(F.col("admitted"), F.array(start, stop)).otherwise(F.array(start))
    events = tasks.select("task_id", *keys, F.explode(both).alias("_e")).select("task_id", *keys, "_e.*")
    counted = running_total(events, keys, F.expr(f"at_us div {slice_s * SECOND}"), ["at_us", "kind", "task_id"], F.col("step"), name)
    return counted.filter("kind = 1").select("task_id", *keys, name)


def task_concurrency(
    tasks: DataFrame, user: str = "user_id", limit: int = G.TASK_LIMIT, timeout_s: int = G.TASK_TIMEOUT, slice_s: int = 60,
    total: int = G.TASK_TOTAL,
) -> DataFrame:
    """Admitted tasks of a user which run at each start, and whether the start is refused, by the limit of all or its user's.

    `tasks` has `task_id`, the user, `start_us`, `end_us`. A refused task does not run and counts for nothing.
    """
    judged = admitted(tasks, user, limit, timeout_s, total=total)
    counted = running_tasks(judged, [user], "running", slice_s)
    return counted.join(judged.select("task_id", (~F.col("admitted")).alias("over_quota")), "task_id")


def total_concurrency(tasks: DataFrame, total: int = G.TASK_TOTAL, timeout_s: int = G.TASK_TIMEOUT, slice_s: int = 10, limit: int = G.TASK_LIMIT) -> DataFrame:
    """Admitted tasks over all users which run at each start, and whether it is refused since `total` run already."""
    judged = admitted(tasks, limit=limit, timeout_s=timeout_s, total=total)
    counted = running_tasks(judged, [], "running_total", slice_s).join(judged.select("task_id", "admitted"), "task_id")
    return counted.select("task_id", "running_total", (~F.col("admitted") & (F.col("running_total") >= total)).alias("over_total"))


def tenant_concurrency(tasks: DataFrame, tenant: str = "tenant_id", limit: int = G.TASK_LIMIT, timeout_s: int = G.TASK_TIMEOUT, slice_s: int = 60, total: int = G.TASK_TOTAL) -> DataFrame:
    """Admitted tasks of a tenant which run at each start; tenants have no limit of their own."""
    judged = admitted(tasks, limit=limit, timeout_s=timeout_s, total=total).join(tasks.select("task_id", tenant), "task_id")
    return running_tasks(judged, [tenant], "running", slice_s)


def recon_rate(calls: DataFrame, key: str = "session_id", window_s: int = G.RECON_WINDOW, limit: int = G.RECON_LIMIT) -> DataFrame:
    """Catalogue listings which bring their session above the limit within the last minute.

    `calls` has `request_id`, the key and `at_us`, and holds listing calls only.
    """
    sliced = with_halo(calls.select("request_id", key, "at_us"), F.col("at_us"), window_s * SECOND, window_s * SECOND)
    recent = Window.partitionBy(key, "_slice").orderBy("at_us", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    # Rank within the slice minus the rows which have left the window.
    ranked = sliced.withColumn("_rank", F.row_number().over(recent))
    by_time = Window.partitionBy(key, "_slice").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -window_s * SECOND)
    counted = ranked.withColumn("calls_per_minute", F.col("_rank") - F.count("*").over(by_time))
    return own_rows(counted).filter(F.col("calls_per_minute") > limit).drop("_rank")
