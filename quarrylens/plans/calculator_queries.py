"""Queries of the calculators; counters are made of line items, orders and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.operators import calculators as c
from quarrylens.plans.common import rounded, rounded_sql, t


def _cache(s, d):
    e = t(s, d, "events")
    made = e.groupBy(F.col("user_id")).agg(F.count_if(F.col("event_type").isin("view", "click")).alias("hits"), F.count_if(~F.col("event_type").isin("view", "click")).alias("misses"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("avg_hit_latency_ms"), F.avg(F.when(F.col("event_type") == "error", F.col("value"))).alias("avg_miss_latency_ms"))
    return made.withColumn("size_bytes", F.col("hits") * 3).withColumn("max_size_bytes", F.lit(200).cast("long"))


CACHE = """(SELECT *, hits * 3 AS size_bytes, 200::BIGINT AS max_size_bytes FROM (SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS hits, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS misses, avg(value) FILTER (WHERE event_type = 'view') AS avg_hit_latency_ms, avg(value) FILTER (WHERE event_type = 'error') AS avg_miss_latency_ms FROM events GROUP BY 1))"""
CODES = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
CACHE_SQL = f"""SELECT *, CASE WHEN hit_rate_percent >= 95 THEN 'excellent' WHEN hit_rate_percent >= 85 THEN 'good' WHEN hit_rate_percent >= 70 THEN 'fair' ELSE 'poor' END AS status,
  {CODES.format("CASE WHEN hit_rate_percent < 70 THEN 'low hit rate' END, CASE WHEN fill_percent > 95 THEN 'nearly full' END, CASE WHEN fill_percent < 30 THEN 'low utilization' END, CASE WHEN avg_hit_latency_ms > 0.5 * avg_miss_latency_ms THEN 'slow hits' END")} AS recommendations
  FROM (SELECT *, hits + misses AS total_requests, 100.0 * hits / (hits + misses) AS hit_rate_percent, 100.0 * misses / (hits + misses) AS miss_rate_percent, nullif((avg_miss_latency_ms - avg_hit_latency_ms) * hits, 0) AS latency_savings_ms, nullif(100.0 * size_bytes / max_size_bytes, 0) AS fill_percent FROM {CACHE})"""
C_COLS = ("avg_hit_latency_ms", "avg_miss_latency_ms", "hit_rate_percent", "miss_rate_percent", "latency_savings_ms", "fill_percent")


def c04(s, d):
    e = t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("evictions"), F.count("*").alias("total_operations"), F.count_if((F.col("event_type") == "error") & (F.col("value") < 40)).alias("premature_evictions"), F.count_if((F.col("event_type") == "error") & (F.col("value") < 150)).alias("lru_evictions"), F.avg("value").alias("avg_entry_age_seconds"))
    return rounded(c.evictions(e.withColumn("duration_seconds", F.lit(600.0))))


def d01(s, d):
    return rounded(c.query_metrics(t(s, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", "l_linenumber", F.col("l_linestatus") == "O", slow_ms=50000.0))


def d03(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("active_connections"), F.count_if(F.col("o_orderstatus") == "P").alias("waiting_requests"), F.transform(F.array_sort(F.collect_list("o_totalprice")), lambda x: x / 1000).alias("wait_times_ms"), F.count_if(F.col("o_orderstatus") == "F").alias("connection_errors"))
    o = o.withColumn("pool_size", F.lit(15).cast("long")).withColumn("idle_connections", F.lit(None).cast("long")).withColumn("timeout_count", F.lit(0).cast("long"))
    made = c.pool_metrics(o).withColumn("optimal_pool_size", c.optimal_pool_size(F.col("active_connections"), F.col("average_wait_time_ms")))
    return rounded(made.drop("wait_times_ms"), 9)


def _io(s, d):
    li = t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("device")).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(0.0)).alias("read_bytes"), F.sum(F.when(F.col("l_linestatus") != "O", F.col("l_extendedprice")).otherwise(0.0)).alias("write_bytes"),
        F.count_if(F.col("l_linestatus") == "O").alias("read_ops"), F.count_if(F.col("l_linestatus") != "O").alias("write_ops"), F.count("*").alias("operations"), F.avg("l_quantity").alias("avg_read_latency_ms"), F.max("l_quantity").alias("avg_write_latency_ms"), (F.avg("l_discount") * 1000).alias("utilization_percent"))
    return li.withColumn("duration_seconds", F.lit(120.0))


IO = """(SELECT l_suppkey AS device, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END) AS read_bytes, sum(CASE WHEN l_linestatus <> 'O' THEN l_extendedprice ELSE 0.0 END) AS write_bytes, count(*) FILTER (WHERE l_linestatus = 'O') AS read_ops, count(*) FILTER (WHERE l_linestatus <> 'O') AS write_ops, count(*) AS operations,
  avg(l_quantity) AS avg_read_latency_ms, max(l_quantity) AS avg_write_latency_ms, avg(l_discount) * 1000 AS utilization_percent, 120.0::DOUBLE AS duration_seconds FROM lineitem GROUP BY 1)"""
I_COLS = ("read_bytes", "write_bytes", "avg_read_latency_ms", "avg_write_latency_ms", "utilization_percent", "duration_seconds")


def k03(s, d):
    made = _io(s, d).select("device", F.col("read_bytes").alias("bytes_sent"), F.col("write_bytes").alias("bytes_received"), "duration_seconds", F.when(F.col("device") % 5 != 0, F.col("device") * 0.5).alias("capacity_mbps"))
    return rounded(c.bandwidth(made))


def y01(s, d):
    e = t(s, d, "events").groupBy("user_id").agg((100.0 - F.avg("value")).alias("idle_percent"), F.min("value").alias("iowait_percent"), (F.count("*") / 10).alias("load_average_1m"))
    return rounded(c.cpu_metrics(e.withColumn("core_count", (F.col("user_id") % 8).cast("int"))))


def y02(s, d):
    # Whole bytes are cut from a sum of doubles, so the order of additions shows: prices are added one by one by order key, however the
    # table is split, as the SQL adds them in one thread. The window streams a customer's orders.
    by_key = W.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")
    so_far = by_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = t(s, d, "orders").select("o_custkey", F.sum("o_totalprice").over(so_far).cast("long").alias("used_bytes"), F.max("o_totalprice").over(so_far).cast("long").alias("swap_used_bytes"), F.lead(F.lit(True)).over(by_key).alias("_more"))
    e = e.where("_more IS NULL").drop("_more")
    made = c.memory_metrics(e.withColumn("total_bytes", F.lit(3000000).cast("long")).withColumn("swap_total_bytes", F.when(F.col("o_custkey") % 3 != 0, 500000).cast("long")))
    return rounded(made.withColumn("used", c.human_bytes(F.col("used_bytes"))))


def b01(s, d):
    p = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / 15).alias("lcp_ms"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 8).alias("fid_ms"), (F.col("l_discount") * 3).alias("cls"), (F.col("l_quantity") * 12).alias("inp_ms"), (F.col("l_tax") * 30000).alias("ttfb_ms"))
    return rounded(c.web_vitals(p))


def b03(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit(0.0).alias("dns_start_ms"), F.col("l_quantity").alias("dns_end_ms"), F.lit(5.0).alias("connect_start_ms"), (5.0 + F.col("l_linenumber") * 10).alias("connect_end_ms"), F.when(F.col("l_returnflag") == "R", 10.0).alias("ssl_start_ms"), F.when(F.col("l_returnflag") == "R", 70.0).alias("ssl_end_ms"),
        F.lit(80.0).alias("request_start_ms"), (80 + F.col("l_discount") * 500).alias("response_start_ms"), (80 + F.col("l_discount") * 500 + F.col("l_tax") * 300).alias("response_end_ms"), F.lit(150.0).alias("dom_interactive_ms"), F.lit(190.0).alias("dom_complete_ms"), F.lit(200.0).alias("load_event_end_ms"))
    return rounded(c.navigation_timing(li).select("l_orderkey", "l_linenumber", "l_extendedprice", "dns_lookup_ms", "ssl_handshake_ms", "content_download_ms", "backend_time_ms", "frontend_time_ms", "bottleneck"))


def _resources(s, d):
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("name"), F.when(F.col("l_returnflag") == "R", "img").when(F.col("l_returnflag") == "A", "script").otherwise("link").alias("initiator_type"), (F.col("l_linenumber") * 100.0).alias("start_time_ms"), (F.col("l_quantity") * 10).alias("duration_ms"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 7 * 100).otherwise(0).cast("long").alias("transfer_size_bytes"), F.lit(2500).cast("long").alias("encoded_body_size_bytes"))


RES = """(SELECT l_suppkey AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS name, CASE l_returnflag WHEN 'R' THEN 'img' WHEN 'A' THEN 'script' ELSE 'link' END AS initiator_type, l_linenumber * 100.0::DOUBLE AS start_time_ms, l_quantity * 10 AS duration_ms, CASE WHEN l_linestatus = 'O' THEN l_partkey % 7 * 100 ELSE 0 END::BIGINT AS transfer_size_bytes, 2500::BIGINT AS encoded_body_size_bytes FROM lineitem)"""
K01 = """SELECT *, CASE WHEN p95 <= 50 THEN 'good' WHEN p95 <= 100 THEN 'acceptable' ELSE 'poor' END AS status, array_to_string(list_filter([CASE WHEN p95 > 100 THEN 'high latency' END, CASE WHEN jitter > 20 THEN 'high jitter' END], lambda x: x IS NOT NULL), ',') AS recommendations FROM (
  SELECT user_id, count(value) AS sample_count, min(value) AS min_value, max(value) AS max_value, avg(value) AS mean, stddev_pop(value) AS std_dev, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999,
  coalesce(avg(step), 0.0) AS jitter, NULL::DOUBLE AS packet_loss_percent FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS step FROM events WHERE value IS NOT NULL) GROUP BY 1)"""

QUERIES = {
    "c01_cache": lambda s, d: rounded(c.cache_metrics(_cache(s, d))),
    "c03_cache_efficiency": lambda s, d: rounded(c.cache_efficiency(c.cache_metrics(_cache(s, d))).select("user_id", "memory_efficiency_percent", "latency_improvement_factor", "efficiency_score", "cost_savings_percent", "efficiency_status")),
    "c04_evictions": c04, "d01_query_metrics": d01, "d03_pool": d03,
    "d05_throughput": lambda s, d: rounded(c.throughput_figures(_io(s, d)).select("device", "qps", "read_iops", "write_iops", "total_iops", "read_mbps", "write_mbps", "total_mbps")),
    "d07_throughput_by_type": lambda s, d: rounded(c.throughput_by_type(t(s, d, "events"), "event_type", 3600)),
    "d08_capacity": lambda s, d: rounded(_io(s, d).select("device", *(x.alias(n) for x, n in zip(c.capacity(F.col("read_bytes"), F.col("write_bytes")), ("utilization", "headroom"), strict=True)))),
    "k01_latency": lambda s, d: rounded(c.latency_metrics(t(s, d, "events"), ["user_id"], "event_id")),
    "k03_bandwidth": k03,
    "k04_dns": lambda s, d: rounded(c.dns_metrics(t(s, d, "events"), "event_type", "value", F.col("value") < 60, F.col("user_id") % 25 == 0)),
    "y01_cpu": y01, "y02_memory": y02,
    "y04_io": lambda s, d: rounded(c.io_metrics(_io(s, d)).select("device", "read_bytes_per_sec", "write_bytes_per_sec", "total_iops", "total_throughput_mbps", "status")),
    "b01_vitals": b01, "b03_navigation": b03,
    "b04_resource_summary": lambda s, d: rounded(c.resource_summary(_resources(s, d), ["page"])),
    "b04_resources_by_type": lambda s, d: rounded(c.resources_by_type(_resources(s, d), ["page"])),
    "b04_top_resources": lambda s, d: rounded(c.top_resources(_resources(s, d), ["page"], "duration_ms").drop("name")),
}

VIT = {"lcp_ms": (2500, 4000), "fid_ms": (100, 300), "cls": (0.1, 0.25), "inp_ms": (200, 500), "ttfb_ms": (800, 1800)}
MARKS = "[" + ", ".join(f"CASE WHEN {n} <= {g} THEN 100.0 WHEN {n} <= {p} THEN 60.0 WHEN {n} IS NOT NULL THEN 20.0 END" for n, (g, p) in VIT.items()) + "]"
ORACLES = {
    "c01_cache": rounded_sql(CACHE_SQL, *C_COLS),
    "c03_cache_efficiency": rounded_sql(f"""SELECT user_id, me AS memory_efficiency_percent, avg_miss_latency_ms / avg_hit_latency_ms AS latency_improvement_factor, sc AS efficiency_score, hit_rate_percent * 0.8 AS cost_savings_percent, CASE WHEN sc >= 95 THEN 'excellent' WHEN sc >= 85 THEN 'good' WHEN sc >= 70 THEN 'fair' ELSE 'poor' END AS efficiency_status FROM (
      SELECT *, hit_rate_percent * 0.7 + me * 0.3 AS sc FROM (SELECT *, CASE WHEN fill_percent < 50 THEN fill_percent * 2 WHEN fill_percent > 95 THEN 90 + (100 - fill_percent) WHEN fill_percent IS NOT NULL THEN 90 + (fill_percent - 50) * 0.2 ELSE 100.0 END AS me FROM ({CACHE_SQL})))""", "memory_efficiency_percent", "latency_improvement_factor", "efficiency_score", "cost_savings_percent"),
    "c04_evictions": rounded_sql(f"""SELECT *, CASE WHEN evictions > 0 AND 100.0 * premature_evictions / evictions > 30 THEN 'critical' WHEN eviction_percent > 20 THEN 'high' WHEN eviction_percent > 10 THEN 'moderate' ELSE 'normal' END AS status,
      {CODES.format("CASE WHEN eviction_percent > 20 THEN 'high eviction rate' END, CASE WHEN premature_evictions > 0 THEN 'premature evictions' END, CASE WHEN avg_entry_age_seconds < 60 THEN 'young entries' END, CASE WHEN evictions > 0 AND 100.0 * lru_evictions / evictions > 70 THEN 'mostly lru' END")} AS recommendations FROM (SELECT *, evictions / 600.0 AS eviction_rate_per_sec, 100.0 * evictions / total_operations AS eviction_percent FROM (
      SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS evictions, count(*) AS total_operations, count(*) FILTER (WHERE event_type = 'error' AND value < 40) AS premature_evictions, count(*) FILTER (WHERE event_type = 'error' AND value < 150) AS lru_evictions, avg(value) AS avg_entry_age_seconds, 600.0::DOUBLE AS duration_seconds FROM events GROUP BY 1))""", "avg_entry_age_seconds", "duration_seconds", "eviction_rate_per_sec", "eviction_percent"),
    "d01_query_metrics": rounded_sql(f"""SELECT *, {CODES.format("CASE WHEN p95_execution_ms > 500 THEN 'high p95' END, CASE WHEN 100.0 * slow_query_count / total_queries > 10 THEN 'many slow queries' END, CASE WHEN index_usage_percent < 80 THEN 'low index usage' END, CASE WHEN scan_rate > 100 THEN 'full scans' END")} AS recommendations FROM (
      SELECT l_returnflag, count(*) AS total_queries, avg(l_extendedprice) AS average_execution_ms, max(l_extendedprice) AS max_execution_ms, min(l_extendedprice) AS min_execution_ms, count(*) FILTER (WHERE l_extendedprice > 50000) AS slow_query_count, 100.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*) AS index_usage_percent, quantile_cont(l_extendedprice, 0.5) AS median_execution_ms,
      quantile_cont(l_extendedprice, 0.95) AS p95_execution_ms, quantile_cont(l_extendedprice, 0.99) AS p99_execution_ms, sum(l_quantity) / sum(l_linenumber) AS scan_rate, l_returnflag IS NULL AS is_total FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag)))""", "average_execution_ms", "max_execution_ms", "min_execution_ms", "index_usage_percent", "median_execution_ms", "p95_execution_ms", "p99_execution_ms", "scan_rate"),
    "d03_pool": rounded_sql(f"""SELECT *, {CODES.format("CASE WHEN utilization_percent > 90 THEN 'high utilization' END, CASE WHEN utilization_percent < 20 THEN 'low utilization' END, CASE WHEN waiting_requests > 0 THEN 'waiting requests' END, CASE WHEN average_wait_time_ms > 100 THEN 'long waits' END, CASE WHEN connection_errors > 0 THEN 'connection errors' END")} AS recommendations,
      greatest(trunc(active_connections * average_wait_time_ms / 1000 * 1.5)::INTEGER, active_connections::INTEGER, 5) AS optimal_pool_size FROM (SELECT o_custkey, count(*) AS active_connections, count(*) FILTER (WHERE o_orderstatus = 'P') AS waiting_requests, count(*) FILTER (WHERE o_orderstatus = 'F') AS connection_errors, 15::BIGINT AS pool_size, greatest(0, 15 - count(*))::BIGINT AS idle_connections, 0::BIGINT AS timeout_count,
      100.0 * count(*) / 15 AS utilization_percent, avg(o_totalprice / 1000) AS average_wait_time_ms, max(o_totalprice / 1000) AS max_wait_time_ms FROM orders GROUP BY 1)""", "utilization_percent", "average_wait_time_ms", "max_wait_time_ms", digits=9),
    "d05_throughput": rounded_sql(f"SELECT device, operations / 120 AS qps, read_ops / 120 AS read_iops, write_ops / 120 AS write_iops, (read_ops + write_ops) / 120 AS total_iops, read_bytes / 1048576 / 120 AS read_mbps, write_bytes / 1048576 / 120 AS write_mbps, (read_bytes + write_bytes) / 1048576 / 120 AS total_mbps FROM {IO}", "qps", "read_iops", "write_iops", "total_iops", "read_mbps", "write_mbps", "total_mbps"),
    "d07_throughput_by_type": rounded_sql("SELECT event_type, count(*) / 3600.0 AS per_second FROM events GROUP BY 1", "per_second"),
    "d08_capacity": rounded_sql(f"SELECT device, u AS utilization, 100 - u AS headroom FROM (SELECT device, least(100.0, greatest(0.0, CASE WHEN write_bytes > 0 THEN 100.0 * read_bytes / write_bytes ELSE 0.0 END)) AS u FROM {IO})", "utilization", "headroom"),
    "k01_latency": rounded_sql(K01, "min_value", "max_value", "mean", "std_dev", "median", "p50", "p75", "p90", "p95", "p99", "p999", "jitter", "packet_loss_percent"),
    "k03_bandwidth": rounded_sql(f"""SELECT *, CASE WHEN utilization_percent IS NULL THEN 'unknown' WHEN utilization_percent >= 90 THEN 'saturated' WHEN utilization_percent >= 70 THEN 'high' WHEN utilization_percent >= 30 THEN 'normal' ELSE 'low' END AS status FROM (SELECT *, CASE WHEN capacity_mbps > 0 THEN 100.0 * total_mbps / capacity_mbps END AS utilization_percent FROM (
      SELECT device, read_bytes AS bytes_sent, write_bytes AS bytes_received, duration_seconds, CASE WHEN device % 5 <> 0 THEN device * 0.5::DOUBLE END AS capacity_mbps, read_bytes * 8 / 1e6 / 120 AS upload_mbps, write_bytes * 8 / 1e6 / 120 AS download_mbps, read_bytes * 8 / 1e6 / 120 + write_bytes * 8 / 1e6 / 120 AS total_mbps FROM {IO}))""", "bytes_sent", "bytes_received", "duration_seconds", "capacity_mbps", "upload_mbps", "download_mbps", "total_mbps", "utilization_percent"),
    "k04_dns": rounded_sql(f"""SELECT *, CASE WHEN failure_rate > 5 THEN 'critical' WHEN p95_ms > 100 THEN 'slow' WHEN p95_ms > 50 THEN 'acceptable' ELSE 'good' END AS status, {CODES.format("CASE WHEN p95_ms > 100 THEN 'slow resolution' END, CASE WHEN cache_hit_rate < 50 THEN 'low cache hit rate' END, CASE WHEN failure_rate > 1 THEN 'failures' END")} AS recommendations FROM (
      SELECT event_type, count(*) AS total_queries, avg(value) AS avg_ms, quantile_cont(value, 0.95) AS p95_ms, max(value) AS max_ms, 100.0 * count(*) FILTER (WHERE value < 60) / count(*) AS cache_hit_rate, 100.0 * count(*) FILTER (WHERE user_id % 25 = 0) / count(*) AS failure_rate, event_type IS NULL AS is_total FROM events GROUP BY GROUPING SETS ((), (event_type)))""", "avg_ms", "p95_ms", "max_ms", "cache_hit_rate", "failure_rate"),
    "y01_cpu": rounded_sql(f"""SELECT *, CASE WHEN usage_percent >= 95 THEN 'critical' WHEN usage_percent >= 80 THEN 'warning' WHEN load_ratio > 2 THEN 'critical' WHEN load_ratio > 1 OR iowait_percent > 20 THEN 'warning' ELSE 'healthy' END AS status, {CODES.format("CASE WHEN usage_percent >= 95 THEN 'critical usage' END, CASE WHEN usage_percent >= 80 AND usage_percent < 95 THEN 'high usage' END, CASE WHEN iowait_percent > 20 THEN 'high iowait' END, CASE WHEN load_ratio > 1 THEN 'high load' END")} AS recommendations FROM (
      SELECT *, 100 - idle_percent AS usage_percent, CASE WHEN core_count > 0 THEN load_average_1m / core_count ELSE 0.0 END AS load_ratio FROM (SELECT user_id, 100.0 - avg(value) AS idle_percent, min(value) AS iowait_percent, count(*) / 10 AS load_average_1m, (user_id % 8)::INTEGER AS core_count FROM events GROUP BY 1))""", "idle_percent", "iowait_percent", "load_average_1m", "usage_percent", "load_ratio"),
    "y02_memory": rounded_sql("""SELECT *, total_bytes - used_bytes AS available_bytes, 100.0 * used_bytes / total_bytes AS usage_percent, CASE WHEN swap_total_bytes > 0 THEN 100.0 * swap_used_bytes / swap_total_bytes END AS swap_percent,
      CASE WHEN 100.0 * used_bytes / total_bytes >= 95 THEN 'critical' WHEN 100.0 * used_bytes / total_bytes >= 80 OR coalesce(100.0 * swap_used_bytes / swap_total_bytes, 0) > 50 THEN 'warning' ELSE 'healthy' END AS status,
      CASE WHEN used_bytes < 1024 THEN printf('%.2f B', used_bytes::DOUBLE) WHEN used_bytes < 1048576 THEN printf('%.2f KB', used_bytes / 1024.0::DOUBLE) ELSE printf('%.2f MB', used_bytes / 1048576.0::DOUBLE) END AS used
      FROM (SELECT o_custkey, trunc(sum(o_totalprice))::BIGINT AS used_bytes, trunc(max(o_totalprice))::BIGINT AS swap_used_bytes, 3000000::BIGINT AS total_bytes, CASE WHEN o_custkey % 3 <> 0 THEN 500000::BIGINT END AS swap_total_bytes FROM orders GROUP BY 1)""", "usage_percent", "swap_percent"),
    "y04_io": rounded_sql(f"SELECT device, read_bytes / 120 AS read_bytes_per_sec, write_bytes / 120 AS write_bytes_per_sec, (read_ops + write_ops) / 120 AS total_iops, (read_bytes + write_bytes) / 120 / 1048576 AS total_throughput_mbps, CASE WHEN utilization_percent >= 95 THEN 'critical' WHEN utilization_percent >= 80 OR greatest(avg_read_latency_ms, avg_write_latency_ms) > 50 THEN 'warning' ELSE 'healthy' END AS status FROM {IO}",
      "read_bytes_per_sec", "write_bytes_per_sec", "total_iops", "total_throughput_mbps"),
    "b01_vitals": rounded_sql(f"""SELECT * EXCLUDE (m), CASE WHEN list_min(m) <= 20 THEN 'poor' WHEN list_min(m) <= 60 THEN 'needs-improvement' ELSE 'good' END AS overall_rating, coalesce(list_sum(m) / len(m), 100.0)::DOUBLE AS score FROM (SELECT *, {", ".join(f"CASE WHEN {n} <= {g} THEN 'good' WHEN {n} <= {p} THEN 'needs-improvement' WHEN {n} IS NOT NULL THEN 'poor' END AS {n}_rating" for n, (g, p) in VIT.items())}, list_filter({MARKS}, lambda x: x IS NOT NULL) AS m
      FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice / 15 AS lcp_ms, CASE WHEN l_linenumber <> 3 THEN l_quantity * 8 END AS fid_ms, l_discount * 3 AS cls, l_quantity * 12 AS inp_ms, l_tax * 30000 AS ttfb_ms FROM lineitem))""", "l_quantity", "l_extendedprice", "lcp_ms", "fid_ms", "cls", "inp_ms", "ttfb_ms", "score"),
    "b03_navigation": rounded_sql("""SELECT l_orderkey, l_linenumber, l_extendedprice, dns AS dns_lookup_ms, ssl AS ssl_handshake_ms, dl AS content_download_ms, ttfb + dns + tcp + coalesce(ssl, 0) AS backend_time_ms, fe AS frontend_time_ms,
      list_reduce([{'v': dns, 'n': 'DNS Lookup'}, {'v': tcp, 'n': 'TCP Connection'}, {'v': ttfb, 'n': 'TTFB (Server Response)'}, {'v': dl, 'n': 'Content Download'}, {'v': 40.0, 'n': 'DOM Processing'}, {'v': fe, 'n': 'Frontend Rendering'}, {'v': coalesce(ssl, -1e9), 'n': 'SSL Handshake'}], lambda a, b: CASE WHEN b.v > a.v THEN b ELSE a END).n AS bottleneck
      FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity AS dns, 5.0 + l_linenumber * 10 - 5.0 AS tcp, CASE WHEN l_returnflag = 'R' THEN 60.0::DOUBLE END AS ssl, 80 + l_discount * 500 - 80 AS ttfb, 80 + l_discount * 500 + l_tax * 300 - (80 + l_discount * 500) AS dl, 200.0 - (80 + l_discount * 500 + l_tax * 300) AS fe FROM lineitem)""", "l_extendedprice", "dns_lookup_ms", "ssl_handshake_ms", "content_download_ms", "backend_time_ms", "frontend_time_ms"),
    "b04_resource_summary": rounded_sql(f"SELECT page, count(*) AS resource_count, sum(transfer_size_bytes)::BIGINT AS total_bytes, max(start_time_ms + duration_ms) AS total_duration_ms, count(*) FILTER (WHERE initiator_type IN ('script', 'link') AND start_time_ms < 500) AS blocking_count, 100.0 * count(*) FILTER (WHERE transfer_size_bytes = 0 OR transfer_size_bytes < 250) / count(*) AS cache_hit_rate FROM {RES} GROUP BY 1", "total_duration_ms", "cache_hit_rate"),
    "b04_resources_by_type": rounded_sql(f'SELECT page, initiator_type, count(*) AS "count", sum(transfer_size_bytes)::BIGINT AS total_bytes, sum(duration_ms) AS total_duration_ms, avg(duration_ms) AS avg_duration_ms FROM {RES} GROUP BY 1, 2', "total_duration_ms", "avg_duration_ms"),
    "b04_top_resources": rounded_sql(f"SELECT page, rank::INTEGER AS rank, initiator_type, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY duration_ms DESC, name) AS rank FROM {RES}) WHERE rank <= 5", "duration_ms"),
}
