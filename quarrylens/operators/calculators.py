"""Cache, database, network, system and web figures: columns added to rows of counters, or aggregates of samples.

Figures are not rounded; figures that count as missing when they are zero are null. Recommendations are
arrays of short codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.functions.numeric import messages, none_if_zero, ratio, steps
from quarrylens.operators.quantiles import at_levels
from quarrylens.operators.series import with_previous
from quarrylens.operators.stats import summary, with_percentiles

MIB = 1024.0 * 1024.0


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose test holds, comma-joined in order; a null test does not hold."""
    return F.array_join(messages(*((F.coalesce(c, F.lit(False)), code) for c, code in pairs)), ",")


def cache_status(rate: Column) -> Column:
    return steps(rate, [(95, "excellent"), (85, "good"), (70, "fair")], "poor")


def cache_metrics(df: DataFrame) -> DataFrame:
    """C1, C2 from hits, misses, avg_hit_latency_ms, avg_miss_latency_ms, size_bytes, max_size_bytes."""
    df = df.withColumn("total_requests", F.col("hits") + F.col("misses"))
    df = df.withColumn("hit_rate_percent", ratio(100.0 * F.col("hits"), "total_requests")).withColumn("miss_rate_percent", ratio(100.0 * F.col("misses"), "total_requests"))
    df = df.withColumn("latency_savings_ms", none_if_zero((F.col("avg_miss_latency_ms") - F.col("avg_hit_latency_ms")) * F.col("hits")))
    df = df.withColumn("fill_percent", none_if_zero(ratio(100.0 * F.col("size_bytes"), "max_size_bytes", None))).withColumn("status", cache_status(F.col("hit_rate_percent")))
    fill = F.col("fill_percent")
    return df.withColumn("recommendations", codes((F.col("hit_rate_percent") < 70, "low hit rate"), (fill > 95, "nearly full"), (fill < 30, "low utilization"), (F.col("avg_hit_latency_ms") > 0.5 * none_if_zero("avg_miss_latency_ms"), "slow hits")))


def cache_efficiency(df: DataFrame) -> DataFrame:
    """0.7 hit rate + 0.3 memory efficiency; the latter is piecewise in the fill and jumps at 95."""
    fill = F.col("fill_percent")
    memory = F.when(fill < 50, fill * 2).when(fill > 95, 90 + (100 - fill)).when(fill.isNotNull(), 90 + (fill - 50) * 0.2).otherwise(100.0)
    factor = F.when((F.col("avg_hit_latency_ms") > 0) & (F.col("avg_miss_latency_ms") != 0), F.col("avg_miss_latency_ms") / F.col("avg_hit_latency_ms"))
    df = df.withColumn("memory_efficiency_percent", memory).withColumn("latency_improvement_factor", factor).withColumn("efficiency_score", F.col("hit_rate_percent") * 0.7 + memory * 0.3)
    return df.withColumn("cost_savings_percent", F.col("hit_rate_percent") * 0.8).withColumn("efficiency_status", cache_status(F.col("efficiency_score")))


def evictions(df: DataFrame) -> DataFrame:
    """C4 from evictions, duration_seconds, total_operations, premature_evictions, lru_evictions, avg_entry_age_seconds."""
    df = df.withColumn("eviction_rate_per_sec", ratio("evictions", "duration_seconds")).withColumn("eviction_percent", ratio(100.0 * F.col("evictions"), "total_operations"))
    early = ratio(100.0 * F.col("premature_evictions"), "evictions")
    df = df.withColumn("status", F.when(early > 30, "critical").when(F.col("eviction_percent") > 20, "high").when(F.col("eviction_percent") > 10, "moderate").otherwise("normal"))
    return df.withColumn("recommendations", codes((F.col("eviction_percent") > 20, "high eviction rate"), (F.col("premature_evictions") > 0, "premature evictions"), ((F.col("avg_entry_age_seconds") < 60) & (F.col("avg_entry_age_seconds") != 0), "young entries"), (ratio(100.0 * F.col("lru_evictions"), "evictions") > 70, "mostly lru")))


def query_metrics(df: DataFrame, by: str, time: str, examined: str, affected: str, used_index: Column, slow_ms: float = 100.0) -> DataFrame:
    """A row over all queries (the key null) and one for each type, from one pass."""
    v = F.col(time).cast("double")
    figures = [
        F.count("*").alias("total_queries"), F.avg(v).alias("average_execution_ms"), F.max(v).alias("max_execution_ms"), F.min(v).alias("min_execution_ms"),
        F.count_if(v > slow_ms).alias("slow_query_count"), (F.avg(used_index.cast("double")) * 100).alias("index_usage_percent"), F.sum(examined).alias("_x"), F.sum(F.when(F.col(affected) > 0, F.col(affected))).alias("_a"),
    ]
    made = at_levels(df, [[by], []], v, [0.5, 0.95, 0.99], figures)
    for k, n in enumerate(("median_execution_ms", "p95_execution_ms", "p99_execution_ms")):
        made = made.withColumn(n, F.col("_p")[k])
    made = made.withColumn("scan_rate", F.coalesce(ratio("_x", "_a"), F.lit(0.0))).withColumn("is_total", F.col("_level") == 1)
    slow = 100.0 * F.col("slow_query_count") / F.col("total_queries")
    return made.withColumn("recommendations", codes((F.col("p95_execution_ms") > 500, "high p95"), (slow > 10, "many slow queries"), (F.col("index_usage_percent") < 80, "low index usage"), (F.col("scan_rate") > 100, "full scans"))).drop("_level", "_p", "_x", "_a")


def pool_metrics(df: DataFrame) -> DataFrame:
    """D3 from pool_size, active_connections, idle_connections (may be null), waiting_requests, wait_times_ms (array), connection_errors, timeout_count."""
    waits = F.col("wait_times_ms")
    total = F.aggregate(waits, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("idle_connections", F.coalesce("idle_connections", F.greatest(F.lit(0), F.col("pool_size") - F.col("active_connections")))).withColumn("utilization_percent", ratio(100.0 * F.col("active_connections"), "pool_size"))
    df = df.withColumn("average_wait_time_ms", F.coalesce(F.try_divide(total, F.size(waits)), F.lit(0.0))).withColumn("max_wait_time_ms", F.coalesce(F.array_max(waits), F.lit(0.0)))
    use = F.col("utilization_percent")
    return df.withColumn("recommendations", codes((use > 90, "high utilization"), ((use < 20) & (F.col("pool_size") > 10), "low utilization"), (F.col("waiting_requests") > 0, "waiting requests"), (F.col("average_wait_time_ms") > 100, "long waits"), (F.col("connection_errors") > 0, "connection errors"), (F.col("timeout_count") > 0, "timeouts")))


def optimal_pool_size(concurrent: Column, avg_query_ms: Column) -> Column:
    """D4."""
    return F.greatest((concurrent * avg_query_ms / 1000 * 1.5).cast("int"), concurrent.cast("int"), F.lit(5))


def throughput_figures(df: DataFrame) -> DataFrame:
    """D5, D6 from operations, read_ops, write_ops, read_bytes, write_bytes, duration_seconds; a MB is 1024 squared."""
    per = lambda c: ratio(c, "duration_seconds")
    df = df.withColumn("qps", per("operations")).withColumn("read_iops", per("read_ops")).withColumn("write_iops", per("write_ops")).withColumn("total_iops", F.col("read_iops") + F.col("write_iops"))
    return df.withColumn("read_mbps", per(F.col("read_bytes") / MIB)).withColumn("write_mbps", per(F.col("write_bytes") / MIB)).withColumn("total_mbps", F.col("read_mbps") + F.col("write_mbps"))


def throughput_by_type(df: DataFrame, by: str, seconds: float) -> DataFrame:
    """D7."""
    return df.groupBy(by).agg((F.count("*") / F.lit(float(seconds))).alias("per_second"))


def capacity(current: Column, most: Column) -> tuple[Column, Column]:
    """Utilisation and headroom in percent, both between 0 and 100."""
    use = F.least(F.lit(100.0), F.greatest(F.lit(0.0), ratio(100.0 * current, most)))
    return use, F.lit(100.0) - use


def latency_metrics(df: DataFrame, keys: list[str], order: str, value: str = "value", packet_loss: Column | None = None) -> DataFrame:
    """K1, K2: summary, jitter in order, status."""
    rows = with_previous(df.where(F.col(value).isNotNull()), keys, order, value, "_before").withColumn("_step", F.abs(F.col(value) - F.col("_before")))
    made = with_percentiles(summary(rows, keys, value, F.coalesce(F.avg("_step"), F.lit(0.0)).alias("jitter"), F.max(packet_loss if packet_loss is not None else F.lit(None).cast("double")).alias("packet_loss_percent")))
    loss = F.coalesce("packet_loss_percent", F.lit(0.0))
    made = made.withColumn("status", F.when(loss > 5, "poor").when(F.col("p95") <= 50, "good").when(F.col("p95") <= 100, "acceptable").otherwise("poor"))
    return made.withColumn("recommendations", codes((F.col("p95") > 100, "high latency"), (F.col("jitter") > 20, "high jitter"), (loss > 1, "packet loss")))


def bandwidth(df: DataFrame) -> DataFrame:
    """K3 from bytes_sent, bytes_received, duration_seconds, capacity_mbps; a megabit is a million bits."""
    mbps = lambda c: ratio(F.col(c) * 8 / 1e6, "duration_seconds")
    df = df.withColumn("upload_mbps", mbps("bytes_sent")).withColumn("download_mbps", mbps("bytes_received")).withColumn("total_mbps", F.col("upload_mbps") + F.col("download_mbps"))
    df = df.withColumn("utilization_percent", ratio(100.0 * F.col("total_mbps"), "capacity_mbps", None))
    return df.withColumn("status", F.when(F.col("utilization_percent").isNull(), "unknown").otherwise(steps("utilization_percent", [(90, "saturated"), (70, "high"), (30, "normal")], "low")))


def dns_metrics(df: DataFrame, record_type: str, time: str, cache_hit: Column, failure: Column) -> DataFrame:
    """K4: over all lookups (record type null) and for each type."""
    v = F.col(time).cast("double")
    made = at_levels(df, [[record_type], []], v, [0.95], [F.count("*").alias("total_queries"), F.avg(v).alias("avg_ms"), F.max(v).alias("max_ms"), (F.avg(cache_hit.cast("double")) * 100).alias("cache_hit_rate"), (F.avg(failure.cast("double")) * 100).alias("failure_rate")])
    made = made.withColumn("p95_ms", F.col("_p")[0]).withColumn("is_total", F.col("_level") == 1).drop("_level", "_p")
    made = made.withColumn("status", F.when(F.col("failure_rate") > 5, "critical").when(F.col("p95_ms") > 100, "slow").when(F.col("p95_ms") > 50, "acceptable").otherwise("good"))
    return made.withColumn("recommendations", codes((F.col("p95_ms") > 100, "slow resolution"), (F.col("cache_hit_rate") < 50, "low cache hit rate"), (F.col("failure_rate") > 1, "failures")))


def cpu_metrics(df: DataFrame) -> DataFrame:
    """Y1 from idle_percent, iowait_percent, load_average_1m, core_count."""
    df = df.withColumn("usage_percent", F.lit(100.0) - F.col("idle_percent")).withColumn("load_ratio", ratio("load_average_1m", "core_count"))
    use, load, wait = F.col("usage_percent"), F.col("load_ratio"), F.coalesce("iowait_percent", F.lit(0.0))
    df = df.withColumn("status", F.when(use >= 95, "critical").when(use >= 80, "warning").when(load > 2, "critical").when(load > 1, "warning").when(wait > 20, "warning").otherwise("healthy"))
    return df.withColumn("recommendations", codes((use >= 95, "critical usage"), ((use >= 80) & (use < 95), "high usage"), (wait > 20, "high iowait"), (load > 1, "high load")))


def memory_metrics(df: DataFrame) -> DataFrame:
    """Y2 from used_bytes, total_bytes, swap_used_bytes, swap_total_bytes."""
    df = df.withColumn("available_bytes", F.col("total_bytes") - F.col("used_bytes")).withColumn("usage_percent", ratio(100.0 * F.col("used_bytes"), "total_bytes")).withColumn("swap_percent", ratio(100.0 * F.coalesce("swap_used_bytes", F.lit(0)), "swap_total_bytes", None))
    use, swap = F.col("usage_percent"), F.coalesce("swap_percent", F.lit(0.0))
    return df.withColumn("status", F.when(use >= 95, "critical").when((use >= 80) | (swap > 50), "warning").otherwise("healthy"))


def human_bytes(value: Column) -> Column:
    """Y3. A figure halfway between two of two digits becomes the even one, as printf has it; format_string would round it up."""
    v, out = value.cast("double"), None

    def shown(k: int, unit: str) -> Column:
        x = v / 1024.0**k
        # Halfway are odd eighths, and those that end in .125 or .625 go towards zero.
        down = F.pmod(F.abs(x) * 8, F.lit(4.0)) == 1
        return F.format_string("%.2f " + unit, F.when(down, x - F.signum(x) * 0.001).otherwise(x))

    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        hit = F.abs(v) < 1024.0 ** (k + 1)
        out = F.when(hit, shown(k, unit)) if out is None else out.when(hit, shown(k, unit))
    return out.otherwise(shown(5, "PB"))


def io_metrics(df: DataFrame) -> DataFrame:
    """Y4 from read_bytes, write_bytes, read_ops, write_ops, duration_seconds, avg_read_latency_ms, avg_write_latency_ms, utilization_percent, queue_depth."""
    per = lambda c: ratio(c, "duration_seconds")
    df = df.withColumn("read_bytes_per_sec", per("read_bytes")).withColumn("write_bytes_per_sec", per("write_bytes")).withColumn("read_ops_per_sec", per("read_ops")).withColumn("write_ops_per_sec", per("write_ops"))
    df = df.withColumn("total_iops", F.col("read_ops_per_sec") + F.col("write_ops_per_sec")).withColumn("total_throughput_mbps", (F.col("read_bytes_per_sec") + F.col("write_bytes_per_sec")) / MIB)
    use = F.coalesce("utilization_percent", F.lit(0.0))
    late = F.greatest(F.coalesce("avg_read_latency_ms", F.lit(0.0)), F.coalesce("avg_write_latency_ms", F.lit(0.0)))
    return df.withColumn("status", F.when(use >= 95, "critical").when((use >= 80) | (late > 50), "warning").otherwise("healthy"))


#: Good up to, poor beyond (fixed values).
VITALS = {"lcp_ms": (2500, 4000), "fid_ms": (100, 300), "cls": (0.1, 0.25), "inp_ms": (200, 500), "ttfb_ms": (800, 1800), "fcp_ms": (1800, 3000)}


def web_vitals(df: DataFrame) -> DataFrame:
    """B1, B2: a rating for each of the vitals that df has, the worst of them, and the mean of 100, 60 and 20."""
    names = [n for n in VITALS if n in df.columns]
    for n in names:
        good, poor = VITALS[n]
        df = df.withColumn(f"{n}_rating", F.when(F.col(n) <= good, "good").when(F.col(n) <= poor, "needs-improvement").when(F.col(n).isNotNull(), "poor"))
    marks = F.array_compact(F.array(*(F.when(F.col(f"{n}_rating") == "good", 100.0).when(F.col(f"{n}_rating") == "needs-improvement", 60.0).when(F.col(f"{n}_rating") == "poor", 20.0) for n in names)))
    df = df.withColumn("overall_rating", F.when(F.array_min(marks) <= 20, "poor").when(F.array_min(marks) <= 60, "needs-improvement").otherwise("good"))
    return df.withColumn("score", F.coalesce(F.try_divide(F.aggregate(marks, F.lit(0.0), lambda a, x: a + x), F.size(marks)), F.lit(100.0)))


def navigation_timing(df: DataFrame) -> DataFrame:
    """B3. Of equal phases the earlier one in the list is the bottleneck."""
    c = F.col
    df = df.withColumns({
        "dns_lookup_ms": c("dns_end_ms") - c("dns_start_ms"), "tcp_connection_ms": c("connect_end_ms") - c("connect_start_ms"), "ssl_handshake_ms": c("ssl_end_ms") - c("ssl_start_ms"), "ttfb_ms": c("response_start_ms") - c("request_start_ms"),
        "content_download_ms": c("response_end_ms") - c("response_start_ms"), "dom_processing_ms": c("dom_complete_ms") - c("dom_interactive_ms"), "frontend_time_ms": c("load_event_end_ms") - c("response_end_ms"),
    })
    df = df.withColumn("backend_time_ms", c("ttfb_ms") + c("dns_lookup_ms") + c("tcp_connection_ms") + F.coalesce("ssl_handshake_ms", F.lit(0.0)))
    phases = (("dns_lookup_ms", "DNS Lookup"), ("tcp_connection_ms", "TCP Connection"), ("ttfb_ms", "TTFB (Server Response)"), ("content_download_ms", "Content Download"), ("dom_processing_ms", "DOM Processing"), ("frontend_time_ms", "Frontend Rendering"), ("ssl_handshake_ms", "SSL Handshake"))
    ranked = F.array(*(F.struct((none_if_zero(col) if col == "ssl_handshake_ms" else c(col)).cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (col, name) in enumerate(phases)))
    return df.withColumn("bottleneck", F.array_max(F.filter(ranked, lambda x: x["v"].isNotNull()))["name"])


def resource_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of name, initiator_type, start_time_ms, duration_ms, transfer_size_bytes, encoded_body_size_bytes."""
    size = F.col("transfer_size_bytes")
    cached = (size == 0) | (size < F.col("encoded_body_size_bytes") * 0.1)
    blocking = F.col("initiator_type").isin("script", "link", "stylesheet") & (F.col("start_time_ms") < 500)
    return df.groupBy(*keys).agg(F.count("*").alias("resource_count"), F.sum(size).alias("total_bytes"), F.max(F.col("start_time_ms") + F.col("duration_ms")).alias("total_duration_ms"), F.count_if(blocking).alias("blocking_count"), (F.avg(cached.cast("double")) * 100).alias("cache_hit_rate"))


def resources_by_type(df: DataFrame, keys: list[str]) -> DataFrame:
    """B4, W9."""
    return df.groupBy(*keys, "initiator_type").agg(F.count("*").alias("count"), F.sum("transfer_size_bytes").alias("total_bytes"), F.sum("duration_ms").alias("total_duration_ms"), F.avg("duration_ms").alias("avg_duration_ms"))


def top_resources(df: DataFrame, keys: list[str], measure: str, n: int = 5) -> DataFrame:
    """The n largest (or slowest) of each group, ties by name."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(measure), "name"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "rank", "name", "initiator_type", measure)
